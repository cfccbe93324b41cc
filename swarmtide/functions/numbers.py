"""Small numeric helpers: near-equal factors, logarithmic edges, sizes of cores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def root_factor(n: Column, parts: int) -> Column:
    """Largest divisor of a positive whole number that is no larger than its ``parts``-th root."""
    limit = F.floor(F.pow(n.cast("double"), F.lit(1 / parts)) + 1e-9).cast("long")
    candidates = F.sequence(F.lit(1).cast("long"), limit)
    return F.array_max(F.filter(candidates, lambda d: n % d == 0))


def near_factors(n: Column, parts: int) -> Column:
    """Array of ``parts`` whole numbers with product n: each the largest divisor of what is left up to its root. Null unless n > 0."""
    found: list[Column] = []
    left = n.cast("long")
    for k in range(parts, 0, -1):
        found.append(left if k == 1 else root_factor(left, k))
        left = (left / found[-1]).cast("long")
    return F.when(n > 0, F.array(*found))


def log_edges(low: float, high: float, n: int) -> list[float]:
    """n numbers from ``low`` to ``high``, both exact, in equal ratios."""
    step = (math.log(high) - math.log(low)) / (n - 1)
    return [low, *(low * math.exp(step * k) for k in range(1, n - 1)), high]


def core_size(nbound: Column, factor: float, least: int) -> Column:
    """Members that fix a centre: a share of the bound ones, at least ``least``, never more than there are."""
    return F.least(F.greatest(F.floor(nbound * factor), F.lit(least)), nbound).cast("long")
