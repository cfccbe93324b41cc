"""Histograms, weighted percentiles, binned summaries, density levels and significance."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bin_of(x: Column, edges: list[float]) -> Column:
    """Index of the half-open bin that holds x; null outside."""
    out = F.when(F.lit(False), F.lit(0))
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        out = out.when((x >= a) & (x < b), i)
    return out.cast("long")


def histogram(df: DataFrame, x: str, edges: list[float], weight: str | None = None) -> DataFrame:
    """(bin, n, w, density) of the bins that hold something; ``density`` is weight per width, over all weight in the bins."""
    w = F.col(weight) if weight else F.lit(1.0)
    found = df.select(bin_of(F.col(x), edges).alias("bin"), w.alias("w")).where("bin is not null")
    sums = found.groupBy("bin").agg(F.count("*").alias("n"), F.sum("w").alias("w"))  # a row per bin
    widths = F.array(*(F.lit(b - a) for a, b in zip(edges, edges[1:])))
    return sums.withColumn("density", F.col("w") / F.sum("w").over(Window.partitionBy()) / F.get(widths, F.col("bin").cast("int")))


def weighted_percentiles(df: DataFrame, groups: list[str], y: str, weight: str, percents: list[float]) -> DataFrame:
    """Interpolated percentiles of cumulated weight, held at the first and last value; equal values keep the order of ``tie``."""
    w = Window.partitionBy(*groups)
    order = w.orderBy(y, "tie")
    c = F.sum(weight).over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum(weight).over(w) * 100
    ranked = df.withColumn("__p", c)
    ranked = ranked.withColumn("__p0", F.lag("__p").over(order)).withColumn("__y0", F.lag(y).over(order))
    value = lambda q: F.min(
        F.when(
            F.col("__p") >= q,
            F.struct(
                "__p",
                F.when(F.col("__p0").isNull(), F.col(y))
                .otherwise(F.col("__y0") + (F.col(y) - F.col("__y0")) * (q - F.col("__p0")) / (F.col("__p") - F.col("__p0")))
                .alias("v"),
            ),
        )
    )["v"]
    return ranked.groupBy(*groups).agg(*(F.coalesce(value(q), F.max(y)).alias(f"p{q:g}") for q in percents))


def skeleton(df: DataFrame, x: str, y: str, edges: list[float], alpha: float = 0.683) -> DataFrame:
    """Per bin of x: number, mean, median, population deviation and the central interval of share ``alpha``."""
    found = df.withColumn("bin", bin_of(F.col(x), edges)).where("bin is not null")
    tails = [(1 - alpha) / 2, (1 + alpha) / 2]
    return found.groupBy("bin").agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.percentile(y, 0.5).alias("median"),
        F.stddev_pop(y).alias("std"), F.percentile(y, tails[0]).alias("low"), F.percentile(y, tails[1]).alias("high"),
    )


def density_2d(df: DataFrame, x: str, y: str, edges_x: list[float], edges_y: list[float]) -> DataFrame:
    found = df.select(bin_of(F.col(x), edges_x).alias("i"), bin_of(F.col(y), edges_y).alias("j"))
    return found.where("i is not null and j is not null").groupBy("i", "j").agg(F.count("*").alias("n"))


def percent_levels(values: DataFrame, z: str, percents: list[float]) -> DataFrame:
    """(percent, level): of values from the largest down, the one at which the running share is nearest to the percentage.

    ``values`` are cells of a grid; equal ones are added up first, the earliest of equally near shares counts.
    """
    same = values.groupBy(F.col(z).alias("v")).agg(F.count("*").alias("k"))  # bounded by distinct values
    total = F.sum(F.col("v") * F.col("k")).over(Window.partitionBy())
    before = F.coalesce(F.sum(F.col("v") * F.col("k")).over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = same.withColumn("t", total).withColumn("b", before)
    wanted = runs.withColumn("percent", F.explode(F.array(*map(F.lit, percents))))
    # of a run of k equal values the nearest running share is at one of its ends or next to the wanted share
    step = F.greatest(F.lit(1.0), F.least(F.col("k").cast("double"), (F.col("percent") * F.col("t") - F.col("b")) / F.col("v")))
    gap = lambda s: F.abs((F.col("b") + s * F.col("v")) / F.col("t") - F.col("percent"))
    best = F.least(gap(F.floor(step)), gap(F.ceil(step)))
    return wanted.groupBy("percent").agg(F.min_by("v", F.struct(F.round(best, 12), -F.col("v"))).alias("level"))


def p_to_sigma(p: float) -> float:
    """Two-sided significance of a probability of agreement, in standard deviations."""
    return -NormalDist().inv_cdf(p / 2)


def chi2_survival(x: float, k: int) -> float:
    """Probability that a chi-square variable of k degrees exceeds x, by the series of the lower incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, half = k / 2, x / 2
    if half > a + 1:  # continued fraction of the upper function, Lentz's way
        b = half + 1 - a
        c, d = 1e300, 1 / b
        h = d
        for i in range(1, 1000):
            an = -i * (i - a)
            b += 2
            d = 1 / (an * d + b)
            c = b + an / c
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return math.exp(-half + a * math.log(half) - math.lgamma(a)) * h
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return 1 - total * math.exp(-half + a * math.log(half) - math.lgamma(a))


def ad_survival(ad: float) -> float:
    """Probability that an Anderson-Darling statistic of a uniform sample exceeds ``ad``."""
    # fixed values: weight, mean and width of the two normal laws fitted to its logarithm
    fit = ((0.569, -0.570, 0.511), (0.431, 0.227, 0.569))
    return sum(w * (1 - NormalDist(mu, sigma).cdf(math.log(ad))) for w, mu, sigma in fit)


def ad_to_sigma(ad: float) -> float:
    return p_to_sigma(ad_survival(ad))


def sigma_to_ratio(sigma: float, k: int = 1) -> float:
    """Twice the log-likelihood ratio that k degrees of freedom need for a significance: by bisection."""
    wanted, low, high = chi2_survival(sigma**2, 1), 0.0, 1.0
    while chi2_survival(high, k) > wanted:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_survival(mid, k) > wanted else (low, mid)
    return (low + high) / 2


def chi2_to_sigma(x: float, k: int) -> float:
    return p_to_sigma(chi2_survival(x, k))
