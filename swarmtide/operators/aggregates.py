"""Mass-weighted kinematics, typed counts, dispersions, shapes and profiles of particle groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from swarmtide.functions.geometry import AXES, cross, min_image
from swarmtide.plans.workspace import Workspace

VELOCITIES = ("vx", "vy", "vz")


def _origins(particles: DataFrame, group: str, order: str, columns=AXES) -> DataFrame:
    """Each group's first particle, by a pre-aggregated minimum."""
    first = F.min_by(F.struct(*columns), order)
    return particles.groupBy(group).agg(first.alias("__o"))


def with_origin(particles: DataFrame, group: str, order: str, columns=AXES) -> DataFrame:
    return particles.join(_origins(particles, group, order, columns), group)


def mean_position(particles: DataFrame, group: str, order: str, box: float | None) -> DataFrame:
    """(group, mass, x, y, z): mass-weighted, at nearest image of the first particle; not wrapped back."""
    seen = with_origin(particles, group, order)
    sums = [F.sum(F.col("mass") * min_image(F.col(c) - F.col(f"__o.{c}"), box)).alias(f"__{c}") for c in AXES]
    out = seen.groupBy(group).agg(F.sum("mass").alias("mass"), F.first("__o").alias("__o"), *sums)
    return out.select(group, "mass", *((F.col(f"__{c}") / F.col("mass") + F.col(f"__o.{c}")).alias(c) for c in AXES))


def mean_velocity(particles: DataFrame, group: str) -> DataFrame:
    return particles.groupBy(group).agg(F.sum("mass").alias("mass"), *((F.sum(F.col("mass") * F.col(c)) / F.sum("mass")).alias(c) for c in VELOCITIES))


def typed_counts(particles: DataFrame, group: str, types: int = 6) -> DataFrame:
    """Number and mass of each particle type, as two arrays."""
    n = [F.count_if(F.col("type") == t) for t in range(types)]
    m = [F.coalesce(F.sum(F.when(F.col("type") == t, F.col("mass"))), F.lit(0.0)) for t in range(types)]
    return particles.groupBy(group).agg(F.array(*n).alias("nbound_type"), F.array(*m).alias("mbound_type"))


def core_dispersion(particles: DataFrame, group: str, columns: tuple[str, ...], box: float | None, most: int = 20) -> DataFrame:
    """(group, sigma) over the first ``most`` members: root of the summed variances; groups of one have 0."""
    core = particles.where(F.col("ord") < most)
    seen = with_origin(core, group, "ord", columns)
    m, terms = F.sum("mass"), []
    for c in columns:
        d = min_image(F.col(c) - F.col(f"__o.{c}"), box)
        terms.append(F.sum(F.col("mass") * d * d) / m - F.pow(F.sum(F.col("mass") * d) / m, F.lit(2)))
    variance = terms[0] + terms[1] + terms[2]
    return seen.groupBy(group).agg(F.when(F.count("*") <= 1, 0.0).otherwise(F.sqrt(F.greatest(variance, F.lit(0.0)))).alias("sigma"))


def inertia(particles: DataFrame, group: str, order: str, box: float | None) -> DataFrame:
    """Tensor about the first particle, plain and weighted by 1 / r2, over the group's mass; xx, xy, xz, yy, yz, zz."""
    seen = with_origin(particles, group, order)
    d = [min_image(F.col(c) - F.col(f"__o.{c}"), box) for c in AXES]
    r2 = d[0] * d[0] + d[1] * d[1] + d[2] * d[2]
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    plain = [(F.sum(F.col("mass") * d[i] * d[j]) / F.sum("mass")).alias(f"i{AXES[i]}{AXES[j]}") for i, j in pairs]
    weighted = [(F.coalesce(F.sum(F.when(r2 > 0, F.col("mass") * d[i] * d[j] / r2)), F.lit(0.0)) / F.sum("mass")).alias(f"w{AXES[i]}{AXES[j]}") for i, j in pairs]
    return seen.groupBy(group).agg(*plain, *weighted)


def principal_axes(tensors: DataFrame, columns: list[str]) -> DataFrame:
    """Adds ``axes``: eigenvectors times eigenvalues, by falling eigenvalue; the largest component of each is positive."""
    @F.pandas_udf("array<array<double>>")
    def axes(rows: pd.Series) -> pd.Series:
        stack = np.array(rows.tolist(), float).reshape(-1, 6)[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        value, vector = np.linalg.eigh(stack)
        largest = np.take_along_axis(vector, np.abs(vector).argmax(1)[:, None, :], 1)
        scaled = vector * np.where(largest < 0, -1, 1) * value[:, None, :]
        return pd.Series(scaled.transpose(0, 2, 1)[:, ::-1].tolist())

    return tensors.withColumn("axes", axes(F.array(*columns)))


def kinematics(particles: DataFrame, group: str, frame: DataFrame, hubble: float, scale: float, box: float | None) -> DataFrame:
    """Specific kinetic energy and angular momentum about a frame (group, x0.., vx0..), physical; groups of one have 0."""
    seen = particles.join(frame, group)
    d = [min_image(F.col(c) - F.col(f"{c}0"), box) * scale for c in AXES]
    v = [F.col(c) - F.col(f"{c}0") + hubble * x for c, x in zip(VELOCITIES, d)]
    m, one = F.sum("mass"), F.count("*") <= 1
    zero = lambda c: F.when(one, 0.0).otherwise(c)
    k = F.sum(F.col("mass") * (v[0] * v[0] + v[1] * v[1] + v[2] * v[2])) / 2 / m
    spin = [zero(F.sum(F.col("mass") * c) / m).alias(f"l{a}") for a, c in zip(AXES, cross(d, v))]
    return seen.groupBy(group).agg(zero(k).alias("kinetic"), *spin)


def profile(particles: DataFrame, group: str, order: str, box: float | None, softening: float) -> DataFrame:
    """Members with radius from the first one (not below the softening), enclosed mass and number, outward."""
    seen = with_origin(particles, group, order)
    d = [min_image(F.col(c) - F.col(f"__o.{c}"), box) for c in AXES]
    raw = seen.withColumn("__r", F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]))
    w = Window.partitionBy(group).orderBy("__r", order)
    inner = w.rowsBetween(Window.unboundedPreceding, 0)
    out = raw.select("*", F.sum("mass").over(inner).alias("m"), F.row_number().over(w).cast("long").alias("k"), F.count("*").over(Window.partitionBy(group)).alias("n"))
    return out.withColumn("r", F.greatest("__r", F.lit(softening))).drop("__r", "__o")


def vmax_rmax(prof: DataFrame, group: str, g: float, scale: float) -> DataFrame:
    """Peak of the circular velocity and its radius (the innermost of equal peaks); groups of one have 0."""
    v2 = F.col("m") / F.col("r")
    best = F.max(F.struct(v2.alias("v2"), (-F.col("k")).alias("k"), "r"))
    out = prof.groupBy(group).agg(best.alias("b"), F.max("n").alias("n"))
    zero = lambda c: F.when(F.col("n") <= 1, 0.0).otherwise(c)
    return out.select(group, zero(F.col("b.r")).alias("rmax"), zero(F.sqrt(F.col("b.v2") * g / scale)).alias("vmax"))


def radius_of_share(prof: DataFrame, group: str, share: float, into: str) -> DataFrame:
    """Radius of the member at place floor(share * n) outward; groups of one have 0."""
    at = F.col("k") - 1 == F.floor(F.col("n") * share)
    return prof.groupBy(group).agg(F.when(F.max("n") <= 1, 0.0).otherwise(F.max(F.when(at, F.col("r")))).alias(into))


def overdensity(prof: DataFrame, group: str, density: float) -> DataFrame:
    """Mass within the outermost radius whose mean density reaches ``density`` (mass over cubed radius), and the radius for it; else 0."""
    dense = F.col("m") > density * F.pow("r", F.lit(3))
    m = F.coalesce(F.max_by(F.when(dense, F.col("m")), F.when(dense, F.col("k"))), F.lit(0.0))
    return prof.groupBy(group).agg(m.alias("mass_in")).withColumn("radius_in", F.pow(F.col("mass_in") / density, F.lit(1 / 3)))


def overdensity_from_outside(prof: DataFrame, group: str, density: float, mass: float, tolerance: float = 1e-5) -> DataFrame:
    """Mass and radius at a mean ``density`` by guesses: members within the radius that the last guess implies, until it settles.

    For members of one mass. All groups step together; a group leaves when its radius changes by less than ``tolerance``, or when none or all
    members lie within. Each round is one aggregate over the members of groups that are left, and is written.
    """
    work = Workspace(prof.sparkSession, "overdensity")
    radius = lambda n: F.pow(n * mass / density, F.lit(1 / 3))
    members = prof.select(group, "r")
    left = members.groupBy(group).agg(F.count("*").alias("size"), F.max("r").alias("last"))
    left = work.keep(left.withColumn("guess", radius(F.col("size"))))
    done = []
    while not left.isEmpty():
        inside = F.count_if(F.col("r") < F.col("guess")).alias("n")
        counted = members.join(left, group).groupBy(group, "size", "last", "guess").agg(inside)
        # a last member exactly at the guess leaves the number as it was
        counted = counted.withColumn("n", F.when(F.col("last") == F.col("guess"), F.col("size")).otherwise(F.col("n")))
        counted = work.keep(counted.withColumn("next", radius(F.col("n"))))
        settled = (F.col("n") == 0) | (F.col("n") == F.col("size")) | (F.abs(F.col("next") - F.col("guess")) < tolerance * F.col("next"))
        done.append(counted.where(settled).select(group, (F.col("n") * mass).alias("mass_in"), F.col("next").alias("radius_in")))
        left = work.keep(counted.where(~settled).select(group, "size", F.lit(None).cast("double").alias("last"), F.col("next").alias("guess")))
    out = left.select(group, F.lit(0.0).alias("mass_in"), F.lit(0.0).alias("radius_in"))
    for part in done:
        out = out.union(part)
    return out
