"""Keyed lookups of particle lists, hosts, and list bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: No particle, snapshot, halo or track; and: not even among the snapshot's particles.
NULL, MISSING = -1, -2


def lookup(left: DataFrame, right: DataFrame, key: str, value: str, into: str) -> DataFrame:
    """Left lookup by an id; misses, null and negative keys give -1. Of repeated keys the smallest value counts."""
    index = right.where(F.col(key) >= 0).groupBy(F.col(key).alias("__k")).agg(F.min(value).alias("__v"))
    return left.join(index, left[key] == index["__k"], "left").withColumn(into, F.coalesce("__v", F.lit(NULL)).cast("long")).drop("__k", "__v")


def refresh(lists: DataFrame, particles: DataFrame, keys: list[str]) -> DataFrame:
    """Lists (with ``ord``) with the attributes their ids have in a snapshot; ids that are gone stay, with nulls."""
    return lists.join(particles, keys, "left")


def kick_missing(lists: DataFrame, owner: str, nbound: str | None = None) -> DataFrame:
    """Drops members without a snapshot row (``found`` false), keeps order and renumbers ``ord`` from 0.

    With ``nbound`` it becomes the number of survivors among the first ``nbound`` members.
    """
    if nbound:
        bound = F.sum((F.col("found") & (F.col("ord") < F.col(nbound))).cast("long")).over(Window.partitionBy(owner))
        lists = lists.withColumn(nbound, bound)
    place = F.row_number().over(Window.partitionBy(owner).orderBy("ord"))
    return lists.where("found").withColumn("ord", (place - 1).cast("long")).drop("found")


def two_level_host(ids: DataFrame, members: DataFrame, particles: DataFrame) -> DataFrame:
    """``host_halo_id`` of ids: the group that holds it, -1 if the particle is in none, -2 if the snapshot lacks it."""
    groups = members.groupBy("id").agg(F.min("halo_id").alias("__h"))
    seen = particles.select("id").distinct().withColumn("__p", F.lit(True))
    host = F.coalesce("__h", F.when(F.col("__p"), NULL).otherwise(MISSING))
    return ids.join(groups, "id", "left").join(seen, "id", "left").withColumn("host_halo_id", host.cast("long")).drop("__h", "__p")


def tracer_hosts(tracks: DataFrame, members: DataFrame) -> DataFrame:
    """(track, host_halo_id): the group of each track's first particle; tracks without particles have none (-1)."""
    first = tracks.groupBy("track").agg(F.min(F.when(F.col("id").isNotNull(), F.struct("ord", "id"))).alias("f"))
    first = first.select("track", "f.id")
    groups = members.groupBy("id").agg(F.min("halo_id").alias("__h"))
    return first.join(groups, "id", "left").select("track", F.coalesce("__h", F.lit(NULL)).cast("long").alias("host_halo_id"))


def most_bound(lists: DataFrame, owner: str) -> DataFrame:
    """(owner, most_bound_id): the first particle's id, or -1."""
    return lists.groupBy(owner).agg(F.coalesce(F.min_by("id", "ord"), F.lit(NULL)).cast("long").alias("most_bound_id"))


def truncate_source(lists: DataFrame, owner: str, factor: float) -> DataFrame:
    """Keeps the first floor(factor * nbound) members of each list; of orphans (nbound <= 1) the first nbound."""
    most = F.when(F.col("nbound") <= 1, F.col("nbound")).otherwise(F.floor(F.col("nbound") * factor))
    return lists.where(F.col("ord") < most)


def exclusive(lists: DataFrame, owner: str) -> DataFrame:
    """Each id goes to the shortest list that has it (ties: smallest owner); lists of one row neither claim nor lose."""
    sized = lists.withColumn("__n", F.count("*").over(Window.partitionBy(owner)))
    claim = F.row_number().over(Window.partitionBy("id").orderBy("__n", owner, "ord"))
    big = sized.where("__n > 1").withColumn("__c", claim).where("__c = 1").drop("__c")
    return big.unionByName(sized.where("__n <= 1")).drop("__n")


def task_range(index: Column, n: Column | int, tasks: int) -> Column:
    """Which of ``tasks`` contiguous runs of near-equal size an index from 0 on falls into; the first take the remainder."""
    n = F.lit(n) if isinstance(n, int) else n
    size, extra = F.floor(n / tasks), n % tasks
    cut = extra * (size + 1)
    return F.when(index < cut, F.floor(index / (size + 1))).otherwise(extra + F.floor((index - cut) / F.greatest(size, F.lit(1)))).cast("long")
