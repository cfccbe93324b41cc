"""Ranked membership of tracks in hosts, centrals, births, priority masks and unions of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmtide.plans.ordering import numbered


def member_rank(tracks: DataFrame, host: str, mass: str, tie: str) -> DataFrame:
    """Adds ``rank``: place by mass within the host, from 0; tracks of the field (host -1), which are most, all have 0 and are not sorted."""
    w = Window.partitionBy(host).orderBy(F.desc(mass), tie)
    field = F.col(host).eqNullSafe(-1)
    ranked = tracks.where(~field).withColumn("rank", (F.row_number().over(w) - 1).cast("long"))
    return ranked.unionByName(tracks.where(field).withColumn("rank", F.lit(0).cast("long")))


def decide_central(members: DataFrame, host: str, ratio: float = 0.8) -> DataFrame:
    """Adds ``place``: ``rank``, with place 0 swapped for the kinematically closest of the members with ``ratio`` of the largest mass.

    Needs ``rank``, ``mass`` and ``kdist``. Of equally close candidates the one ranked first wins.
    """
    w = Window.partitionBy(host)
    top = F.max("mass").over(w)
    candidate = F.col("mass") >= ratio * top
    win = F.min(F.when(candidate, F.struct("kdist", "rank"))).over(w)["rank"]
    rank = F.col("rank")
    return members.withColumn("place", F.when(rank == win, 0).when(rank == 0, win).otherwise(rank).cast("long"))


def births(halos: DataFrame, members: DataFrame, host: str) -> DataFrame:
    """Halos without a member track: each starts one."""
    return halos.join(members.select(F.col(host).alias("halo_id")).distinct(), "halo_id", "left_anti")


def track_ids(new: DataFrame, old: int) -> DataFrame:
    """Numbers births with more than one bound particle after all existing tracks, in order of their halos."""
    return numbered(new.where("nbound > 1"), ["halo_id"], "track_id", old)


def running_max(tracks: DataFrame, track: str, time: str, value: str) -> DataFrame:
    """Adds the largest value so far and the latest time at which it was reached."""
    w = Window.partitionBy(track).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    best = F.max(F.struct(F.col(value).alias("v"), F.col(time).alias("t"))).over(w)
    return tracks.withColumn("last_max", best["v"]).withColumn("at_last_max", best["t"])


def last_isolation(tracks: DataFrame, track: str, time: str, rank: str) -> DataFrame:
    """Adds the latest time so far at which the track was a central, or -1."""
    w = Window.partitionBy(track).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    found = F.max(F.when(F.col(rank) == 0, F.col(time))).over(w)
    return tracks.withColumn("last_isolation", F.coalesce(found, F.lit(-1)).cast("long"))


def priority_mask(lists: DataFrame, host: str, visit: str, orphan: Column) -> DataFrame:
    """Each (host, id) stays in the list that is visited first, once; lists of orphans neither claim nor lose."""
    w = Window.partitionBy(host, "id").orderBy(visit, "ord")
    claimed = lists.where(~orphan).withColumn("__c", F.row_number().over(w)).where("__c = 1").drop("__c")
    return claimed.unionByName(lists.where(orphan))


def purge_most_bound(lists: DataFrame, host: str, track: str) -> DataFrame:
    """(host, track, most_bound_id): from small to large, the first particle that no smaller track of the host has; null if none."""
    size = lists.withColumn("__n", F.count("*").over(Window.partitionBy(host, track)))
    small = F.min(F.struct("__n", track)).over(Window.partitionBy(host, "id"))
    mine = small == F.struct("__n", track)
    return size.withColumn("__m", mine).groupBy(host, track).agg(F.min(F.when(F.col("__m"), F.struct("ord", "id")))["id"].alias("most_bound_id"))


def merge_union(lists: DataFrame, host: str) -> DataFrame:
    """Union by id of lists that merge into a host: of an id the first in (``prio``, ``ord``) stays; ``ord`` is renumbered."""
    first = F.row_number().over(Window.partitionBy(host, "id").orderBy("prio", "ord"))
    kept = lists.withColumn("__c", first).where("__c = 1").drop("__c")
    place = F.row_number().over(Window.partitionBy(host).orderBy("prio", "ord", "id"))
    return kept.withColumn("ord", (place - 1).cast("long"))
