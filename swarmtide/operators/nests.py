"""Hierarchies of tracks: depth, ancestors, detached children, extended centrals, traps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.plans.workspace import Workspace


def ancestors(nests: DataFrame, most_levels: int = 100) -> DataFrame:
    """(child, ancestor, level) of links (child, parent): all ancestors, nearest at level 1. Raises on a cycle or a deeper tree.

    Paths double in each round, so a tree of depth d takes log2(d) joins.
    """
    work = Workspace(nests.sparkSession, "ancestors")
    known = work.keep(nests.select("child", F.col("parent").alias("ancestor"), F.lit(1).cast("long").alias("level")))
    reach = 1
    while True:
        far = known.where(F.col("level") == reach)
        if far.isEmpty():
            return known
        if reach > most_levels:
            raise ValueError("links form a cycle, or a tree deeper than allowed")
        # from the ancestors at the farthest level on, their own ancestors continue the path
        upper = known.select(F.col("child").alias("ancestor"), F.col("ancestor").alias("__a"), F.col("level").alias("__l"))
        more = far.join(upper, "ancestor").select("child", F.col("__a").alias("ancestor"), (F.col("level") + F.col("__l")).alias("level"))
        known = work.keep(known.union(more))
        reach *= 2


def depth(tracks: DataFrame, nests: DataFrame) -> DataFrame:
    """(track, depth): 0 for tracks without a parent."""
    levels = ancestors(nests).groupBy("child").agg(F.max("level").alias("depth"))
    return tracks.join(levels, F.col("track") == F.col("child"), "left").select("track", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"))


def detached(nests: DataFrame, tracks: DataFrame) -> DataFrame:
    """Children whose host differs from their parent's, or who became heads (``head``): their links go, and they lead their own nest.

    ``tracks``: (track, host, head). Returns links (child, parent, detached).
    """
    child = tracks.select(F.col("track").alias("child"), F.col("host").alias("__hc"), F.col("head").alias("__head"))
    parent = tracks.select(F.col("track").alias("parent"), F.col("host").alias("__hp"))
    out = (F.col("__hc") != F.col("__hp")) | F.col("__head")
    return nests.join(child, "child").join(parent, "parent").select("child", "parent", out.alias("detached"))


def extend_central(nests: DataFrame, heads: DataFrame) -> DataFrame:
    """Links after each host's other heads became children of its central, which first leaves its own parent.

    ``heads``: (host, track, place), place 0 is the central.
    """
    central = heads.where("place = 0").select("host", F.col("track").alias("parent"))
    promoted = nests.join(central.select(F.col("parent").alias("child")), "child", "left_anti")
    new = heads.where("place > 0").join(central, "host").select(F.col("track").alias("child"), "parent")
    return promoted.select("child", "parent").unionByName(new)


def sinks(chain: DataFrame, distances: DataFrame, most: float = 2.0) -> DataFrame:
    """(child, sink): the nearest ancestor within sink distance ``most``. ``distances``: (child, ancestor, distance) of ancestors that count."""
    found = chain.join(distances, ["child", "ancestor"]).where(F.col("distance") < most)
    return found.groupBy("child").agg(F.min_by("ancestor", "level").alias("sink"))
