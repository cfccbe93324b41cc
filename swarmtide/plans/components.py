"""Connected components of a link table, without collecting links anywhere.

Two contractions alternate until nothing changes: each node hangs its larger neighbours on its
smallest neighbour, then hangs its smaller neighbours there too. Both keep components as they are
and halve distances, so some tens of rounds do for any graph. Minima are pre-aggregated before each shuffle and
written, so that the join with them stands on two plain exchanges and adaptive execution may split
a node that has very many links.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmtide.plans.workspace import Workspace


def _upward(work: Workspace, links: DataFrame) -> DataFrame:
    """Of links (a > b): each node's larger neighbours go to the minimum of node and neighbours."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = work.keep(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
    out = work.keep(links.select(F.col("b").alias("a"), F.col("a").alias("b")).join(least, "a").select("b", "m").toDF("a", "b").distinct())
    work.drop(least)
    return out


def _downward(work: Workspace, links: DataFrame) -> DataFrame:
    """Of links (a > b): a node and its smaller neighbours go to the smallest of these."""
    least = work.keep(links.groupBy("a").agg(F.min("b").alias("m")))
    moved = links.join(least, "a").where("b > m").select("b", "m").toDF("a", "b")
    out = work.keep(moved.union(least.toDF("a", "b")).distinct())
    work.drop(least)
    return out


def components(spark: SparkSession, links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links``: two columns of one ordered type.

    ``root`` is the smallest node within reach. Nulls and self-links are ignored, an empty table gives
    an empty table. Raises if ``most_rounds`` do not suffice.
    """
    work = Workspace(spark, "components")
    a, b = (F.col(f"`{c}`") for c in links.columns[:2])
    now = work.keep(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct())
    state = None
    for _ in range(most_rounds):
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if seen == state:
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        state = seen
        up = _upward(work, now)
        down = _downward(work, up)
        work.drop(now, up)
        now = down
    raise RuntimeError(f"components not found in {most_rounds} rounds")
