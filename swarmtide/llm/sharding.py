"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

Rows lie in source partitions, by hash. How many rows each partition sends to each shard is drawn first: the counts of a
uniform permutation follow a multivariate hypergeometric law, and drawing them row by row, each partition from
what the shards still have room for, gives a matrix whose row sums are the partitions' counts and
whose column sums are the shards' sizes. Then each partition permutes its rows and deals them out
by its row of the matrix; each shard permutes what it received. Shard sizes are exact: at most
one apart.

Both permutations rank rows by a keyed hash within parts of bounded size (a shard's order is cut by ranges of
the hash, with exact offsets), so no task ever holds a shard. All of it is DataFrame expressions; the
driver sees one count per partition and draws the matrix from them.

A row lost with its executor is computed again alike: places depend on the rows and the seed only.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from swarmtide.plans.workspace import Workspace

#: Rows of a source partition, and of a part of a shard's order, that are aimed at.
PART_ROWS = 50_000
#: Source partitions at most: the matrix that is broadcast has this many rows times shards. Above it, parts grow.
MOST_PARTS = 4_096


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard, as a uniform permutation would send them."""
    total = int(counts.sum())
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for i, n in enumerate(counts.tolist()):
        if n:
            out[i] = rng.multivariate_hypergeometric(room, n, method="marginals")
            room -= out[i]
    return out


def _part(h: Column, parts: int) -> Column:
    """Which of ``parts`` equal ranges of the 64-bit hash: ranges, so that parts are in the order of the hash."""
    return F.least(F.floor((h.cast("double") / 2.0**64 + 0.5) * parts), F.lit(parts - 1)).cast("int")


def shuffle(df: DataFrame, shards: int, identity: list[str], seed: int = 17, part_rows: int = PART_ROWS) -> DataFrame:
    """Adds ``shard`` (int) and ``slot`` (long, gapless from 0 in each shard), replacing columns of these names.

    ``identity``: the columns that tell rows apart; rows that agree in them are dealt like others, in any
    order among themselves. Nulls there are values like others. Of n rows each shard gets n // shards or
    one more; with fewer rows than shards some stay empty, and an empty table gives an empty one.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    spark = df.sparkSession
    work = Workspace(spark, "sharding")
    kept = [F.col(f"`{c}`") for c in df.columns if c not in ("shard", "slot")]
    ids = [F.col(f"`{c}`") for c in identity]
    # rows that agree in their identity are told apart by the place they are read from, which only orders them
    rows = df.select(F.struct(*kept).alias("row"), *(F.xxhash64(F.lit(f"{seed}/{k}"), *ids).alias(f"h{k}") for k in (0, 1, 2)))
    rows = work.keep(rows)
    total = rows.count()
    parts = max(1, min(MOST_PARTS, -(-total // part_rows)))
    rows = rows.select("row", "h1", "h2", _part(F.col("h0"), parts).alias("p"))
    counts = np.zeros(parts, np.int64)
    for r in rows.groupBy("p").count().collect():
        counts[r.p] = r["count"]
    matrix = communication_matrix(counts, shards, seed)
    ends = np.cumsum(matrix, 1)
    dealt = spark.createDataFrame(
        [(i, ends[i].tolist()) for i in range(parts)], "p int, ends array<bigint>"
    )  # parts x shards numbers, bounded by MOST_PARTS
    local = Window.partitionBy("p").orderBy("h1", "h2")
    placed = rows.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(dealt), "p")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank"))).cast("int")
    sub = max(1, min(MOST_PARTS, -(-total // (shards * part_rows))))
    placed = work.keep(placed.select("row", "h2", "h1", shard.alias("shard"), _part(F.col("h2"), sub).alias("q")))
    sizes = placed.groupBy("shard", "q").count()
    before = Window.partitionBy("shard").orderBy("q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "q", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "q").orderBy("h2", "h1")
    ranked = placed.withColumn("rank", F.row_number().over(within) - 1)
    out = ranked.join(F.broadcast(offsets), ["shard", "q"])  # shards x parts numbers, bounded by MOST_PARTS
    return out.select("row.*", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))
