"""Embedding near-duplicates by int8 tile products with rigorous error bounds.

Vectors are normalised in double precision and quantised to int8 with one scale each. For unit u and its
quantised form s*q the error e = u - s*q is known exactly, so
``|u.v - s t q.r| <= |e_u| |t r| + |e_v|`` holds for each pair (Cauchy-Schwarz). A tile of
vectors meets another as one integer matrix product; only pairs whose bound reaches the threshold are
computed again in double precision, and only those that reach it there link.

Equal vectors are grouped first and counted, so a vector with a million copies is one row of a
tile. Each pair of tiles is a group of bounded size that one task compares alone; it returns each vector's number of
links and as few links as span the components found there, never the list of pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.plans.components import components
from swarmtide.plans.workspace import Workspace

#: Distinct vectors of a tile.
TILE = 4096


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, their scales, and upper bounds on the length of each row's error."""
    scale = np.maximum(np.abs(unit).max(1, initial=0.0), 1e-300) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    error = np.linalg.norm(unit - q * scale[:, None], axis=1)
    return q, scale, error * (1 + 1e-9) + 1e-12


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of unit vectors with product >= threshold; each pair once if ``same``."""
    qa, sa, ea = quantise(a)
    qb, sb, eb = quantise(b)
    # sums of products of int8 stay below 2**24 up to 1040 dimensions, where float32 sums are exact; beyond, doubles are
    kind = np.float32 if a.shape[1] <= 1040 else np.float64
    right, length = qb.astype(kind).T, np.linalg.norm(qb * sb[:, None], axis=1)
    rows, cols = [], []
    for i in range(0, len(a), 256):
        near = qa[i : i + 256].astype(kind) @ right
        bound = near * sa[i : i + 256, None] * sb + ea[i : i + 256, None] * length + eb
        x, y = np.nonzero(bound >= threshold)
        x += i
        if same:
            x, y = x[x < y], y[x < y]
        exact = np.einsum("ij,ij->i", a[x], b[y])
        rows.append(x[exact >= threshold])
        cols.append(y[exact >= threshold])
    return np.concatenate(rows), np.concatenate(cols)


def _unit(values: pa.Array, width: int) -> np.ndarray:
    x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    x = x / np.abs(x).max(1, keepdims=True)  # neither squares nor their sum can overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that pairs (x, y) reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        new = np.minimum(new, new[new])
        new = np.minimum(new, new[root])
        if np.array_equal(new, root):
            return root
        root = new


def near_duplicates(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", threshold: float = 0.95, tile: int = TILE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Pairs link at cosine >= ``threshold`` (above 0) in double precision. Vectors that are null, empty, zero or hold null or non-finite
    components link with nothing; vectors of different lengths don't link with each other. Rows with
    one id count as vectors of their own. A null id is never the smallest of a component.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold lies above 0, up to 1")
    spark = df.sparkSession
    work = Workspace(spark, "embeddings")
    number = F.col(vector)
    if dict(df.dtypes)[vector] not in ("array<float>", "array<double>"):
        number = number.cast("array<double>")
    rows = df.select(F.col(vec_id).alias("id"), number.alias("v"))
    fine = (F.size("v") > 0) & F.exists("v", lambda x: x != 0)
    fine &= F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select("id", F.when(fine, F.transform("v", lambda x: F.when(x == 0, F.abs(x)).otherwise(x))).alias("v"))
    rows = work.keep(rows.withColumn("key", F.sha2(F.col("v").cast("string"), 256)))
    groups = rows.where(F.col("v").isNotNull()).groupBy("key")
    groups = work.keep(groups.agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("v").alias("v")))
    found = None
    for width in sorted(r.n for r in groups.select(F.size("v").alias("n")).distinct().collect()):
        links = _links(groups.where(F.size("v") == width), width, threshold, tile)
        found = links if found is None else found.union(links)
    if found is None:
        found = spark.createDataFrame([], "a string, b string, n bigint")
    found = work.keep(found)
    more = work.keep(found.groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("more")))
    roots = work.keep(components(spark, found.select("a", "b")))
    named = groups.join(more, "key", "left").join(roots, groups.key == roots.node, "left")
    named = named.select("key", "least", "copies", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("root", "key").alias("root"))
    named = work.keep(named)
    least = work.keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = work.keep(named.join(least, "root").select("key", (F.col("copies") - 1 + F.col("more")).alias("n_links"), "component_id"))
    component = F.coalesce("component_id", "id")
    return rows.select("id", "key").join(named, "key", "left").select(
        F.col("id").alias(vec_id),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.cast("long").alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _links(groups: DataFrame, width: int, threshold: float, tile: int) -> DataFrame:
    """(a, b, n) over distinct vectors of one length: n, the copies of what links with a in a pair of tiles, and b, a
    vector that joins a to its component there."""
    tiles = max(1, -(-groups.count() // tile))
    dealt = groups.select("key", "copies", "v", F.pmod(F.xxhash64("key"), F.lit(tiles)).cast("int").alias("k"))
    # tiles stand in a ring; each meets itself and the half that follows it, so each two tiles meet once
    step, k = F.col("step"), F.col("k")
    first = F.struct(k.alias("t"), F.pmod(k + step, F.lit(tiles)).alias("u"), F.lit(0).alias("side"))
    second = F.struct(F.pmod(k - step, F.lit(tiles)).alias("t"), k.alias("u"), F.lit(1).alias("side"))
    sent = dealt.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(tiles // 2))))
    sent = sent.select("key", "copies", "v", "step", F.explode(F.when(step == 0, F.array(first)).otherwise(F.array(first, second))).alias("at"))
    sent = sent.where((step * 2 < tiles) | (F.col("at.t") < F.col("at.u")) | (step == 0))
    sent = sent.select("at.t", "at.u", "at.side", "key", "copies", "v")

    def meet(group: pa.Table) -> pa.Table:
        side = group.column("side").to_numpy()
        parts = [group.filter(pa.array(side == k)) for k in (0, 1)]
        same = parts[1].num_rows == 0 and group.column("t")[0].as_py() == group.column("u")[0].as_py()
        a = _unit(parts[0].column("v").combine_chunks(), width)
        b = a if same else _unit(parts[1].column("v").combine_chunks(), width)
        x, y = tile_links(a, b, threshold, same)
        y = y if same else y + len(a)
        whole = parts[0] if same else pa.concat_tables(parts)
        copies = whole.column("copies").to_numpy()
        n = np.zeros(len(copies), np.int64)
        np.add.at(n, x, copies[y])
        np.add.at(n, y, copies[x])
        root, hit = _roots(len(copies), x, y), np.flatnonzero(n)
        key = whole.column("key").combine_chunks()
        return pa.table({"a": key.take(pa.array(hit)), "b": key.take(pa.array(root[hit])), "n": pa.array(n[hit])})

    return sent.groupBy("t", "u").applyInArrow(meet, "a string, b string, n bigint")
