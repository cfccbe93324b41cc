"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint's 64 bits are cut into six blocks. Fingerprints that differ in up to three bits
share at least three whole blocks, so each is filed under the 20 choices of three blocks (keys of 31 to
33 bits) and compared under each key only.

No pair list is made. A key with two fingerprints is decided from its minimum and maximum alone;
larger groups go, sorted by key, through a breadth-first search that links each fingerprint it
reaches once (as many links as fingerprints, with the same components). Keys with more than
``CROWD`` fingerprints are filed again, by 56 choices of five of eight blocks of the remaining bits: what
then stays free are 12 or 13 bits, so no group outgrows 8,192 fingerprints, whatever the corpus.
Copies share a fingerprint and are grouped before any of this.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.llm.text import Words, extended, mapped, pieces
from swarmtide.plans.components import components
from swarmtide.plans.workspace import Workspace

#: First bit of each block, and the end.
BLOCKS = (0, 11, 22, 33, 44, 54, 64)
CHOICES = tuple(combinations(range(6), 3))
CROWD = 4096
SEED = 42


def of_words(words: Words, size: int) -> np.ndarray:
    """Fingerprint of each text from its shingles of ``size`` words, repeats included."""
    n = np.diff(words.first)
    shingles = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), shingles)
    head = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(shingles) - shingles, shingles)
    tail = np.minimum(head + size, words.first[1:][text]) - 1
    joined, digest = words.joined.tobytes(), xxhash.xxh64_intdigest
    spans = zip(words.start[head].tolist(), words.end[tail].tolist())
    h = np.fromiter((digest(joined[i:j], SEED) for i, j in spans), np.uint64, len(head))
    out = np.zeros(len(n), np.uint64)
    some = np.flatnonzero(shingles)
    if len(some):
        starts = (np.cumsum(shingles) - shingles)[some]
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), starts).astype(np.int64)
            out[some] |= (2 * ones > shingles[some]).astype(np.uint64) << np.uint64(bit)
    return out


def fingerprints(df: DataFrame, text: str = "text", size: int = 3) -> DataFrame:
    """Adds ``fingerprint`` (long, 64 bits), replacing a column of that name; null counts as empty, which gives 0."""
    kept = [c for c in df.columns if c != "fingerprint"]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, raw, ends in pieces(batch.column(at)):
                part = batch.slice(rows.start, rows.stop - rows.start)
                found = of_words(Words(raw, ends), size).view(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found)], names=[*kept, "fingerprint"])

    return mapped(df, kept, run, extended(df, kept, "fingerprint bigint"))


def _mask(blocks: list[tuple[int, int]]) -> int:
    value = sum(((1 << (j - i)) - 1) << i for i, j in blocks)
    return value - (1 << 64) if value >> 63 else value


def _halves(choice: tuple[int, ...]) -> list[int]:
    """Masks that split the blocks outside of ``choice`` into eight and choose five, with ``choice`` itself."""
    free = [b for k in range(6) if k not in choice for b in range(BLOCKS[k], BLOCKS[k + 1])]
    cuts = [free[len(free) * i // 8 : len(free) * (i + 1) // 8] for i in range(8)]
    base = [(BLOCKS[k], BLOCKS[k + 1]) for k in choice]
    return [_mask(base + [(b, b + 1) for i in five for b in cuts[i]]) for five in combinations(range(8), 5)]


def _filed(fps: DataFrame, masks: list[int]) -> DataFrame:
    """(mask, key, fp): each fingerprint under each mask."""
    keys = F.array(*(F.struct(F.lit(m).alias("mask"), F.col("fp").bitwiseAND(m).alias("key")) for m in masks))
    return fps.select(F.explode(keys).alias("k"), "fp").select("k.mask", "k.key", "fp")


def _spanning(fps: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Links that join what is within ``most`` bits, each fingerprint reached once."""
    left, out = fps.view(np.uint64), []
    while len(left) > 1:
        front, left = left[:1], left[1:]
        while len(front) and len(left):
            here, front = front[0], front[1:]
            near = np.bitwise_count(left ^ here) <= most
            if near.any():
                out += [(int(here), int(x)) for x in left[near]]
                front, left = np.concatenate([front, left[near]]), left[~near]
    return out


def _groups(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Links within the runs of equal (mask, key) of sorted rows."""
    held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

    def links(columns: list[np.ndarray]) -> pa.RecordBatch:
        mask, key, fp = columns
        edge = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
        found = [x for run in np.split(fp, edge) if len(run) > 1 for x in _spanning(np.unique(run), most)]
        pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    for batch in batches:
        now = [np.concatenate([old, col.to_numpy(zero_copy_only=False)]) for old, col in zip(held, batch.columns)]
        if len(now[0]) == 0:
            continue
        whole = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = int(whole[-1]) + 1 if len(whole) else 0
        if cut:
            yield links([x[:cut] for x in now])
        held = [x[cut:] for x in now]
    if len(held[0]):
        yield links(held)


def _links(filed: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """Links under the wanted keys."""
    rows = filed.join(wanted.select("mask", "key"), ["mask", "key"]).select("mask", "key", "fp")
    rows = rows.repartition("mask", "key").sortWithinPartitions("mask", "key")
    return rows.mapInArrow(lambda batches: _groups(batches, most), "a bigint, b bigint")


def link(work: Workspace, fps: DataFrame, most: int = 3, crowd: int = CROWD) -> DataFrame:
    """Links (a, b) that span the components of distinct fingerprints ``fp`` at up to ``most`` (0 to 3) bits."""
    if not 0 <= most <= 3:
        raise ValueError("blocks are made for up to three differing bits")
    masks = [_mask([(BLOCKS[k], BLOCKS[k + 1]) for k in c]) for c in CHOICES]
    fps = work.keep(fps.select("fp"))
    filed = _filed(fps, masks)
    sizes = filed.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    sizes = work.keep(sizes.where("n > 1"))
    two = sizes.where(F.col("n") == 2).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")
    found = two.union(_links(filed, sizes.where((F.col("n") > 2) & (F.col("n") <= crowd)), most))
    crowded = sizes.where(F.col("n") > crowd)
    if crowded.take(1):
        held = work.keep(filed.join(crowded.select("mask", "key"), ["mask", "key"]).select("mask", "fp"))
        for mask, choice in zip(masks, CHOICES):
            again = _filed(held.where(F.col("mask") == mask).select("fp"), _halves(choice))
            shared = again.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
            found = found.union(_links(again, shared, most))
    return work.keep(found.distinct())


def _components(work: Workspace, docs: DataFrame, most: int, crowd: int) -> DataFrame:
    """(fp, component_id) of documents (id, fp)."""
    spark = docs.sparkSession
    fps = work.keep(docs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = work.keep(components(spark, link(work, fps, most, crowd)))
    named = fps.join(roots, fps.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = work.keep(named)
    least = work.keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    return work.keep(named.join(least, "root").select("fp", "component_id"))


def _marked(df: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(id, fp) of each row."""
    docs = fingerprints(df.select(F.col(doc_id).alias("id"), F.col(text).alias("t")), "t", size)
    return docs.select("id", F.col("fingerprint").alias("fp"))


def near_duplicates(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 3, most: int = 3, crowd: int = CROWD
) -> DataFrame:
    """(doc_id, fingerprint as 16 hex digits, component_id) for every row.

    ``component_id`` is the smallest id that links reach, the row's own included. Rows with the same id each get a row; texts
    without words, null texts included, have fingerprint zero and link like any other. Rows with a null id get a
    fingerprint, and the smallest id of what they link with (null if there is none).
    """
    work = Workspace(df.sparkSession, "simhash")
    docs = work.keep(_marked(df, doc_id, text, size))
    named = _components(work, docs, most, crowd)
    return docs.join(named, "fp").select(
        F.col("id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )

