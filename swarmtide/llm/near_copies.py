"""Near-duplicates by SimHash and by a prefix filter on shingles, verified by exact shingle similarity.

*Candidates.* Fingerprints of five-word shingles that differ in up to three of 64 bits meet by ``simhash.link`` (pigeonhole blocks). That finds
copies with very few changes only: at similarity 0.8 about 10 bits differ. So each text also files its shingles with the smallest
hashes, as many as it may lose at that similarity and one more: of two sets with a Jaccard similarity of 0.8 or more, these
prefixes always have a shingle in common, whatever else they share with other texts. Under each key a breadth-first search over
all its texts joins what a 256-bit SimHash puts within ``SPREAD`` standard deviations of the similarity (texts of up to ``FEW`` shingles
carry them and are compared by these); each text is reached once, and no pairs are listed. Keys of more than ``CROWD`` texts are
split by numbers of shingles, which similar texts have alike, and then into tiles that meet two by two: nothing is left out.

*Verification.* Every similar pair lies inside a component of candidates. The texts of a component come together, each once, and a
breadth-first search over their whole shingle sets links what has the similarity, and nothing below it. Components of more than
``TOGETHER`` bytes of text are verified under their keys instead, split like these.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.llm import simhash
from swarmtide.llm.hashing import mixed, runs, strings
from swarmtide.llm.text import Words, pieces
from swarmtide.plans.components import components
from swarmtide.plans.workspace import Workspace

#: Texts of a key that one search takes.
CROWD = 4096
#: Distinct shingles of a text that it carries along.
FEW = 80
WIDE = 4
#: Standard deviations by which an estimate may miss the similarity: one similar pair in some millions is farther off.
SPREAD = 5.0
#: Bytes of text of a component that one task verifies.
TOGETHER = 32 << 20
_U = np.uint64


def most_bits(similarity: float) -> int:
    """Hamming distance of 256-bit fingerprints up to which two texts may have a Jaccard similarity of shingles."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(64 * WIDE * p + SPREAD * math.sqrt(64 * WIDE * p * (1 - p)))


def shingle_hashes(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles, text by text, and how many each text has (fewer words: one of all of them; none: none)."""
    n = np.diff(words.first)
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), many)
    head = words.first[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    return runs(strings(words.joined, words.start, words.end), head, np.minimum(size, n[text]), size), many


def wide(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``WIDE`` words of fingerprint for each text."""
    out = np.zeros((len(many), WIDE), np.uint64)
    some = np.flatnonzero(many)
    starts = (np.cumsum(many) - many)[some]
    for k in range(WIDE if len(some) else 0):
        g = mixed(h + _U((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        bits = np.unpackbits(g.view(np.uint8).reshape(-1, 8), axis=1)
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some, k] = np.packbits(2 * ones > many[some, None], axis=1).view(np.uint64)[:, 0]
    return out


def distinct(h: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in order, text by text, and how many it has."""
    text = np.repeat(np.arange(len(many)), many)
    order = np.lexsort((h, text))
    h, text = h[order], text[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(many))


def prefixes(h: np.ndarray, m: np.ndarray, similarity: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of each text's distinct hashes the smallest, of which similar texts share one; and all if they are few."""
    most = np.where(m > 0, m - np.ceil(similarity * m - 1e-9).astype(np.int64) + 1, 0)
    begin = (np.cumsum(m) - m).tolist()
    least, few = ([h[i : i + k].view(np.int64) for i, k in zip(begin, sizes.tolist())] for sizes in (most, np.where(m <= FEW, m, 0)))
    return least, few


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _texts(df: DataFrame, text: str) -> tuple:
    """Columns of a row's text (null as empty) and its hash."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return t.alias("t"), F.xxhash64(t).alias("h")


def marked(df: DataFrame, doc_id: str, text: str, size: int, similarity: float) -> DataFrame:
    """(id, h, node, fp, w, m, few, keys) of each row; h: a hash of the text, node: the same, 0 without words, m: number of distinct shingles, few: these if they are few."""
    rows = df.select(F.col(f"`{doc_id}`").alias("id"), *_texts(df, text))
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, raw, at in pieces(batch.column(1)):
                words = Words(raw, at)
                h, many = shingle_hashes(words, size)
                w = pa.ListArray.from_arrays(pa.array(np.arange(0, WIDE * len(many) + 1, WIDE, dtype=np.int32)), pa.array(wide(h, many).view(np.int64).ravel()))
                own, m = distinct(h, many)
                least, few = prefixes(own, m, similarity)
                fp = pa.array(simhash.of_words(words, size).view(np.int64))
                ids, hashes = (batch.column(k).slice(part.start, len(many)) for k in (0, 2))
                node = pa.array(np.where(m > 0, hashes.to_numpy(), 0))
                yield pa.RecordBatch.from_arrays([ids, hashes, node, fp, w, pa.array(m), _lists(few), _lists(least)], names=["id", "h", "node", "fp", "w", "m", "few", "keys"])

    return rows.select("id", "t", "h").mapInArrow(run, f"id {kind}, h bigint, node bigint, fp bigint, w array<bigint>, m bigint, few array<bigint>, keys array<bigint>")


class Sketches:
    """Rows (node, w, few) in hand."""

    def __init__(self, rows: pa.Table, similarity: float) -> None:
        self.node = rows["node"].to_numpy()
        self.w = rows["w"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDE).view(np.uint64)
        few = rows["few"].combine_chunks()
        self.few, self.ends = few.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(few.value_lengths().to_numpy(zero_copy_only=False))])
        self.n = np.diff(self.ends)
        self.similarity, self.most = similarity, most_bits(similarity)
        self.sets: dict[int, frozenset] = {}

    def _set(self, k: int) -> frozenset:
        if k not in self.sets:
            self.sets[k] = frozenset(self.few[self.ends[k] : self.ends[k + 1]].tolist())
        return self.sets[k]

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """By the shingles where both texts carry them, else by the fingerprints, widely."""
        a, b = np.broadcast_arrays(a, b)
        near = np.bitwise_count(self.w[a] ^ self.w[b]).sum(axis=1, dtype=np.int64) <= self.most
        n, n2 = self.n[a], self.n[b]
        both = (n > 0) & (n2 > 0)
        alike = both & (np.minimum(n, n2) >= self.similarity * np.maximum(n, n2) - 1e-9)
        near &= ~both
        for k in np.flatnonzero(alike).tolist():
            x, y = self._set(int(a[k])), self._set(int(b[k]))
            same = len(x & y)
            near[k] = same >= self.similarity * (len(x) + len(y) - same) - 1e-9
        return near


class Sets:
    """Texts (node, t) in hand, as whole shingle sets."""

    def __init__(self, rows: pa.Table, similarity: float, size: int) -> None:
        self.node, self.similarity = rows["node"].to_numpy(), similarity
        parts = [distinct(*shingle_hashes(Words(raw, at), size)) for _, raw, at in pieces(rows["t"].combine_chunks())]
        h = np.concatenate([np.zeros(0, np.uint64), *(x for x, _ in parts)])
        self.n = np.concatenate([np.zeros(0, np.int64), *(m for _, m in parts)])
        self.begin = np.cumsum(self.n) - self.n
        values, number = np.unique(h, return_inverse=True)
        self.number, self.mark = number, np.full(len(values), -1)

    def _spread(self, texts: np.ndarray) -> np.ndarray:
        """Numbers of the shingles of some texts, one text after the other."""
        n = self.n[texts]
        return self.number[np.repeat(self.begin[texts] - np.cumsum(n) + n, n) + np.arange(n.sum())]

    def similar(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Exactly; ``a`` is one text or runs of equal texts, one for each of ``b``."""
        a = np.broadcast_to(a, b.shape)
        n, n2 = self.n[a], self.n[b]
        near = (np.minimum(n, n2) > 0) & (np.minimum(n, n2) >= self.similarity * np.maximum(n, n2) - 1e-9)
        at = np.flatnonzero(near)
        # rounds over parts, so that working memory is bounded
        cut = np.searchsorted(np.cumsum(n2[at]), np.arange(1 << 21, n2[at].sum(), 1 << 21)) if len(at) else []
        for part in np.split(at, cut):
            edge = np.flatnonzero(a[part][1:] != a[part][:-1]) + 1
            for run in np.split(part, edge) if len(edge) < 64 else [part]:
                if not len(run):
                    continue
                if a[run[0]] == a[run[-1]]:
                    self.mark[self._spread(a[run[:1]])] = a[run[0]]
                    hit = self.mark[self._spread(b[run])] == a[run[0]]
                else:
                    pairs = np.unique(a[run], return_inverse=True)
                    own = np.repeat(np.arange(len(pairs[0])), self.n[pairs[0]]) * len(self.mark) + self._spread(pairs[0])
                    own.sort()
                    want = np.repeat(pairs[1], n2[run]) * len(self.mark) + self._spread(b[run])
                    place = np.minimum(np.searchsorted(own, want), len(own) - 1)
                    hit = own[place] == want
                same = np.add.reduceat(hit.astype(np.int64), np.cumsum(n2[run]) - n2[run])
                near[run] = same >= self.similarity * (n[run] + n2[run] - same) - 1e-9
        return near


def spanning(similar: Callable[[np.ndarray, np.ndarray], np.ndarray], group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join what is similar within runs of equal groups, each text reached once."""
    start = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(start, len(group)))
    first, every = np.repeat(start, size), np.arange(len(group))
    near = first == every
    near[~near] = similar(first[~near], every[~near])
    yield first[near], every[near]
    # runs of more than two where the first text does not reach all
    rest = size - np.add.reduceat(near.astype(np.int64), start)
    for i, n in zip(start[(rest > 0) & (size > 2)].tolist(), size[(rest > 0) & (size > 2)].tolist()):
        run = np.arange(i, i + n)
        front, left = run[near[i : i + n]][1:], run[~near[i : i + n]]
        while len(left):
            if not len(front):
                front, left = left[:1], left[1:]
            here, front = front[:1], front[1:]
            found = similar(here, left)
            if found.any():
                yield np.repeat(here, found.sum()), left[found]
                front, left = np.concatenate([front, left[found]]), left[~found]


def _searched(rows: DataFrame, names: list[str], reader: Callable[[pa.Table], Sketches | Sets]) -> DataFrame:
    """Links (a, b) within the groups of ``names``, which are of bounded size. Rows of one node are one text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(rows: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            texts = reader(rows)
            pairs = [np.concatenate(x) for x in zip(*spanning(texts.similar, group))]
            a, b = texts.node[pairs[0]], texts.node[pairs[1]]
            pair = np.unique(np.stack([a, b], 1)[a != b], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], names=["a", "b"])

        held = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            now = (now if held is None else pa.concat_tables([held, now])).combine_chunks()
            if not now.num_rows:
                continue
            columns = [now[c].to_numpy() for c in names]
            edge = np.concatenate([[True], np.any([x[1:] != x[:-1] for x in columns], axis=0)])
            cut = int(np.flatnonzero(edge)[-1])
            if cut:
                yield from links(now.slice(0, cut).combine_chunks(), np.cumsum(edge[:cut]))
            held = now.slice(cut)
        if held is not None and held.num_rows:
            yield from links(held.combine_chunks(), np.zeros(held.num_rows, np.int64))

    return rows.repartition(*names).sortWithinPartitions(*names, "node").mapInArrow(run, "a bigint, b bigint")


def _under_keys(work: Workspace, filed: DataFrame, payload: DataFrame, columns: list[str], reader, similarity: float, crowd: int) -> DataFrame:
    """Links within the keys of ``filed`` (key, node, n), n: the texts of the key. ``payload``: (node, m, *columns)."""
    rows = work.keep(filed.join(payload, "node"))
    found = _searched(rows.where(F.col("n") <= crowd).select("key", "node", *columns), ["key"], reader)
    if rows.where(F.col("n") > crowd).take(1):
        # texts whose numbers of shingles differ by no more than the similarity allows share a band
        band = F.floor(F.log("m") / F.lit(-math.log(similarity) + 1e-9))
        banded = rows.where(F.col("n") > crowd).select("key", F.explode(F.array(band, band + 1)).alias("band"), "node", *columns)
        parts = work.keep(banded.groupBy("key", "band").agg(F.ceil(F.count("*") / F.lit(crowd)).alias("parts")))
        tile = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
        tiled = banded.join(parts, ["key", "band"]).withColumn("tile", tile)
        tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        tiled = tiled.select("key", "band", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "node", *columns)
        found = found.union(_searched(tiled, ["key", "band", "i", "j"], reader))
    found = work.keep(found.distinct())
    work.drop(rows)
    return found


def _filed(work: Workspace, texts: DataFrame) -> DataFrame:
    """(key, node, n) of the keys that several texts share."""
    filed = texts.select(F.explode(F.array_distinct("keys")).alias("key"), "node")
    sizes = filed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    return work.keep(filed.join(work.keep(sizes), "key"))


def links(work: Workspace, df: DataFrame, docs: DataFrame, text: str, size: int, similarity: float, crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """Links (a, b) between nodes of ``docs`` (as ``marked`` gives them of ``df``) that span the components of similar texts, exactly."""
    spark = df.sparkSession
    texts = work.keep(docs.where("m > 0").select("node", "fp", "w", "m", "few", "keys").dropDuplicates(["node"]))
    filed = _filed(work, texts)
    near = _under_keys(work, filed, texts.select("node", "m", "w", "few"), ["w", "few"], lambda rows: Sketches(rows, similarity), similarity, crowd)
    # texts of one 64-bit fingerprint, and of fingerprints within three bits
    least = work.keep(texts.groupBy("fp").agg(F.min("node").alias("least")))
    same = texts.join(least, "fp").where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    bits = simhash.link(work, least.select("fp")).join(least.toDF("a", "x"), "a").join(least.toDF("b", "y"), "b").select("x", "y")
    maybe = work.keep(components(spark, near.union(same).union(bits)))
    found = df.select(*_texts(df, text)).join(maybe, F.col("h") == F.col("node")).select("node", "root", "t").dropDuplicates(["node"])
    found = work.keep(found)
    sizes = work.keep(found.groupBy("root").agg(F.sum(F.octet_length("t")).alias("bytes")).where(F.col("bytes") > together))
    exact = lambda rows: Sets(rows, similarity, size)
    if not sizes.take(1):
        linked = work.keep(_searched(found, ["root"], exact))
        work.drop(filed, texts, found, maybe, near)
        return linked
    linked = _searched(found.join(sizes, "root", "left_anti"), ["root"], exact)
    large = work.keep(found.join(sizes, "root", "left_semi").select("node", "t").join(texts.select("node", "m"), "node"))
    per_text = work.keep(large.agg(F.max(F.octet_length("t")).alias("b"))).first().b
    return work.keep(linked.union(_under_keys(work, filed.join(large, "node", "left_semi"), large, ["t"], exact, similarity, max(2, min(crowd, 2 * together // max(per_text, 1))))))


def keep_one(df: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 5, similarity: float = 0.8, crowd: int = CROWD, together: int = TOGETHER) -> DataFrame:
    """The rows of ``df`` with the smallest id of their component; columns as they are.

    Texts link at a Jaccard similarity of their sets of ``size``-word shingles of ``similarity`` or more (A-Z lower-cased; fewer words: one shingle
    of all of them). Of rows that share that id the one with the smallest hash of its text stays. Rows with a null id stay where no row with an id is
    in their component, one for each text. Texts without words, null texts included, are copies of one another. Columns whose names begin with ``__near_`` are not allowed.
    """
    spark = df.sparkSession
    work = Workspace(spark, "near-copies")
    docs = work.keep(marked(df, doc_id, text, size, similarity))
    roots = work.keep(components(spark, links(work, df, docs, text, size, similarity, crowd, together)))
    nodes = docs.groupBy("node").agg(F.min("id").alias("least"))
    named = nodes.join(roots.toDF("n", "root"), F.col("node") == F.col("n"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = work.keep(named)
    least = work.keep(named.groupBy("root").agg(F.min("least").alias("component_id")))
    named = work.keep(named.join(least, "root").select("node", "component_id"))
    rank = F.struct(F.col("id").isNull(), "id", "h")
    placed = docs.select("id", "h", "node").join(named, "node")
    stays = placed.groupBy(F.coalesce("component_id", "node").alias("c"), F.col("component_id").isNull().alias("nameless"))
    stays = work.keep(stays.agg(F.min(rank).alias("r")).select(F.col("r.id").alias("__near_id"), F.col("r.h").alias("__near_kept")).distinct())
    rows = df.withColumn("__near_h", F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    kept = rows.join(stays, F.col(f"`{doc_id}`").eqNullSafe(F.col("__near_id")) & (F.col("__near_h") == F.col("__near_kept")), "left_semi")
    # rows equal in id and text are one document
    if docs.groupBy("id", "h").count().where("count > 1").take(1):
        kept = kept.dropDuplicates([doc_id, "__near_h"])
    return kept.drop("__near_h")
