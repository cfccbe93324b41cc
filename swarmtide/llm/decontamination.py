"""Benchmark decontamination: block-max WAND over a BM25 index of test items.

Roles are turned round: the few test items are indexed, and every passage of every training text is a query.
An item's score is its BM25 sum over the terms that the passage holds, as a share of the least sum of a passage
that could be verified: if at most n of its shingles miss, at most n of its words do, and the worst case are its n heaviest. So the
threshold is 1 for every item, and no leak that verification would accept scores less. Passages are runs of twice the longest item's words that
overlap by half, so each run of an item's length lies in one.

Before postings are walked, all passages of a batch are bounded at once by block maxima: the best share of each rarer term
within each block of items, and each common term's best share anywhere. Only blocks that can reach 1 are walked.

Each retrieved item is then verified: the share of its five-word shingles that the passage holds, for the whole item,
its question (all but the last sentence) and its answer (the last sentence; of a single sentence, the last third). A part without
words has no overlap. An item of fewer words than a shingle is one shingle: down to a single word it is found wherever its words stand, so
leave out items that say nothing.

The index of up to ``SHARD_BYTES`` of items is broadcast; more items are indexed in shards of that size, one pass
over the texts each.
"""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmtide.llm.text import extended, mapped, slices
from swarmtide.plans.workspace import Workspace

SHARD_BYTES = 16 << 20
SIMILARITY = 0.8
SHINGLE = 5
K1, B = 1.2, 0.75
POSTINGS = 32
#: Items of a block, for bounds that are taken before the walk.
BLOCK = 4

_PLAIN = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, other ASCII but digits as blanks; split at blanks."""
    return (text or "").encode().translate(_PLAIN).split()


def shingles(w: list[bytes]) -> set[tuple[bytes, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


def _question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    parts = [w for w in map(words, re.split(r"(?<=[.!?])\s+", text)) if w]
    if len(parts) > 1:
        return [x for p in parts[:-1] for x in p], parts[-1]
    cut = len(parts[0]) - max(1, len(parts[0]) // 3)
    return parts[0][:cut], parts[0][cut:]


class Index:
    """Postings (item, share) by term, in order of items, with the best share of a term and of each block of postings."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY) -> None:
        self.similarity = similarity
        self.items = [(i, w, text) for i, text in items if (w := words(text))]
        self.checks = []
        bags = []
        for _, w, text in self.items:
            q, a = _question_and_answer(text)
            self.checks.append(tuple(map(shingles, (w, q, a))))
            bag: dict[bytes, int] = {}
            for t in w:
                bag[t] = bag.get(t, 0) + 1
            bags.append(bag)
        held: dict[bytes, int] = {}
        for bag in bags:
            for t in bag:
                held[t] = held.get(t, 0) + 1
        n = len(bags)
        mean = sum(len(w) for _, w, _ in self.items) / max(n, 1)
        self.number = {t: k for k, t in enumerate(held)}
        lists: list[list[tuple[int, float]]] = [[] for _ in held]
        for i, bag in enumerate(bags):
            size = len(self.items[i][1])
            part = {
                t: math.log(1 + (n - held[t] + 0.5) / (held[t] + 0.5)) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean))
                for t, f in bag.items()
            }
            lost = max(self._lost(self.checks[i][0], similarity), self._lost(self.checks[i][1], similarity) + self._lost(self.checks[i][2], similarity))
            # what a passage must score that holds enough of the shingles: those that miss take ``lost`` words along at most
            least = max(sum(sorted(part.values())[: len(part) - lost]), 1e-9 * sum(part.values()))
            for t, x in part.items():
                lists[self.number[t]].append((i, x / least))
        self.postings = [([i for i, _ in x], [s for _, s in x]) for x in lists]
        self.best = np.array([max(s) for _, s in self.postings] or [0.0])
        self.blocks = [[max(s[k : k + POSTINGS]) for k in range(0, len(s), POSTINGS)] for _, s in self.postings]
        self.longest = max([len(w) for _, w, _ in self.items], default=1)
        self._sizes = {len(next(iter(s))) for check in self.checks for s in check if s} - {SHINGLE}
        # block maxima as flat lists; a term in many items has one bound for all blocks
        self.common = np.array([len(x) * 8 > n for x in lists] or [False])
        block = [{} for _ in lists]
        for found, x in zip(block, lists):
            for i, share in x:
                found[i // BLOCK] = max(found.get(i // BLOCK, 0.0), share)
        block = [{} if many else found for found, many in zip(block, self.common)]
        self.block_n = np.array([len(x) for x in block] or [0])
        self.block_at = np.cumsum(self.block_n) - self.block_n
        self.block = np.array([b for x in block for b in x], np.int64)
        self.block_best = np.array([v for x in block for v in x.values()])

    @staticmethod
    def _lost(s: set[tuple[bytes, ...]], similarity: float) -> int:
        return int(len(s) * (1 - similarity) + 1e-9)

    def reach(self, terms: list[int], low: int, end: int) -> list[tuple[int, float]]:
        """(item, score) of items from ``low`` to before ``end`` that the passage's terms bring to 1: block-max WAND."""
        cursors = []
        for t in terms:
            k = self._first(t, 0, low) if self.postings[t][0][0] < low else 0
            if k < len(self.postings[t][0]) and self.postings[t][0][k] < end:
                cursors.append([self.postings[t][0][k], k, t])
        out = []
        while True:
            cursors = [c for c in cursors if c[0] < end]
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                bound += self.best[c[2]]
                if bound >= 1 - 1e-9:
                    pivot = k
                    break
            if pivot < 0:
                return out
            at = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            near = sum(self._block_best(c, at) for c in cursors[: pivot + 1])
            if near < 1 - 1e-9:
                # nothing up to the end of the first of these blocks, or the next term's item, can reach it
                to = min([self._block_end(c, at) + 1 for c in cursors[: pivot + 1]] + [c[0] for c in cursors[pivot + 1 :][:1]])
                to = max(to, at + 1)
            elif cursors[0][0] == at:
                share = sum(self.postings[t][1][k] for i, k, t in cursors[: pivot + 1])
                if share >= 1 - 1e-9:
                    out.append((at, share))
                to = at + 1
            else:
                to = at
            for c in cursors[: pivot + 1]:
                self._advance(c, to, end)

    def _first(self, t: int, k: int, item: int) -> int:
        """The first posting from k on whose item is ``item`` or later."""
        found = self.postings[t][0]
        step = 1
        while k + step < len(found) and found[k + step] < item:
            step *= 2
        low, high = k, min(len(found), k + step + 1)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if found[mid] < item else (low, mid)
        return low

    def _block_best(self, c: list[int], item: int) -> float:
        k = self._first(c[2], c[1], item)
        return self.blocks[c[2]][k // POSTINGS] if k < len(self.postings[c[2]][0]) else 0.0

    def _block_end(self, c: list[int], item: int) -> int:
        found = self.postings[c[2]][0]
        k = self._first(c[2], c[1], item)
        return found[min((k // POSTINGS + 1) * POSTINGS, len(found)) - 1] if k < len(found) else len(self.items)

    def _advance(self, c: list[int], item: int, end: int) -> None:
        if c[0] < item:
            found = self.postings[c[2]][0]
            c[1] = self._first(c[2], c[1], item)
            c[0] = found[c[1]] if c[1] < len(found) else end

    def _survivors(self, passage: np.ndarray, term: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Ranges of items, by passage, whose block maxima can reach 1."""
        many = len(self.items) // BLOCK + 1
        base = np.bincount(passage, np.where(self.common[term], self.best[term], 0.0))
        n = self.block_n[term]
        at = np.repeat(self.block_at[term] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        pairs, back = np.unique(np.repeat(passage, n) * many + self.block[at], return_inverse=True)
        fits = np.bincount(back, self.block_best[at], len(pairs)) + base[pairs // many] >= 1 - 1e-9
        out: dict[int, list[tuple[int, int]]] = {}
        for p, b in zip((pairs[fits] // many).tolist(), (pairs[fits] % many).tolist()):
            out.setdefault(p, []).append((b * BLOCK, min((b + 1) * BLOCK, len(self.items))))
        return out | {p: [(0, len(self.items))] for p in np.flatnonzero(base >= 1 - 1e-9).tolist()}

    def leaks(self, texts: list[str | None]) -> list[tuple[int, int, int, float, float, float, float]]:
        """(text, item, first word of the passage, score, overlap, question's, answer's) of the best passage for each item found."""
        if not self.items:
            return []
        stride, many = self.longest, len(self.number)
        keys, whole, first = [], [], [0]
        for text in texts:
            w = words(text)
            whole.append(w)
            ids = np.array(list(map(self.number.get, w, repeat(-1))), np.int64)
            at = np.flatnonzero(ids >= 0)
            run, ids = at // stride + first[-1], ids[at]
            # a run of words belongs to the passage that it opens and to the one before
            keys += [run * many + ids, ((run - 1) * many + ids)[run > first[-1]]]
            first.append(first[-1] + len(w) // stride + 1)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        if not len(key):
            return []
        passage, term = key // many, key % many
        out: dict[tuple[int, int], tuple[int, int, int, float, float, float, float]] = {}
        for p, ranges in self._survivors(passage, term).items():
            i, j = np.searchsorted(passage, [p, p + 1])
            terms = term[i:j].tolist()
            found = [x for low, end in ranges for x in self.reach(terms, low, end)]
            if not found:
                continue
            text = bisect.bisect_right(first, p) - 1
            begin = (p - first[text]) * stride
            run = whole[text][begin : begin + 2 * stride]
            have = shingles(run).union(*(zip(*(run[k:] for k in range(n))) for n in self._sizes))
            for item, score in found:
                overlap, question, answer = (len(s & have) / len(s) if s else 0.0 for s in self.checks[item])
                if overlap >= self.similarity or (question >= self.similarity and answer >= self.similarity):
                    if (text, item) not in out or out[text, item][4] < overlap:
                        out[text, item] = text, item, begin, score, overlap, question, answer
        return list(out.values())


def leaks(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """(doc_id, item_id, passage, score, overlap, question_overlap, answer_overlap): a row for each row of ``docs`` and each item found in it.

    Null and empty texts hold no item, null and empty items and items without an id are in no text; items of one text are found each under
    its own id. Documents with a null id are searched and reported with it.
    """
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out = None
    for index in _indexes(docs.sparkSession, items, item_id, item_text, similarity, shard_bytes):
        found = _search(source, index)
        out = found if out is None else out.union(found)
    return out.withColumnsRenamed({"doc_id": doc_id, "item_id": item_id})


def _indexes(spark: SparkSession, items: DataFrame, item_id: str, item_text: str, similarity: float, shard_bytes: int) -> Iterator[Broadcast]:
    """Broadcast indexes of shards of items, each of about ``shard_bytes`` of text."""
    work = Workspace(spark, "benchmark")
    known = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("x"))
    known = known.where("i is not null and x is not null").distinct()
    size = known.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    shards = -(-size // shard_bytes) or 1
    known = work.keep(known.withColumn("s", F.pmod(F.xxhash64("i", "x"), F.lit(shards))))
    for s in range(shards):
        yield spark.sparkContext.broadcast(Index([(r.i, r.x) for r in known.where(F.col("s") == s).orderBy("i", "x").collect()], similarity))


def _search(source: DataFrame, index: Broadcast) -> DataFrame:
    names = ["item_id", "passage", "score", "overlap", "question_overlap", "answer_overlap"]
    schema = extended(source, ["doc_id"], "item_id bigint, passage bigint, score double, overlap double, question_overlap double, answer_overlap double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = index.value
        for batch in batches:
            for part in slices(batch, 1):
                found = at.leaks(part.column(1).to_pylist())
                rows = part.column(0).take(pa.array([x[0] for x in found], pa.int64()))
                ids = pa.array([at.items[x[1]][0] for x in found], pa.int64())
                rest = [pa.array([x[2] for x in found], pa.int64()), *(pa.array([x[k] for x in found], pa.float64()) for k in (3, 4, 5, 6))]
                yield pa.RecordBatch.from_arrays([rows, ids, *rest], names=["doc_id", *names])

    return source.mapInArrow(run, schema)


def clean(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    similarity: float = SIMILARITY,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns, found as ``leaks`` finds them."""
    at = docs.columns.index(text)
    for index in _indexes(docs.sparkSession, items, item_id, item_text, similarity, shard_bytes):

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, at):
                    fine = np.ones(len(part), bool)
                    fine[[x[0] for x in index.value.leaks(part.column(at).to_pylist())]] = False
                    yield part.filter(pa.array(fine))

        docs = mapped(docs, docs.columns, run, docs.schema)
    return docs
