"""Toxic passages: maximum-scoring segments of token log-odds, judged as extreme values.

*Weights.* Of a bounded sample of labelled documents, toxic and clean ones that hold a token are counted. A
token's weight is its log-odds ratio under a Dirichlet prior in proportion to its share of all
labelled documents, taken ``DOUBT`` standard errors towards zero; tokens of clean documents weigh below zero. Tokens without a
weight cost ``DRIFT`` each, which other weights hold already; a token that repeats the one before it has no weight above zero. Tokens of fewer than ``LEAST`` sampled documents have none: the
table is bounded by the sample, whatever the corpus size.

*Segments.* Each token adds its weight, each other token costs the drift. All maximal segments are found in
time linear in the tokens: a stack of candidate segments with the sums before and after them, merged while a later one
tops an earlier one; each links to the nearest one before it that began lower, and where there is none all so far are final.

*Calibration.* The best segment of n clean tokens exceeds S with probability 1 - exp(-K n exp(-lambda S)). Lambda and K are those
under which the best segments of the sampled clean documents are likeliest (documents without a segment count as below
zero), each document scored by weights of the sample without its own part of ``PARTS``. A passage is
significant at ``LEVEL`` of that. A logistic curve over the sum of the significant passages' excess, with the same
weights over all sampled documents, gives the score.

Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swarmtide.llm.text import extended, mapped, slices
from swarmtide.plans.workspace import Workspace

LEAST = 3
DOUBT = 2.0
PRIOR = 50.0
DRIFT = 0.1
LEVEL = 0.05
BINS = 48
PARTS = 8
#: Sums of log-odds have a lambda of one where tokens are independent: this many best segments are taken to have said so.
NATURAL = 30.0
#: Labelled rows that a model is fitted on, at most: some hundred kilobytes of ids and labels are broadcast.
MOST_ROWS = 40_000

_PLAIN = bytes(c + 32 if 65 <= c < 91 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def tokens(text: str | None) -> list[bytes]:
    """ASCII letters lower-cased, other ASCII but digits as blanks; split at blanks."""
    return (text or "").encode().translate(_PLAIN).split()


class Model:
    """Token weights, extreme-value parameters and the logistic curve."""

    def __init__(self, weights: dict[bytes, float], rate: float, scale: float) -> None:
        self.weights, self.rate, self.scale = weights, rate, scale
        self.slope, self.base = 1.0, -1.0

    def passages(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        """(sum, first, last + 1) of each maximal segment, left to right."""
        get = self.weights.get
        done: list[tuple[float, int, int]] = []
        found: list[tuple[float, float, int, int, int]] = []  # sum before, sum with, first, last + 1, link
        total = last = 0.0
        for i, x in enumerate(map(get, words)):
            if x is None or (x > 0 and i and words[i] == words[i - 1]):  # said again at once is said once
                continue
            total -= DRIFT * (i - last)
            last = i + 1
            if x <= 0:
                total += x
                continue
            low, first, k = total, i, len(found) - 1
            total += x
            while True:
                while k >= 0 and found[k][0] >= low:
                    k = found[k][4]
                if k < 0:  # nothing that follows can join what there is
                    done += [(b - a, p, q) for a, b, p, q, _ in found]
                    found = [(low, total, first, i + 1, -1)]
                    break
                if found[k][1] >= total:
                    found.append((low, total, first, i + 1, k))
                    break
                low, _, first, _, before = found[k]
                del found[k:]
                k = before
        return done + [(b - a, p, q) for a, b, p, q, _ in found]

    def excess(self, s: float, n: int) -> float:
        """-ln of the expected number of passages this good among n clean tokens."""
        return self.rate * s - math.log(self.scale * max(n, 1))

    def significant(self, words: list[bytes]) -> list[tuple[float, int, int]]:
        least = -math.log(-math.log1p(-LEVEL))
        return [(e, i, j) for s, i, j in self.passages(words) if (e := self.excess(s, len(words))) >= least]

    def evidence(self, words: list[bytes]) -> float:
        return sum(e for e, _, _ in self.significant(words))

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.base + self.slope * math.log1p(evidence)))))


def _weight(y1: Column, y0: Column, toxic: int, clean: int) -> Column:
    """A token's weight by the toxic and clean documents that hold it."""
    a = (y1 + y0) * (PRIOR / max(toxic + clean, 1)) + 1e-9
    others = [n + PRIOR + 0.5 - y - a for n, y in ((toxic, y1), (clean, y0))]  # half a document: a token of all is no certainty
    odds = F.log((y1 + a) / others[0]) - F.log((y0 + a) / others[1])
    sure = F.abs(odds) - DOUBT * F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    return F.when((y1 + y0 >= LEAST) & (sure > 0), F.signum(odds) * sure - DRIFT).otherwise(0.0)


def extreme_value(best: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """lambda and K under which the best sums of texts of n tokens are likeliest; sums of zero stand for all below."""
    positive = best > 0
    if not positive.any():
        return 1.0, 1.0 / max(float(n.sum()), 1.0)

    def scale(rate: float) -> float:
        return positive.sum() / float((n * np.exp(-rate * best)).sum())

    def likelihood(rate: float) -> float:
        known = NATURAL * (math.log(rate) - rate)
        return known + positive.sum() * (math.log(rate) + math.log(scale(rate)) - 1) - rate * float(best[positive].sum())

    low, high = math.log(1e-3), math.log(50.0)
    for _ in range(80):  # golden section
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if likelihood(math.exp(a)) > likelihood(math.exp(b)) else (a, high)
    rate = math.exp((low + high) / 2)
    return rate, scale(rate)


def _logistic(bins: list[tuple[float, int, int]]) -> tuple[float, float]:
    """Slope and base of a logistic curve over (log1p evidence, clean, toxic), by Newton steps with a weak prior.

    The loss is convex, and steps are halved until it falls by enough: full steps can swing to and fro between curves that are
    flat wherever texts lie, which ends in a slope near zero and no text marked.
    """
    x = np.array([b[0] for b in bins] or [0.0])
    zero, one = (np.array([b[k] for b in bins] or [1.0], float) for k in (1, 2))
    design = np.stack([np.ones_like(x), x], 1)

    def loss(at: np.ndarray) -> float:
        t = design @ at
        return float(zero @ np.logaddexp(0, t) + one @ np.logaddexp(0, -t) + 0.5e-2 * (at @ at))

    at = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -500, 500)))
        slope = design.T @ (one - (zero + one) * p) - 1e-2 * at
        curve = (design * ((zero + one) * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        gain, now = float(slope @ step), loss(at)
        while np.abs(step).max() >= 1e-9 and loss(at + step) > now - 1e-4 * gain:
            step, gain = step / 2, gain / 2
        if np.abs(step).max() < 1e-9:
            break
        at += step
    return float(max(at[1], 1e-3)), float(at[0])


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_rows: int = MOST_ROWS
) -> Model:
    """Learns from up to ``most_rows`` labelled rows, those whose ids have the smallest hashes.

    Rows with a null label or id are left out, of several labels for an id the largest counts. Without toxic or clean rows the
    model has no weights and gives every text one score, below the threshold.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "toxicity")
    known = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.max("y").alias("y"))
    taken = work.keep(known.orderBy(F.xxhash64("id"), "id").limit(most_rows))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("t")).join(F.broadcast(taken), "id")
    rows = work.keep(rows.select((F.col("y") > 0).cast("int").alias("y"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(PARTS)).cast("int").alias("part"), "t"))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, list[bytes]]]:
        for batch in batches:
            for part in slices(batch, 2):
                for y, own, t in zip(*(part.column(k).to_pylist() for k in range(3))):
                    yield y, own, tokens(t)

    names = ["token", "n"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by token: clean and toxic ones of each part. No token is empty: that row counts all documents."""
        seen: dict[bytes, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.list_(pa.int64()))]
            seen.clear()
            return pa.RecordBatch.from_arrays(out, names=names)

        for y, own, words in labelled(batches):
            for word in {*words, b""}:
                seen.setdefault(word, [0] * (2 * PARTS))[2 * own + y] += 1
            if len(seen) > 200_000:
                yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "token binary, n array<bigint>").groupBy("token")
    counts = work.keep(counts.agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(2 * PARTS))))
    size = counts.where(F.octet_length("token") == 0).drop("token").first() or [0] * (2 * PARTS)
    toxic, clean = sum(size[1::2]), sum(size[::2])
    model = Model({}, 1.0, 1.0)
    if not (toxic and clean):
        model.base = -4.0
        work.drop(rows, counts, taken)
        return model
    y0, y1 = (reduce(add, (F.col(f"n{2 * k + y}") for k in range(PARTS))) for y in (0, 1))
    weights = [_weight(y1 - F.col(f"n{2 * k + 1}"), y0 - F.col(f"n{2 * k}"), toxic - size[2 * k + 1], clean - size[2 * k]) for k in range(PARTS)]
    weights.append(_weight(y1, y0, toxic, clean))
    used = counts.where((y0 + y1 >= LEAST) & (F.octet_length("token") > 0)).select("token", F.array(*weights).alias("w")).where(F.exists("w", lambda w: w != 0))
    tables: list[dict[bytes, float]] = [{} for _ in weights]
    for token, found in used.collect():
        for table, w in zip(tables, found):
            if w:
                table[bytes(token)] = w
    model.weights = tables.pop()
    others = [Model(table, 1.0, 1.0) for table in tables]  # each part is scored by what the others taught

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for y, own, words in labelled(batches):
            if not y:
                top = max((s for s, _, _ in others[own].passages(words)), default=0.0)
                yield pa.RecordBatch.from_arrays([pa.array([top]), pa.array([len(words)])], names=["best", "n"])

    clean = rows.mapInArrow(best, "best double, n bigint").toArrow()  # two numbers for each of up to most_rows rows
    model.rate, model.scale = extreme_value(clean.column(0).to_numpy(), clean.column(1).to_numpy())
    for other in others:
        other.rate, other.scale = model.rate, model.scale

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for y, own, words in labelled(batches):
            seen[min(BINS, round(8 * math.log1p(others[own].evidence(words)))), y] += 1
        yield pa.RecordBatch.from_pylist([{"bin": b, "y": y, "n": n} for (b, y), n in seen.items()], schema=pa.schema([("bin", pa.int32()), ("y", pa.int32()), ("n", pa.int64())]))

    table = Counter()
    for r in rows.mapInArrow(binned, "bin int, y int, n bigint").groupBy("bin", "y").agg(F.sum("n").alias("n")).collect():
        table[r.bin, r.y] += r.n
    model.slope, model.base = _logistic([(b / 8, table[b, 0], table[b, 1]) for b in sorted({b for b, _ in table})])
    work.drop(rows, counts, taken)
    return model


def score(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on), ``n_passages`` and ``passages``.

    ``passages``: (start, stop, excess) in tokens of each significant passage. These names replace
    columns of the same name. A null or empty text has no passage and gets the score of one without.
    """
    new = {"score": "double", "predicted": "int", "n_passages": "int", "passages": "array<struct<start:int,stop:int,excess:double>>"}
    kept = [c for c in docs.columns if c not in new]
    schema = extended(docs, kept, ", ".join(f"{name} {kind}" for name, kind in new.items()))
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("excess", pa.float64())]))
        for batch in batches:
            for part in slices(batch, at):
                found = [model.significant(tokens(t)) for t in part.column(at).to_pylist()]
                scores = [model.probability(sum(e for e, _, _ in x)) for x in found]
                columns = [
                    pa.array(scores, pa.float64()),
                    pa.array([int(s >= threshold) for s in scores], pa.int32()),
                    pa.array([len(x) for x in found], pa.int32()),
                    pa.array([[{"start": i, "stop": j, "excess": e} for e, i, j in x] for x in found], kind),
                ]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*kept, *new])

    return mapped(docs, kept, run, schema)
