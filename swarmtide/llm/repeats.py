"""Removal of byte strings that occur earlier in the corpus, by prefix-free parsing.

*Parse.* Each window of ``LENGTH`` bytes is given to the trigger in it: the ``KMER`` bytes with the least rolling hash (the leftmost of
equal ones), which the window's own bytes decide. A phrase is the run of windows that one trigger holds, from the start of the
first to the end of the last. So phrases of a text overlap by ``LENGTH`` - 1 bytes, each window lies in exactly one phrase, and no phrase's
suffix of that length begins another: equal windows lie at equal places beside equal triggers. The parse of a text is the
sequence of its phrases, with their places.

*Dictionary.* Occurrences are ordered by phrase, document and place (phrases by two 64-bit hashes, which is all that equality needs). All but the first of a
phrase's occurrences in the corpus are removed whole; copies, however many, cost one dictionary entry, found
without looking at single bytes. Repeats within one piece of text are settled where they are read, before anything is shuffled.

*Suffixes.* Windows of different entries can be equal only where their triggers are. Entries of such triggers come together, and the suffix array of
their group is built: suffixes that begin at triggers are sorted by their bytes, with the lengths of common prefixes of
neighbours; suffixes that begin before a trigger are ordered by the bytes up to it (sorted too, backwards) and the trigger's
suffix. Runs of suffixes with a common prefix of ``LENGTH`` are equal windows. Phrases overlap by so much that such a prefix never leaves its
entry, so dictionary and parse combine simply: within a run the corpus order is the order of first
places in the parse, and all but the first of a run are removed.

Which triggers begin several entries is known from the dictionary; a bit table tells the second reading which
phrases to bring along, and what it brings in vain falls out as having one entry only. Groups of more than ``CROWD`` phrases
(what stands at the edges of very common passages) are split: their phrases are cut into runs of windows, which are grouped
by all bytes that the windows of a run have in common; what is crowded still is cut again, down to single windows (``RUNS``).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swarmtide.llm.hashing import mixed, power, prefix, spans
from swarmtide.llm.text import extended, flat, mapped, pieces
from swarmtide.plans.ordering import numbered
from swarmtide.plans.workspace import Workspace

LENGTH = 100
KMER = 32
BEFORE = LENGTH - KMER
EXTENT = LENGTH + BEFORE
#: log2 of the bits of the table of triggers, at least and at most: 8 kB to 16 MB.
LEAST_BITS, MOST_BITS = 16, 27
#: Phrases that one group takes.
CROWD = 4096
#: Groups that are split, at most (their keys are broadcast): where there would be more, groups take a millionth of all phrases.
MOST_SPLIT = 1_000_000
#: Windows of a run, from split to split.
RUNS = (24, 6, 1)
#: Entries that are ordered at a time; a group is not cut.
TOGETHER = 8192

ROW = "key phrase doc lo left body"
ROW_TYPES = "key bigint, phrase bigint, doc bigint, lo bigint, left bigint, body binary"
_U = np.uint64
_PLACE = _U((1 << 30) - 1)


def _sliding(x: np.ndarray, size: int, f: np.ufunc) -> np.ndarray:
    """f over each run of ``size`` elements."""
    step = 1
    while step * 2 <= size:
        x = f(x[:-step], x[step:])
        step *= 2
    return f(x[: len(x) - (size - step)], x[size - step :]) if size > step else x


def phrases(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """[text, place of the first window, windows - 1, place of the trigger in it, trigger hash, phrase hash] of each phrase of some texts, in order."""
    n = len(raw)
    if n > int(_PLACE):
        raise ValueError("texts of a gibibyte are not handled")
    counts = np.maximum(np.diff(at) - (LENGTH - 1), 0)
    window = np.repeat(at[:-1] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
    if not len(window):
        return [np.zeros(0, np.int64)] * 6
    text = np.repeat(np.arange(len(counts)), counts)
    sums = prefix(raw, 0)
    h = mixed((sums[KMER:] - sums[:-KMER]) * power(0, n + 1)[1][: n - KMER + 1])
    least = _sliding((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), BEFORE + 1, np.minimum)
    held = (least[window] & _PLACE).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], (held[1:] != held[:-1]) | (text[1:] != text[:-1])]))
    lo, hi, held, text = window[first], window[np.append(first[1:], len(window)) - 1], held[first], text[first]
    phrase = spans(prefix(raw, 1), lo, hi + LENGTH, 1, n + 1)
    phrase = mixed(phrase + (held - lo).astype(np.uint64) * _U(0x9E3779B97F4A7C15) + (hi - lo).astype(np.uint64))
    trigger = mixed(h[held])  # least hashes are small; their first bits choose a place in a table
    return [text, lo - at[text], hi - lo, held - lo, trigger.view(np.int64), phrase.view(np.int64)]


def _parsed(raw: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """``phrases`` in dictionary order, and which of these occurred before in these texts."""
    found = phrases(raw, at)
    text, lo, _, _, trigger, phrase = found
    order = np.lexsort((lo, doc[text], phrase, trigger))
    text, lo, more, left, trigger, phrase = (x[order] for x in found)
    new = np.ones(len(order), bool)
    new[1:] = (trigger[1:] != trigger[:-1]) | (phrase[1:] != phrase[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0)) if len(new) else np.zeros(0, np.int64)
    return [text, lo, more, left, trigger, phrase], (doc[text] != doc[text[first]]) | (lo != lo[first])


def _read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    doc = batch.column(0).to_numpy(zero_copy_only=False)
    for rows, raw, at in pieces(batch.column(1)):
        yield doc[rows], raw, at


def _batch(names: str, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names.split())


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases that are the first of their piece; spot: place and number of windows."""
    for batch in batches:
        for doc, raw, at in _read(batch):
            (text, lo, more, _, trigger, phrase), again = _parsed(raw, at, doc)
            yield _batch("trigger phrase doc spot", trigger[~again], phrase[~again], doc[text[~again]], (lo << 7 | more)[~again])


def _dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of phrases in dictionary order: (doc, spot) of those that occurred before; (null, trigger) of each entry."""
    last = None
    for batch in batches:
        trigger, phrase, doc, spot = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        n = len(trigger)
        if not n:
            continue
        if last is None:
            last = (~trigger[0], phrase[0], doc[0], spot[0])
        ahead = [np.concatenate([[x], y]) for x, y in zip(last, (trigger, phrase, doc, spot))]
        new = np.concatenate([[True], (ahead[0][1:] != ahead[0][:-1]) | (ahead[1][1:] != ahead[1][:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(n + 1), 0))
        again = ((ahead[2] != ahead[2][first]) | (ahead[3] != ahead[3][first]))[1:]
        entries = trigger[new[1:]]
        yield _batch("doc spot", doc[again], spot[again])
        yield _batch("doc spot", pa.nulls(len(entries), pa.int64()), entries)
        last = (trigger[-1], phrase[-1], ahead[2][first[-1]], ahead[3][first[-1]])


def _spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Spans in the order given, each joined to the one before where it goes on from it."""
    if len(doc) == 0:
        return _batch("doc lo hi", doc.astype(np.int64), lo.astype(np.int64), hi.astype(np.int64))
    cut = np.ones(len(doc), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > hi[:-1]) | (lo[1:] < lo[:-1])
    i = np.flatnonzero(cut)
    return _batch("doc lo hi", doc[i], lo[i], np.maximum.reduceat(hi, i))


def _recut(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[pa.RecordBatch]:
    """Rows (key, phrase, doc, lo, left, body) cut into runs of windows whose places beside the trigger lie between multiples of ``run``.

    ``left`` below zero marks what was cut: -1 - the number of bytes before the run's common ones."""
    for batch in batches:
        for i in range(0, len(batch), 4096):
            part = batch.slice(i, 4096)
            key, _, doc, lo, left = (part.column(k).to_numpy(zero_copy_only=False) for k in range(5))
            raw, at = flat(part.column(5))
            left = np.where(left < 0, -1 - left, left)
            low, high = (left - (np.diff(at) - LENGTH)) // run, left // run  # places count backwards from the trigger
            many = high - low + 1
            of = np.repeat(np.arange(len(lo)), many)
            q = low[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
            far, close = np.minimum(left[of], run * q + run - 1), np.maximum((left - (np.diff(at) - LENGTH))[of], run * q)
            begin = at[of] + left[of] - far
            size, ahead = far - close + LENGTH, far - run * q
            common = spans(prefix(raw, 0), begin + ahead, begin + ahead + LENGTH - run + 1, 0, len(raw) + 1)
            new = mixed(common + mixed(key[of].view(np.uint64) + q.astype(np.uint64)))
            phrase = mixed(spans(prefix(raw, 1), begin, begin + size, 1, len(raw) + 1) + (ahead * run + far - close).astype(np.uint64))
            data = raw.tobytes()
            body = pa.array([data[a:b] for a, b in zip(begin.tolist(), (begin + size).tolist())], pa.binary())
            yield _batch(ROW, new.view(np.int64), phrase.view(np.int64), doc[of], lo[of] + left[of] - far, -1 - ahead, body)


def _bring(batches: Iterator[pa.RecordBatch], bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Phrases whose trigger is in the table; spans of phrases that occurred before in their piece, without key and body, ``left``: their end."""
    width = _U(64 - (len(bits) * 8).bit_length() + 1)
    for batch in batches:
        for doc, raw, at in _read(batch):
            (text, lo, more, left, trigger, phrase), again = _parsed(raw, at, doc)
            order = np.lexsort((lo[again], text[again]))
            old = _spans(text[again][order], lo[again][order], (lo + more)[again][order] + LENGTH)
            of, begin, end = (c.to_numpy() for c in old.columns)
            empty = pa.nulls(len(of), pa.int64())
            yield _batch(ROW, empty, empty, doc[of], begin, end, pa.nulls(len(of), pa.binary()))
            slot = trigger.view(np.uint64) >> width
            hit = np.flatnonzero(~again & ((bits[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1).astype(bool))
            base, data = (at[text] + lo)[hit], raw.tobytes()
            body = pa.array([data[i:j] for i, j in zip(base.tolist(), (base + more[hit] + LENGTH).tolist())], pa.binary())
            yield _batch(ROW, trigger[hit], phrase[hit], doc[text[hit]], lo[hit], left[hit], body)


def _sorted(rows: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of bytes within their groups, and the common prefix of each with the next in that order (-1 between groups)."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    words = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], group))
    same = rows[order[1:]] == rows[order[:-1]]
    common = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, np.where(group[order[1:]] == group[order[:-1]], common, -1)


def repeated(key: np.ndarray, doc: np.ndarray, lo: np.ndarray, left: np.ndarray, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, place) of the windows of some entries, sorted by key, that an entry of the same key holds earlier. ``left``: bytes before the trigger."""
    size = np.diff(at)
    n = len(size)
    # each entry in a row of its own, its trigger in one column
    laid = np.zeros((n, EXTENT), np.uint8)
    row = np.repeat(np.arange(n), size)
    laid[row, np.arange(len(raw)) - np.repeat(at[:-1] - (BEFORE - left), size)] = raw
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    after, common = _sorted(laid[:, BEFORE:], group)
    ahead, common_back = _sorted(laid[:, BEFORE - 1 :: -1], group)
    corpus = np.lexsort((lo, doc))
    docs, places = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ranks = [np.zeros(n, np.int64), np.zeros(n, np.int64)]
    for y in range(int(left.max(initial=-1)) + 1):
        here = corpus[(left[corpus] >= y) & ((left - y + LENGTH <= size)[corpus])]
        if not len(here):
            continue
        ranks[0][after[1:]] = np.cumsum(common < LENGTH - y)
        ranks[1][ahead[1:]] = np.cumsum(common_back < y)
        _, first = np.unique(ranks[1][here] * n + ranks[0][here], return_index=True)
        more = np.ones(len(here), bool)
        more[first] = False
        docs.append(doc[here[more]])
        places.append((lo + left)[here[more]] - y)
    return np.concatenate(docs), np.concatenate(places)


def _suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in order of (key, phrase, doc, lo): spans of windows that an earlier one of the key holds too."""
    held: list[pa.Table] = []
    last = None  # the first occurrence of the entry in hand

    def settle(rows: pa.Table) -> pa.RecordBatch:
        key, doc, lo, left = (rows[c].to_numpy() for c in ("key", "doc", "lo", "left"))
        raw, at = flat(rows["body"])
        doc, lo = repeated(key, doc, lo, np.where(left < 0, -1 - left, left), raw, at)
        order = np.lexsort((lo, doc))
        return _spans(doc[order], lo[order], lo[order] + LENGTH)

    for batch in batches:
        key, phrase, doc, lo, left = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(5))
        n = len(key)
        if not n:
            continue
        if last is None:
            last = (~key[0], phrase[0], doc[0], lo[0])
        ahead = [np.concatenate([[x], y]) for x, y in zip(last, (key, phrase, doc, lo))]
        new = np.concatenate([[True], (ahead[0][1:] != ahead[0][:-1]) | (ahead[1][1:] != ahead[1][:-1])])
        first = np.maximum.accumulate(np.where(new, np.arange(n + 1), 0))
        last = (key[-1], phrase[-1], ahead[2][first[-1]], ahead[3][first[-1]])
        # runs that occurred before go whole; whole phrases did so by the dictionary
        again = ((ahead[2] != ahead[2][first]) | (ahead[3] != ahead[3][first]))[1:] & (left < 0)
        if again.any():
            size = np.diff(flat(batch.column(5))[1])[again]
            yield _batch("doc lo hi", doc[again], lo[again], lo[again] + size)
        held.append(pa.Table.from_batches([batch]).filter(pa.array(new[1:])))
        if sum(t.num_rows for t in held) >= TOGETHER:
            rows = pa.concat_tables(held).combine_chunks()
            edge = np.flatnonzero(np.diff(rows["key"].to_numpy()) != 0)
            if len(edge):
                yield settle(rows.slice(0, edge[-1] + 1).combine_chunks())
                rows = rows.slice(edge[-1] + 1)
            held = [rows]
    if held and sum(t.num_rows for t in held):
        yield settle(pa.concat_tables(held).combine_chunks())


def _bit_table(several: DataFrame, bits: int) -> np.ndarray:
    """A bit for each value of a trigger's first ``bits`` bits. At most 2**bits / 64 rows reach the driver."""
    slot = F.shiftrightunsigned("trigger", 64 - bits)
    one = F.expr(f"shiftleft(1L, int(shiftrightunsigned(trigger, {64 - bits}) & 63))")
    words = several.groupBy(F.shiftright(slot, 6).cast("int").alias("w")).agg(F.bit_or(one).alias("v")).toArrow()
    table = np.zeros(1 << (bits - 6), np.int64)
    table[words.column("w").to_numpy()] = words.column("v").to_numpy()
    return table.view(np.uint8)


def _calm(work: Workspace, rows: DataFrame, crowd: int) -> Iterator[DataFrame]:
    """The rows in groups of up to ``crowd`` each, crowded ones cut; of single windows a group holds one entry only."""
    for run in RUNS:
        crowded = work.keep(rows.groupBy("key").count().where(F.col("count") > crowd).select("key"))
        if not crowded.take(1):
            break
        yield rows.join(F.broadcast(crowded), "key", "left_anti")  # a row in ``crowd`` at most
        hot = rows.join(F.broadcast(crowded), "key").select(*ROW.split())
        rows = work.keep(hot.mapInArrow(lambda batches, run=run: _recut(batches, run), ROW_TYPES))
    yield rows


def _keyed(df: DataFrame, doc_id: str) -> DataFrame:
    """Rows with ``__doc``, which orders documents: the id; where ids are null or repeated, numbers in the order of id and text."""
    ids = df.groupBy(F.col(f"`{doc_id}`").alias("i")).count().where("i is null or count > 1")
    if not ids.take(1):
        return df.withColumn("__doc", F.col(f"`{doc_id}`").cast("long"))
    marked = df.withColumn("__hash", F.sha2(F.coalesce("__text", F.lit(b"")), 256))
    ranks = numbered(marked.select(F.col(f"`{doc_id}`").alias("__i"), F.col("__hash").alias("__h")).distinct(), [F.col("__i").asc_nulls_first(), F.col("__h")], "__doc")
    return marked.join(ranks, F.col(f"`{doc_id}`").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h"))).drop("__i", "__h", "__hash")


def remove(df: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = True, crowd: int = CROWD) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` (long) and ``kept_sha256``, replacing columns of these names.

    Removes each byte that a string of ``LENGTH`` bytes covers which also starts earlier: in a document of a
    smaller id or earlier in the same document; strings never cross documents and are judged on the
    input. With ``keep_text`` the text is what is left, without characters that a cut went through. A null
    text is empty. Null ids come before all others; of rows with one id the one with the smaller SHA-256
    of its text comes first, and rows equal in both are one document and get the same result. Columns ``__text``, ``__doc``, ``__hash``, ``__i``, ``__h``,
    ``__lo`` and ``__hi`` are not allowed.
    """
    spark = df.sparkSession
    work = Workspace(spark, "repeats")
    new = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    kept = [c for c in df.columns if c not in new]
    whole = _keyed(df.select(*(f"`{c}`" for c in kept)).withColumn("__text", F.col(f"`{text}`").cast("binary")), doc_id)
    docs = whole.select("__doc", "__text")
    parsed = docs.mapInArrow(_parse, "trigger bigint, phrase bigint, doc bigint, spot bigint")
    ordered = parsed.repartition("trigger", "phrase").sortWithinPartitions("trigger", "phrase", "doc", "spot")
    found = work.keep(ordered.mapInArrow(_dictionary, "doc bigint, spot bigint"))
    several = work.keep(found.where("doc is null").groupBy(F.col("spot").alias("trigger")).agg(F.count("*").alias("n")).where("n > 1"))
    size = several.agg(F.count("*").alias("n"), F.sum("n").alias("entries")).first()
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(16 * size.n + 1))))
    shared = spark.sparkContext.broadcast(_bit_table(several, bits))
    brought = work.keep(docs.mapInArrow(lambda batches: _bring(batches, shared.value), ROW_TYPES))
    gone = brought.where("key is null").select("doc", "lo", F.col("left").alias("hi"))
    for rows in _calm(work, brought.where("key is not null"), max(crowd, (size.entries or 0) // MOST_SPLIT)):
        entries = rows.repartition("key").sortWithinPartitions("key", "phrase", "doc", "lo")
        gone = gone.union(entries.mapInArrow(_suffixes, "doc bigint, lo bigint, hi bigint"))
    begin = F.shiftright("spot", 7)
    old = found.where("doc is not null").select("doc", begin.alias("lo"), (begin + F.col("spot").bitwiseAND(127) + LENGTH).alias("hi"))
    gone = gone.union(old).groupBy(F.col("doc").alias("__doc")).agg(F.collect_list("lo").alias("__lo"), F.collect_list("hi").alias("__hi"))
    joined = whole.join(gone, "__doc", "left").select(*(f"`{c}`" for c in kept if c != text), "__text", "__lo", "__hi")
    return _cut(joined, df, kept, text, keep_text)


def _cut(joined: DataFrame, df: DataFrame, kept: list[str], text: str, keep_text: bool) -> DataFrame:
    others = [c for c in kept if c != text]
    names = others + [text] * keep_text
    schema = extended(df, names, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")
    is_text = dict(df.dtypes)[text] == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *head, texts, lows, highs = batch.columns
            rows, left = [], []
            for t, lo, hi in zip(texts, lows, highs):
                raw = np.frombuffer(t.as_buffer() or b"", np.uint8) if t.is_valid else np.zeros(0, np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                if lo.is_valid:
                    np.add.at(gone, np.maximum(lo.values.to_numpy(), 0), 1)
                    np.add.at(gone, np.minimum(hi.values.to_numpy(), len(raw)), -1)
                gone = np.cumsum(gone)[:-1] > 0
                rest = raw[~gone].tobytes()
                n_spans = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
                rows.append((len(raw), int(gone.sum()), n_spans, hashlib.sha256(rest).hexdigest()))
                left.append(rest.decode(errors="ignore") if is_text else rest)
            columns = list(zip(*rows)) or [[]] * 4
            columns = [pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))]
            if keep_text:
                head.append(pa.array(left, pa.string() if is_text else pa.binary()))
            yield pa.RecordBatch.from_arrays([*head, *columns], names=schema.names)

    return mapped(joined, joined.columns, run, schema)
