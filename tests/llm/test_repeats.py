import hashlib
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from swarmtide.llm import repeats


def brute(rows, length=100):
    """rows: (order, raw bytes). Per row: bytes, removed, spans, hash of what is left."""
    seen, out = {}, {}
    for order, raw in sorted(set(rows)):
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = [True] * length
            else:
                seen[s] = 1
        rest = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[order, raw] = (len(raw), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (12, 19, 25, 40, 60)]
    texts = ["", None, "short", "a" * 99, "a" * 100, "a" * 350, "ab" * 200, prose(30), passages[4], passages[4]]
    for _ in range(60):
        parts = [prose(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 4)):
            p = rng.choice(passages)
            i, j = sorted(rng.randrange(len(p)) for _ in range(2))
            parts += [rng.choice([p, p[i:], p[:j], p[i:j]]), prose(rng.randrange(0, 6))]
        texts.append("".join(parts))
    for _ in range(12):  # near copies
        words = texts[7 + rng.randrange(40)] or "x"
        words = words.split(" ")
        words[rng.randrange(len(words))] = "edited"
        texts.append(" ".join(words))
    rng.shuffle(texts)
    return texts


def check(spark, rows, want_order, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("doc", F.lit(3)).withColumn("n_spans", F.lit(4)).withColumn("a.b", F.lit(5)).repartition(3)
    got = repeats.remove(df, **how).collect()
    want = brute([(want_order(i, (t or "").encode()), (t or "").encode()) for i, t in rows])
    byrow = sorted(((r.doc_id is not None, r.doc_id or 0), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert byrow == sorted(((i is not None, i or 0), *want[want_order(i, (t or "").encode()), (t or "").encode()]) for i, t in rows)
    for r in got:
        assert len(r.text.encode()) <= r.n_bytes - r.n_removed


def test_bytes_match_brute_force(spark):
    for seed in (1, 2):
        rows = [(1000 - 7 * i, t) for i, t in enumerate(corpus(seed))]
        check(spark, rows, lambda i, raw: (i,))


def test_small_pieces_and_batches(spark, monkeypatch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 5)
    try:
        rows = [(3 * i, t) for i, t in enumerate(corpus(3))]
        check(spark, rows, lambda i, raw: (i,))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_null_and_repeated_ids(spark):
    texts = corpus(4)[:30]
    rows = [(None if i % 9 == 0 else i // 2, t) for i, t in enumerate(texts)] + [(3, texts[7])] * 2 + [(50, texts[6])] * 3
    check(spark, rows, lambda i, raw: (i is not None, i or 0, hashlib.sha256(raw).hexdigest()))


def test_whole_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    check(spark, [tuple(r) for r in docs.collect()], lambda i, raw: (i,))


def test_empty(spark):
    assert repeats.remove(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_crowded_triggers_are_split(spark, monkeypatch):
    rows = [(1000 - 7 * i, t) for i, t in enumerate(corpus(5) + corpus(5)[20:50])]
    check(spark, rows, lambda i, raw: (i,), crowd=1)
    check(spark, rows, lambda i, raw: (i,), crowd=4)


def test_phrases_hold_each_window_once():
    texts = [t.encode() for t in corpus(6) if t]
    at = np.cumsum([0, *map(len, texts)])
    text, lo, more, left, trigger, phrase = repeats.phrases(np.frombuffer(b"".join(texts), np.uint8), at)
    got = sorted((t, i) for t, a, n in zip(text.tolist(), lo.tolist(), more.tolist()) for i in range(a, a + n + 1))
    assert got == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - 99)]
    beside = {}
    for t, a, n, b, h, p in zip(*(x.tolist() for x in (text, lo, more, left, trigger, phrase))):
        assert beside.setdefault(p, texts[t][a : a + n + 100]) == texts[t][a : a + n + 100]
        for i in range(a, a + n + 1):  # equal windows have one trigger, at one place
            assert beside.setdefault(texts[t][i : i + 100], (h, b + a - i)) == (h, b + a - i)


def test_suffixes_of_entries_in_small_groups(monkeypatch):
    """Chunks of whole groups, with an entry that comes several times, against windows in a set."""
    monkeypatch.setattr(repeats, "TOGETHER", 3)
    rng = random.Random(7)
    rows = []
    for key in range(12):
        trigger = bytes(rng.randrange(97, 99) for _ in range(32))
        for _ in range(rng.randrange(1, 9)):
            left, right = rng.randrange(0, 69), rng.randrange(0, 69)
            left = max(left, 68 - right)
            body = bytes(rng.choice(b"ab") for _ in range(left)) + trigger + bytes(rng.choice(b"ab") for _ in range(right))
            rows += [(key, hash(body), rng.randrange(5), 1000 * len(rows), left, body)] * rng.choice((1, 1, 2))
    rows.sort()
    schema = pa.schema([(c, pa.int64()) for c in ("key", "phrase", "doc", "lo", "left")] + [("body", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4]), schema.types)], schema=schema) for i in range(0, len(rows), 4)]
    got = {(d, i) for b in repeats._suffixes(iter(batches)) for d, a, z in zip(*(c.to_pylist() for c in b.columns)) for i in range(a, z)}
    seen, want = set(), set()
    for key, _, doc, lo, left, body in sorted(set(rows), key=lambda r: (r[2], r[3])):
        for i in range(len(body) - 99):
            window = (key, left - i, body[i : i + 100])
            if window in seen:
                want |= {(doc, lo + j) for j in range(i, i + 100)}
            seen.add(window)
    entries = {}
    for key, phrase, doc, lo, _, body in sorted(set(rows)):  # later occurrences of whole phrases are the dictionary's
        if entries.setdefault((key, phrase), (doc, lo)) != (doc, lo):
            want -= {(doc, lo + j) for j in range(len(body))}
    assert got == want


def test_query(spark):
    from swarmtide.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    want = {(i, *found) for (i, _), found in brute(rows).items()}
    got = QUERIES["op6_repeats"](spark, folder)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] and {tuple(r) for r in got.collect()} == want
