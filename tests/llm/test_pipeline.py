"""The pipeline against plain versions of its stages."""

import hashlib

import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from swarmtide.llm import bpe, decontamination, toxicity
from swarmtide.llm.queries import PATTERN, RANKS
from tests.llm.test_near_copies import plain_kept

DIR = "/root/testdata/sf0.001"


def cut(rows, length=100):
    seen, out = set(), {}
    for k, t in sorted(rows.items()):
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            if s in seen:
                gone[i : i + length] = b"\1" * length
            else:
                seen.add(s)
        out[k] = bytes(b for b, g in zip(raw, gone) if not g).decode(errors="ignore")
    return out


def test_pipeline_matches_plain_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = toxicity.fit(docs, labels)
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    rows = {k: t for k, t in rows.items() if model.probability(model.evidence(toxicity.tokens(t))) < 0.3}
    rows = {k: rows[k] for k in plain_kept(sorted(rows.items()))[0]}
    left = cut(rows)
    rows = {k: t for k, t in left.items() if t or not rows[k]}
    items = [set(decontamination.shingles(decontamination.words(r.text))) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    leaky = lambda t: any(len(s & have) >= 0.8 * len(s) for have in [decontamination.shingles(decontamination.words(t))] for s in items)
    rows = {k: t for k, t in rows.items() if not leaky(t)}
    plain = tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DIR).collect()}
    assert got.keys() == rows.keys()
    for k, t in rows.items():
        ids = plain.encode_ordinary(t)
        assert got[k].text == t and got[k].n_tokens == len(ids) and got[k].n_chars == len(t)
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_stages_keep_columns_and_stand_nulls(spark):
    rows = [(1, None, "en", "s", None), (2, "", "en", "s", 0), (None, "a b c d e f", None, None, 11), (4, "a b c d e f", "en", "s", 11), (4, "a b c d e f", "en", "s", 11)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for df in (docs, docs.limit(0)):
            out = stage(spark, df, DIR)
            out.collect()
            assert k == 4 or out.columns == docs.columns


def test_stages_leave_clashing_columns(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(40)
    names = ["score", "predicted", "passages", "n_removed", "n_bytes", "kept_sha256", "id", "fp", "a.b", "row"]
    wide = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:4]:
        for r in stage(spark, wide, DIR).collect():
            assert all(r[n] == f"{n}{r.doc_id}" for n in names)
