"""Queries of this folder's operators over whole tables, by name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmtide.llm import (
    bpe,
    decontamination,
    embeddings,
    html_text,
    repeats,
    sharding,
    simhash,
    suffix_tree_lm,
    token_files,
    toxicity,
)
from swarmtide.plans.workspace import Workspace

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _crc(column: str = "doc_id"):
    return F.crc32(F.col(column).cast("string").cast("binary"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(_crc() % 10 == 0, F.lit(False))
    out = suffix_tree_lm.score(docs, suffix_tree_lm.fit(docs.where(~held_out))).withColumn("held_out", held_out)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{Workspace(spark, 'token-files').root}/flat"
    token_files.write(_table(spark, sf_dir, "documents"), folder, RANKS, PATTERN)
    return token_files.count(spark, folder).select("doc_no", "start", "n_tokens", "closed")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("binary")
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 16
    docs = _table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(b""))).alias("text_crc32"))
    out = sharding.shuffle(docs, 40, ["doc_id", "text_crc32", "size"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove(docs, keep_text=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.leaks(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, RANKS, PATTERN).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "html")).select("page_id", "text")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    train = labels.where(_crc() % 4 != 2)
    model = toxicity.fit(docs, train)
    out = toxicity.score(docs, model).withColumn("held_out", F.coalesce(_crc() % 4 == 2, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted", "n_passages")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_simhash": op1_simhash,
    "op2_suffix_tree": op2_suffix_tree,
    "op3_embeddings": op3_embeddings,
    "op4_token_counts": op4_token_counts,
    "op5_sharding": op5_sharding,
    "op6_repeats": op6_repeats,
    "op7_decontamination": op7_decontamination,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_html_text": op9_html_text,
    "op10_toxicity": op10_toxicity,
}
ORACLES: dict[str, str] = {
    "op3_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
        l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.95),
        c AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT l.a, c.root FROM c JOIN l ON l.b = c.vec_id),
        r AS (SELECT vec_id, min(root) AS component_id FROM c GROUP BY vec_id), n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
        SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM r LEFT JOIN n USING (vec_id)""",
}
