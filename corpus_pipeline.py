"""Corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, tokenizer round trip.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes and reads again
for the next. All but the last return the columns of ``documents``. ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmtide.llm import bpe, decontamination, near_copies, repeats, toxicity
from swarmtide.llm.queries import PATTERN, RANKS
from swarmtide.plans.workspace import Workspace, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; it learns from the labels of documents in hand."""
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    train = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = toxicity.fit(docs.select("doc_id", "text"), train)
    rows = docs.select("text", F.struct("*").alias("row"))  # so no column of the documents meets one of the score
    return toxicity.score(rows, model).where("predicted = 0").select("row.*")


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates (five-word shingles, similarity 0.8) the document with the smallest id stays."""
    return near_copies.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that occur earlier are cut out; documents of which no character is left go."""
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")
    left = repeats.remove(docs.select("doc_id", "text", others))
    left = left.where((F.col("n_removed") == 0) | (F.length("text") > 0))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("row.n_chars")).cast("long")
    cut = {"text": F.col("text"), "n_chars": n_chars}
    return left.select(*(cut.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is kept; ``text`` is what the ids decode to."""
    return bpe.round_trip(docs, RANKS, PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", keep_one_of_near_copies),
    ("suffix-array dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("byte-level bpe", encode_and_decode),
]

#: The stages learn, hash and tokenise; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage writes for itself is freed once its result is written."""
    work = Workspace(spark, "pipeline")
    docs = _table(spark, sf_dir, "documents")
    before = None
    for _, stage in STAGES:
        with scratch():
            docs = work.keep(stage(spark, docs, sf_dir))
        if before is not None:
            work.drop(before)
        before = docs
    return docs
