"""Token counts of documents in flat token files without an index.

A token file is a run of fixed-width ids; an end-of-document id closes each document. The scan searches
blocks of a file for that id as vectors, and a prefix scan stitches what crosses boundaries: the number of
tokens before a block and the end of the last document before it give each document's
start, whether it began in this block, an earlier one or an earlier file. Within a file the prefix scan is a
cumulative sum over blocks; over files it is a window in groups of ``GROUP`` files and one over the
groups' totals.

Files are read by Spark's binary source, one row per file, from any store it knows; write them in
shards of some hundred megabytes (the source's limit is 2 GB). ``write`` makes such files with
Spark's own writer, whose commit survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmtide.llm.bpe import Codec
from swarmtide.llm.text import pieces

#: Big-endian 16-bit ids, and an end-of-document id beyond the vocabularies: its bytes C4 80 are one UTF-8 character.
KIND = ">u2"
END = 0xC480
BLOCK = 1 << 20
GROUP = 2_000


def write(df: DataFrame, path: str, ranks: str, pattern: str, text: str = "text") -> None:
    """Encodes each text and writes its ids and ``END`` to flat files in ``path``. A null text is an empty document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(ranks, pattern)
        if max(codec.bytes_of) >= END:
            raise ValueError("the vocabulary has no room for the end-of-document id")
        for batch in batches:
            for rows, _, _ in pieces(batch.column(0)):
                texts = batch.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()
                ids = [x.astype(KIND).tobytes() for x in codec.encode([t or "" for t in texts])]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], names=["value"])

    flat = df.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "value binary")
    flat.select(F.col("value").cast("string")).write.option("lineSep", END.to_bytes(2, "big").decode()).text(path)


def _scan(ids: np.ndarray, end: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the separators, and how many each block holds, block by block."""
    found = [np.flatnonzero(ids[i : i + block] == end) + i for i in range(0, len(ids), block)]
    return np.concatenate(found) if found else np.zeros(0, np.int64), np.array([len(x) for x in found], np.int64)


def count(spark: SparkSession, path: str, kind: str = KIND, end: int = END, block: int = BLOCK) -> DataFrame:
    """(file, doc_no, start, n_tokens, closed) for every document of the files below ``path``, in order of their names.

    ``doc_no`` and ``start`` (tokens and separators before it) count over all files. Two separators in a row enclose a document of no tokens.
    Tokens after the last separator of all are a document with ``closed`` false. Empty files
    are skipped over; a file whose size is no multiple of the id's width raises.
    """
    width = np.dtype(kind).itemsize
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                raw = content.as_buffer()
                if raw.size % width:
                    raise ValueError(f"{name.as_py()} does not hold whole ids")
                ids = np.frombuffer(raw, kind)
                at, per_block = _scan(ids, end, block)
                begin = np.concatenate([[0], at[:-1] + 1]).astype(np.int64)[: len(at)]
                # the first row stands for the file: its tokens, separators, and what follows the last of them
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                columns = [[-1], [len(ids)], [int(per_block.sum())], [tail]], [np.arange(len(at)), begin, at - begin, np.zeros(len(at), np.int64)]
                for part in columns:
                    arrays = [pa.array(np.asarray(x, np.int64)) for x in part]
                    yield pa.RecordBatch.from_arrays([pa.array([name.as_py()] * len(arrays[0]), pa.string()), *arrays], names=["file", "k", "start", "n", "tail"])

    return stitched(spark, files.mapInArrow(run, "file string, k bigint, start bigint, n bigint, tail bigint"))


def stitched(spark: SparkSession, scanned: DataFrame) -> DataFrame:
    from swarmtide.plans.workspace import Workspace

    work = Workspace(spark, "tokens")
    scanned = work.keep(scanned)
    heads = scanned.where("k = -1").select("file", F.col("start").alias("size"), F.col("n").alias("docs"), "tail")
    in_group = Window.partitionBy("g").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    # groups are runs of names: of the sorted names every GROUP-th opens one
    numbered = heads.select("*", F.row_number().over(Window.orderBy("file")).alias("no"))  # a row per file
    numbered = numbered.withColumn("g", F.floor((F.col("no") - 1) / GROUP))
    totals = numbered.groupBy("g").agg(F.sum("size").alias("size"), F.sum("docs").alias("docs"))
    over = Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("g", zero(F.sum("size").over(over)).alias("size0"), zero(F.sum("docs").over(over)).alias("docs0"))
    placed = numbered.join(totals, "g").select(
        "file", "size", "docs", "tail",
        (F.col("size0") + zero(F.sum("size").over(in_group))).alias("offset"),
        (F.col("docs0") + zero(F.sum("docs").over(in_group))).alias("before"),
    )
    # the end of the last document that an earlier file closed: where the first document here began
    closes = F.when(F.col("docs") > 0, F.col("offset") + F.col("size") - F.col("tail"))
    earlier = Window.orderBy("offset", "file").rowsBetween(Window.unboundedPreceding, -1)
    placed = work.keep(placed.withColumn("opened", zero(F.max(closes).over(earlier))))
    first = F.col("k") == 0
    begin = F.when(first, F.col("opened")).otherwise(F.col("offset") + F.col("start"))
    rows = scanned.where("k >= 0").join(placed.select("file", "offset", "before", "opened"), "file")
    closed = rows.select(
        "file", (F.col("before") + F.col("k")).alias("doc_no"), begin.alias("start"),
        (F.col("offset") + F.col("start") + F.col("n") - begin).alias("n_tokens"), F.lit(True).alias("closed"),
    )
    last = placed.agg(F.sum("size").alias("all"), F.sum("docs").alias("docs"), F.max(closes).alias("ended"), F.max("file").alias("file"))
    open_ = last.select("file", F.col("docs").alias("doc_no"), zero(F.col("ended")).alias("start"), (F.col("all") - zero(F.col("ended"))).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_.where("n_tokens > 0"))
