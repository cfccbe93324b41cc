"""Intermediate tables in the folder that the cluster shares.

Iterative plans cut their lineage with written tables. They go below
``spark.checkpoint.dir``, which every executor can read, so a lost executor costs a
task retry and never an intermediate result. Only a local session without that setting
gets a temporary folder.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; in a local session without it, a temporary folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="swarmtide-")
    spark.conf.set("spark.checkpoint.dir", folder)
    atexit.register(_drop_local, folder)
    return folder


def _drop_local(folder: str) -> None:
    import shutil

    shutil.rmtree(folder.removeprefix("file://"), ignore_errors=True)


#: Workspaces made inside each open ``scratch``.
_open: list[list[Workspace]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """Frees, at its end, all tables kept inside: for callers that have written the result by then."""
    made: list[Workspace] = []
    _open.append(made)
    try:
        yield
    finally:
        _open.remove(made)
        for work in made:
            work.clear()


class Workspace:
    """A folder for the tables of one call. ``drop`` frees a table that is read no more, ``clear`` all of them."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.written = 0
        if _open:
            _open[-1].append(self)

    def keep(self, df: DataFrame, *partitions: str) -> DataFrame:
        """Writes ``df`` once, by ``partitions`` if given, and returns it as a scan of the written files."""
        self.written += 1
        path = f"{self.root}/{self.written}"
        df.write.option("compression", "zstd").partitionBy(*partitions).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._swarmtide_path = path
        return kept

    def drop(self, *kept: DataFrame) -> None:
        """Deletes tables that ``keep`` returned."""
        for df in kept:
            self._delete(df._swarmtide_path)

    def drop_partition(self, kept: DataFrame, column: str, value: int) -> None:
        """Deletes the rows of one value of a partition column."""
        self._delete(f"{kept._swarmtide_path}/{column}={value}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, folder: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
