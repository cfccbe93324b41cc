"""Queries of a written catalogue. All are lazy scans of its Parquet tables with pruned columns and pushed filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmtide.operators import lookups


class Catalogue:
    """Tables below a folder: ``subhalos``, ``subhalo_particles``, ``run_summary``, in partitions by snapshot."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{table}").withColumn("snapshot", F.col("snapshot").cast("int"))

    def snapshots(self) -> list[int]:
        return sorted(r.snapshot for r in self._read("run_summary").select("snapshot").distinct().collect())

    def _index(self, snapshot: int) -> int:
        """Negative numbers count from the last snapshot."""
        return self.snapshots()[snapshot] if snapshot < 0 else snapshot

    def subhalos(self, snapshot: int = -1, columns: list[str] | None = None) -> DataFrame:
        found = self._read("subhalos").where(F.col("snapshot") == self._index(snapshot)).drop("snapshot")
        return found.select(*columns) if columns else found

    def count(self, snapshot: int = -1) -> int:
        return self.subhalos(snapshot).count()

    def nests(self, snapshot: int = -1) -> DataFrame:
        """(track_id, ord, child_track_id): direct children by rank."""
        links = self.subhalos(snapshot, ["parent", "track_id", "rank"]).where("parent >= 0")
        w = Window.partitionBy("parent").orderBy("rank", "track_id")
        return links.select(F.col("parent").alias("track_id"), (F.row_number().over(w) - 1).cast("int").alias("ord"), F.col("track_id").alias("child_track_id"))

    def particles(self, snapshot: int = -1, track_id: int | None = None, source: bool = False) -> DataFrame:
        """Bound particles, or with ``source`` all that are carried on, of all tracks or one."""
        found = self._read("subhalo_particles").where(F.col("snapshot") == self._index(snapshot)).drop("snapshot")
        found = found if source else found.where("is_bound")
        return found if track_id is None else found.where(F.col("track_id") == track_id)

    def exclusive_particles(self, snapshot: int = -1) -> DataFrame:
        return lookups.exclusive(self.particles(snapshot).select("track_id", "ord", "id"), "track_id")

    def subhalo(self, track_id: int, snapshot: int = -1) -> DataFrame:
        return self.subhalos(snapshot).where(F.col("track_id") == track_id)

    def scale_factors(self) -> DataFrame:
        return self._read("run_summary").select("snapshot", "scale_factor")

    def track(self, track_id: int, columns: list[str] | None = None) -> DataFrame:
        """A track from its birth on, with snapshot and scale factor, in order of time: one scan."""
        found = self._read("subhalos").where(F.col("track_id") == track_id)
        found = found.join(F.broadcast(self.scale_factors()), "snapshot")  # a row per snapshot
        return found.select(*(columns or [c for c in found.columns if c not in ("snapshot", "scale_factor")]), "snapshot", "scale_factor").orderBy("snapshot")

    def combined(self, snapshot: int = -1) -> DataFrame:
        """All files of a snapshot as one table, in order of tracks."""
        return self.subhalos(snapshot).orderBy("track_id")


def dump_ids(catalogue: Catalogue, snapshot: int, track_id: int, path: str) -> None:
    catalogue.particles(snapshot, track_id).orderBy("ord").select(F.col("id").cast("string")).write.text(path)
