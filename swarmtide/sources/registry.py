"""Readers by format name. Others register their own: (spark, config, snapshot index) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from swarmtide.config import EngineConfig
from swarmtide.sources import gadget

Reader = Callable[[SparkSession, EngineConfig, int], DataFrame]


def _parquet(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    return spark.read.parquet(f"{config.SnapshotPath}/particles").where(f"snapshot = {index}").drop("snapshot")


def _parquet_groups(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    return spark.read.parquet(f"{config.HaloPath}/halo_particles").where(f"snapshot = {index}").drop("snapshot")


def _flat_groups(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    """Groups kept as a column of the particles; negative numbers and 2**30 mean none."""
    p = _parquet(spark, config, index)
    return p.where("halo_id >= 0 and halo_id != 1073741824").selectExpr("halo_id", "id as ord", "id")


def _parquet_cosmology(spark: SparkSession, config: EngineConfig, index: int) -> dict[str, float]:
    """Of the table ``cosmology`` beside the particles: snapshot, scale_factor, omega_m0, omega_lambda0; one row reaches the driver."""
    row = spark.read.parquet(f"{config.SnapshotPath}/cosmology").where(f"snapshot = {index}").select("scale_factor", "omega_m0", "omega_lambda0").first()
    if row is None:
        raise ValueError(f"the cosmology table has no row of snapshot {index}")
    return {k: float(x) for k, x in row.asDict().items()}


SNAPSHOTS: dict[str, Reader] = {"gadget": gadget.read_snapshot, "parquet": _parquet}
COSMOLOGIES: dict[str, Callable[[SparkSession, EngineConfig, int], dict[str, float]]] = {"gadget": gadget.read_cosmology, "parquet": _parquet_cosmology}
GROUPS: dict[str, Reader] = {**dict.fromkeys(gadget.GROUP_FORMATS, gadget.read_groups), "parquet": _parquet_groups, "particle_index": _flat_groups}


def read_snapshot(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    if config.SnapshotFormat not in SNAPSHOTS:
        raise ValueError(f"unknown snapshot format {config.SnapshotFormat}")
    return SNAPSHOTS[config.SnapshotFormat](spark, config, index)


def read_groups(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    if config.GroupFileFormat not in GROUPS:
        raise ValueError(f"unknown group format {config.GroupFileFormat}")
    return GROUPS[config.GroupFileFormat](spark, config, index)


def read_cosmology(spark: SparkSession, config: EngineConfig, index: int) -> dict[str, float]:
    """Scale factor and density parameters at a snapshot; nothing is assumed where a format doesn't tell them."""
    if config.SnapshotFormat not in COSMOLOGIES:
        raise ValueError(f"snapshot format {config.SnapshotFormat} has no reader of its cosmology")
    return COSMOLOGIES[config.SnapshotFormat](spark, config, index)
