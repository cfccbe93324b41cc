"""Binary particle snapshots and group catalogues: one row of Spark's binary source per file, decoded as arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from swarmtide.config import EngineConfig
from swarmtide.sources.files import first_of

HEADER = np.dtype(
    [("npart", "i4", 6), ("mass", "f8", 6), ("scale", "f8"), ("redshift", "f8"), ("sfr", "i4"), ("feedback", "i4"), ("total", "u4", 6),
     ("cooling", "i4"), ("files", "i4"), ("box", "f8"), ("omega_m", "f8"), ("omega_l", "f8"), ("h", "f8")]
)
PARTICLE = "id bigint, x double, y double, z double, vx double, vy double, vz double, mass double, type int, internal_energy double"
FLOATS, INTS = {4: "f4", 8: "f8"}, {4: "i4", 8: "i8"}


def _records(raw: bytes) -> tuple[str, list[memoryview]]:
    """Byte order and the records between their length marks; marks that differ raise."""
    order = next((o for o in "<>" if np.frombuffer(raw[:4], o + "i4")[0] == 256), None) if len(raw) >= 4 else None
    if order is None:
        raise ValueError("not a snapshot: its header record has another length")
    view, at, out = memoryview(raw), 0, []
    while at < len(raw):
        n = int(np.frombuffer(view[at : at + 4], order + "u4")[0])
        if np.frombuffer(view[at + 4 + n : at + 8 + n], order + "u4")[0] != n:
            raise ValueError("a record's length marks differ")
        out.append(view[at + 4 : at + 4 + n])
        at += n + 8
    return order, out


def read_header(raw: bytes) -> dict:
    order, records = _records(raw) if len(raw) > 264 else (None, [])
    head = np.frombuffer(records[0][: HEADER.itemsize], HEADER.newbyteorder(order))[0]
    return {name: head[name].tolist() for name in HEADER.names}


def decode(raw: bytes, box: float, periodic: bool = True, has_ids: bool = True, unsigned: bool = False, dark_only: bool = False) -> dict[str, np.ndarray]:
    """Columns of one file. Velocities become physical, positions are wrapped; without an id block ids count from 1.

    Raises where box or widths don't fit.
    """
    order, records = _records(raw)
    head = np.frombuffer(records[0][: HEADER.itemsize], HEADER.newbyteorder(order))[0]
    if head["box"] != box:
        raise ValueError(f"the file's box is {head['box']}, not {box}")
    npart, fixed = head["npart"].astype(np.int64), head["mass"]
    n = int(npart.sum())
    blocks = iter(records[1:])
    kind = np.repeat(np.arange(6), npart)

    def block(count: int, widths: dict[int, str], parts: int = 1) -> np.ndarray:
        data = next(blocks)
        width = len(data) // max(count * parts, 1)
        if count and (width not in widths or width * count * parts != len(data)):
            raise ValueError(f"a block of {len(data)} bytes does not hold {count * parts} numbers")
        return np.frombuffer(data, order + widths[width]) if count else np.zeros(0)

    x = block(n, FLOATS, 3).astype(np.float64).reshape(-1, 3)
    v = block(n, FLOATS, 3).astype(np.float64).reshape(-1, 3) * np.sqrt(head["scale"])
    ids = np.arange(1, n + 1)
    if has_ids:
        ids = block(n, {4: "u4", 8: "u8"} if unsigned else INTS).astype(np.int64)
    mass = fixed[kind].astype(np.float64)
    free = (npart > 0) & (fixed == 0)
    if free.any():
        mass[free[kind]] = block(int(npart[free].sum()), FLOATS)
    energy = np.full(n, np.nan)
    if npart[0] and (rest := next(blocks, None)) is not None:
        width = len(rest) // int(npart[0])
        energy[kind == 0] = np.frombuffer(rest, order + FLOATS[width])[: npart[0]]
    if periodic:
        x = x - np.floor(x / box) * box
        x[x >= box] = 0.0
    keep = kind == 1 if dark_only else np.ones(n, bool)
    columns = {"id": ids, **{c: x[:, k] for k, c in enumerate("xyz")}, **{f"v{c}": v[:, k] for k, c in enumerate("xyz")}, "mass": mass, "type": kind.astype(np.int32), "internal_energy": energy}
    return {c: a[keep] for c, a in columns.items()}


def _names(config: EngineConfig, index: int) -> list[str]:
    n, base, top = config.snapshot_id(index), config.SnapshotFileBase, config.SnapshotPath
    return [f"{top}/snapdir_{n:03}/{base}_{n:03}.*", f"{top}/{base}_{n:03}", f"{top}/{base}_{n:03}.*", f"{top}/{n}/{base}.*"]


def read_snapshot(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    """Particles of a snapshot."""
    files = first_of(spark, _names(config, index))
    options = (config.BoxSize, config.PeriodicBoundaryOn, config.SnapshotHasIdBlock, config.SnapshotIdUnsigned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0):
                found = decode(raw.as_py(), *options)
                for i in range(0, max(1, len(found["id"])), 1 << 16):
                    part = {c: a[i : i + (1 << 16)] for c, a in found.items()}
                    yield pa.RecordBatch.from_pydict({c: pa.array(a, from_pandas=c == "internal_energy") for c, a in part.items()})

    return spark.read.format("binaryFile").load(files).select("content").mapInArrow(run, PARTICLE)


def read_cosmology(spark: SparkSession, config: EngineConfig, index: int) -> dict[str, float]:
    """Scale factor and density parameters from the first file's header; a row of one file reaches the driver."""
    name = first_of(spark, _names(config, index))[0]
    stream = spark.read.format("binaryFile").load(name).select(F.substring("content", 1, 264).alias("c")).first()["c"]
    head = np.frombuffer(bytes(stream)[4 : 4 + HEADER.itemsize], HEADER.newbyteorder("<" if stream[0] == 0 and stream[1] == 1 else ">"))[0]
    return {"scale_factor": float(head["scale"]), "omega_m0": float(head["omega_m"]), "omega_lambda0": float(head["omega_l"])}


def _tab(raw: bytes, version3: bool, sub: bool, files: int) -> np.ndarray:
    """Group lengths of a table file. The byte order is the one in which the number of files fits."""
    for order in "<>":
        kinds = [("n", "i4"), ("all", "i4"), ("ids", "i4"), ("all_ids", "i8"), ("files", "i4")] if version3 else [("n", "i4"), ("ids", "i4"), ("all", "i4"), ("files", "i4")]
        kind = np.dtype([(a, order + b) for a, b in kinds])
        head = np.frombuffer(raw[: kind.itemsize], kind)[0]
        if head["files"] == files:
            at = kind.itemsize + 8 * sub
            return np.frombuffer(raw[at : at + 4 * int(head["n"])], order + "i4").astype(np.int64)
    raise ValueError(f"the group table is not one of {files} files")


def _ids(raw: bytes, version3: bool, wide: bool, files: int, mask: int) -> np.ndarray:
    """Member ids of an ids file; bytes beyond them raise."""
    at = 28 if version3 else 16
    for order in "<>":
        places = (8, 20) if version3 else (4, 12)
        n, count = (int(np.frombuffer(raw[p : p + 4], order + "i4")[0]) for p in places)
        if count == files:
            ids = np.frombuffer(raw[at:], order + ("i8" if wide else "i4")) if (len(raw) - at) % (8 if wide else 4) == 0 else np.zeros(0)
            if len(ids) != n:
                raise ValueError("bytes beyond the ids; their width may be another")
            return ids.astype(np.int64) & mask if mask else ids.astype(np.int64)
    raise ValueError(f"the ids file is not one of {files} files")


GROUP_FORMATS = {"gadget2_int": (False, False), "gadget2_long": (False, True), "gadget3_int": (True, False), "gadget3_long": (True, True)}


def read_groups(spark: SparkSession, config: EngineConfig, index: int) -> DataFrame:
    """(halo_id, ord, id): members of groups, which are numbered over all files; offsets follow from lengths."""
    version3, wide = GROUP_FORMATS[config.GroupFileFormat]
    n, top = config.snapshot_id(index), config.HaloPath
    layouts = [f"{top}/groups_{n:03}/subhalo_tab_{n:03}.*", f"{top}/groups_{n:03}/group_tab_{n:03}.*", f"{top}/snapdir_{n:03}/group_tab_{n:03}.*", f"{top}/subhalo_tab_{n:03}", f"{top}/group_tab_{n:03}"]
    tabs = first_of(spark, layouts)
    sub, files, mask = "subhalo_tab" in tabs[0], len(tabs), config.GroupParticleIdMask

    def numbers(tab: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                    raw, part = raw.as_py(), path.rsplit(".", 1)[-1]
                    values = _tab(raw, version3, sub, files) if tab else _ids(raw, version3, wide, files, mask)
                    file = int(part) if part.isdigit() else 0
                    yield pa.RecordBatch.from_pydict({"file": np.full(len(values), file), "k": np.arange(len(values)), "v": values})

        return run

    load = lambda names, tab: spark.read.format("binaryFile").load(names).select("path", "content").mapInArrow(numbers(tab), "file bigint, k bigint, v bigint")
    lengths, ids = load(tabs, True), load([t.replace("_tab_", "_ids_") for t in tabs], False)

    def placed(df: DataFrame, value, into: str) -> DataFrame:
        """Exclusive running sum: in each file, and over the files' totals (a row per file)."""
        totals = df.groupBy("file").agg(F.sum(value).alias("t"))
        before = F.sum("t").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
        inside = F.sum(value).over(Window.partitionBy("file").orderBy("k").rowsBetween(Window.unboundedPreceding, -1))
        return df.withColumn("__i", F.coalesce(inside, F.lit(0))).join(totals.select("file", F.coalesce(before, F.lit(0)).alias("__b")), "file").withColumn(into, F.col("__i") + F.col("__b")).drop("__i", "__b")

    groups = placed(placed(lengths, F.lit(1), "halo_id"), F.col("v"), "first").where("v > 0")
    slots = groups.select("halo_id", "first", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("v") - 1)).alias("at"))
    members = placed(ids, F.lit(1), "at").select("at", F.col("v").alias("id"))
    return slots.join(members, "at").select("halo_id", (F.col("at") - F.col("first")).alias("ord"), "id")
