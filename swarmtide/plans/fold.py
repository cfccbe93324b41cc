"""The fold over snapshots: each takes the catalogue of the one before and writes its own.

Joins and windows prepare each host: lists are refreshed and hosts assigned by shuffles on ids; every host with its particles, lists and
nest is then one group (as is each nest of the field), in which the central is chosen, takes the host's particles, the lists
are made exclusive from the leaves up, unbound and merged. State is three Parquet tables per snapshot,
so a run starts again from any written one.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swarmtide.config import EngineConfig
from swarmtide.functions.cosmology import hubble_number
from swarmtide.operators import lookups
from swarmtide.operators.unbinding import COLUMNS, Physics, mean_frame, resolve
from swarmtide.plans.ordering import numbered
from swarmtide.sources import registry

TRACK = (
    "track_id bigint, host_halo_id bigint, rank bigint, depth bigint, parent bigint, nbound bigint, mbound double, birth int, death int, sink_track_id bigint, sink int, "
    "last_max_mass double, at_last_max_mass int, last_isolation int, x double, y double, z double, vx double, vy double, vz double, most_bound_id bigint"
)
LIST = "track_id bigint, ord bigint, id bigint, is_bound boolean"
META = [c.split()[0] for c in TRACK.split(", ")]


OUT = f"kind string, halo bigint, {TRACK}, ord bigint, id bigint, is_bound boolean"
_KINDS = {"bigint": "Int64", "int": "Int64", "double": "float64", "boolean": "boolean", "string": "object"}


def _typed(df: pd.DataFrame, kind: str, host: int) -> pd.DataFrame:
    """All output columns; whole numbers stay whole beside nulls."""
    types = dict(c.split() for c in OUT.split(", "))
    return df.assign(kind=kind, halo=host).reindex(columns=list(types)).astype({c: _KINDS[t] for c, t in types.items()})


def _host(rows: pd.DataFrame, snapshot: int, p: Physics, ratio: float, merge: bool) -> pd.DataFrame:
    """All of one host: rows of kind t (track), l (list) and h (host particle) in; tracks and lists out. A birth has track -1."""
    host = int(rows["host"].iloc[0])
    tracks = {int(t["track_id"]): t for t in rows[rows["kind"] == "t"].to_dict("records")}
    lists = {int(t): part for t, part in rows[rows["kind"] == "l"].groupby("track_id")}
    mine = rows[rows["kind"] == "h"].sort_values("ord", kind="stable")
    orphans = {t for t, m in tracks.items() if m["nbound"] <= 1}
    gone = set(tracks) - set(lists)
    order = sorted((t for t in lists if t not in orphans), key=lambda t: (-tracks[t]["mbound"], t))
    parent = {t: int(m["parent"]) for t, m in tracks.items() if m["parent"] is not None and m["parent"] >= 0 and int(m["parent"]) in tracks and t in lists and int(m["parent"]) in lists}
    frames = {}
    if host >= 0 and len(mine):
        x, v, m = (mine[c].to_numpy(float) for c in (*COLUMNS, "mass"))
        frame = mean_frame(x, v, m, p.box)
        if order:
            near = [t for t in order if tracks[t]["mbound"] >= ratio * tracks[order[0]]["mbound"]]
            kdist = lambda t: sum((tracks[t][c] - f) ** 2 for c, f in zip(COLUMNS[1], frame[1]))
            best = min(near, key=lambda t: (kdist(t), near.index(t)))
            i = order.index(best)
            order[0], order[i] = order[i], order[0]
            central = order[0]
            first = lists[central].sort_values("ord").iloc[:1]
            lists[central] = pd.concat([first, mine[mine["id"] != first["id"].iloc[0]]]).assign(track_id=central)
        else:
            central = -1
            tracks[-1] = dict.fromkeys(META, None) | {"track_id": -1, "nbound": len(mine), "mbound": 0.0, "birth": snapshot, "death": -1, "sink_track_id": -1, "sink": -1, "last_max_mass": 0.0, "at_last_max_mass": -1, "last_isolation": -1}
            lists[-1] = mine.assign(track_id=-1)
            frames[-1] = frame
        lists[central]["ord"] = np.arange(len(lists[central]))
        parent.pop(central, None)
        for t in lists:
            if t != central and t not in parent:
                parent[t] = central
    # exclusive lists: children before parents; orphans neither claim nor lose
    children: dict[int, list[int]] = {}
    for t in [*order, *(t for t in lists if t not in order)]:
        if t in parent:
            children.setdefault(parent[t], []).append(t)
    claimed: set[int] = set()
    stack = [(t, False) for t in lists if t not in parent]
    while stack:
        t, ready = stack.pop()
        if not ready:
            stack += [(t, True), *((c, False) for c in reversed(children.get(t, [])))]
        elif t not in orphans:
            part = lists[t].sort_values("ord", kind="stable").drop_duplicates("id")
            part = part[~part["id"].isin(claimed)]
            claimed.update(part["id"])
            lists[t] = part.assign(ord=np.arange(len(part)))
    done = resolve(lists, parent, orphans, p, merge, frames)
    out_tracks, out_lists = [], []
    for t, m in tracks.items():
        got = done.get(t)
        m = dict(m) | {"host_halo_id": host if host >= 0 else -1, "parent": parent.get(t, -1)}
        if t in gone or got is None or not len(got["rows"]):
            m |= {"nbound": 0, "mbound": 0.0, "most_bound_id": -1}
            m["death"] = snapshot if m["death"] is None or m["death"] < 0 else m["death"]
            out_tracks.append(m)
            continue
        part, n = got["rows"], got["nbound"]
        bound = part.iloc[:n]
        m |= {"nbound": n, "mbound": float(bound["mass"].sum()), "most_bound_id": int(bound["id"].iloc[0])}
        frame = mean_frame(bound[COLUMNS[0]].to_numpy(float), bound[COLUMNS[1]].to_numpy(float), bound["mass"].to_numpy(float), p.box)
        m |= dict(zip(sum(COLUMNS, []), map(float, [*frame[0], *frame[1]])))
        if got["disrupted"] and (m["death"] is None or m["death"] < 0):
            m["death"] = snapshot
        elif n > 1:
            m["death"] = -1
        if got["sink"] >= 0 and m["sink"] in (None, -1):
            m |= {"sink": snapshot, "sink_track_id": got["sink"]}
            if n <= 1 and m["death"] in (None, -1):
                m["death"] = snapshot
        out_tracks.append(m)
        keep = part if n > 1 else part.iloc[:1]
        out_lists.append(pd.DataFrame({"track_id": t, "ord": np.arange(len(keep)), "id": keep["id"].to_numpy(), "is_bound": np.arange(len(keep)) < n}))
    born = [m for m in out_tracks if m["track_id"] == -1 and m["nbound"] <= 1]
    out_tracks = [m for m in out_tracks if m not in born]
    if born:
        out_lists = [x for x in out_lists if x["track_id"].iloc[0] != -1]
    # places by mass after unbinding; the first becomes the central, and the heads its children
    alive = sorted((m for m in out_tracks if m["nbound"] > 0), key=lambda m: (-m["mbound"], m["track_id"]))
    if host >= 0 and alive:
        top = alive[0]["track_id"]
        roots = {m["track_id"]: m for m in out_tracks}
        for k, m in enumerate(alive):
            m["rank"] = k
            if m["track_id"] == top:
                m["parent"] = -1
            elif m["parent"] not in roots or m["parent"] is None or m["parent"] == -1 and central != -1 or m["parent"] == m["track_id"]:
                m["parent"] = top
    by_id = {m["track_id"]: m for m in out_tracks}
    for m in out_tracks:
        m["rank"] = 0 if host < 0 or m.get("rank") is None else m["rank"]
        depth, q, seen = 0, m["parent"], set()
        while q in by_id and q not in seen and q != m["track_id"]:
            seen.add(q)
            depth, q = depth + 1, by_id[q]["parent"]
            if q is None:
                break
        m["depth"] = depth
        if m["mbound"] >= (m["last_max_mass"] or 0) and m["nbound"] > 0:
            m |= {"last_max_mass": m["mbound"], "at_last_max_mass": snapshot}
        if m["rank"] == 0:
            m["last_isolation"] = snapshot
    frames_out = [_typed(pd.DataFrame(out_tracks, columns=META), "t", host)] + [_typed(x, "l", host) for x in out_lists]
    return pd.concat(frames_out, ignore_index=True)


def step(particles: DataFrame, members: DataFrame, tracks: DataFrame, lists: DataFrame, snapshot: int, p: Physics, config: EngineConfig) -> DataFrame:
    """Rows of tracks (kind t) and lists (kind l) after one snapshot; births still have track -1 and their ``halo``."""
    spark = particles.sparkSession
    attributes = ["x", "y", "z", "vx", "vy", "vz", "mass", *(["internal_energy"] if "internal_energy" in particles.columns else [])]
    seen = lists.join(particles.select("id", *attributes), "id")  # what vanished is dropped; order stays
    hosts = lookups.tracer_hosts(seen.select(F.col("track_id").alias("track"), "ord", "id"), members)
    placed = tracks.drop("host_halo_id").join(hosts.withColumnsRenamed({"track": "track_id"}), "track_id", "left").withColumn("host_halo_id", F.coalesce("host_halo_id", F.lit(-1)))
    # a link holds while child and parent share the host and the parent didn't lead its own
    same = placed.select(F.col("track_id").alias("parent"), F.col("host_halo_id").alias("__h"))
    placed = placed.join(same, "parent", "left").withColumn("parent", F.when(F.col("__h") == F.col("host_halo_id"), F.col("parent")).otherwise(-1)).drop("__h")
    from swarmtide.operators.nests import ancestors

    links = placed.where("parent >= 0").select(F.col("track_id").alias("child"), "parent")
    tops = ancestors(links).groupBy("child").agg(F.max_by("ancestor", "level").alias("top"))
    group = F.when(F.col("host_halo_id") >= 0, F.col("host_halo_id")).otherwise(-2 - F.coalesce("top", "track_id"))
    placed = placed.join(tops, F.col("track_id") == F.col("child"), "left").withColumn("host", group).drop("child", "top")
    # whole numbers get -1 for null: a null would make their column floating in pandas
    none = lambda names: [F.lit(None if k == "double" else -1).cast(k).alias(c) for c, k in names]
    meta = [(c.split()[0], c.split()[1]) for c in TRACK.split(", ")]
    body = [("ord", "bigint"), ("id", "bigint"), *((c, "double") for c in attributes if c not in META)]
    t_rows = placed.select("host", F.lit("t").alias("kind"), *META, *none(body))
    l_own = seen.join(placed.select("track_id", "host"), "track_id")
    fill = [(c, k) for c, k in meta if c not in ("track_id", "x", "y", "z", "vx", "vy", "vz")]
    l_rows = l_own.select("host", F.lit("l").alias("kind"), "track_id", "x", "y", "z", "vx", "vy", "vz", *none(fill), "ord", "id", *(c for c in attributes if c not in META))
    h_own = members.join(particles.select("id", *attributes), "id")
    h_rows = h_own.select(F.col("halo_id").alias("host"), F.lit("h").alias("kind"), F.lit(-1).cast("bigint").alias("track_id"), "x", "y", "z", "vx", "vy", "vz", *none(fill), "ord", "id", *(c for c in attributes if c not in META))
    rows = t_rows.unionByName(l_rows).unionByName(h_rows)
    ratio, merge = config.MajorProgenitorMassRatio, config.MergeTrappedSubhalos
    return rows.groupBy("host").applyInPandas(lambda pdf: _host(pdf, snapshot, p, ratio, merge), OUT)


def run(spark: SparkSession, config: EngineConfig, start: int | None = None, end: int | None = None) -> None:
    """Processes snapshots ``start`` to ``end``, from the state of ``start - 1`` if that is written."""
    start = config.MinSnapshotIndex if start is None else start
    end = config.MaxSnapshotIndex if end is None else end
    out = config.SubhaloPath
    for snapshot in range(start, end + 1):
        clock = [("begin", time.time())]
        before = f"snapshot={snapshot - 1:03}"
        if snapshot > config.MinSnapshotIndex:
            tracks, lists = spark.read.parquet(f"{out}/subhalos/{before}"), spark.read.parquet(f"{out}/subhalo_particles/{before}")
        else:
            tracks, lists = spark.createDataFrame([], TRACK), spark.createDataFrame([], LIST)
        particles = registry.read_snapshot(spark, config, snapshot)
        members = registry.read_groups(spark, config, snapshot)
        cosmology = registry.read_cosmology(spark, config, snapshot)
        a = cosmology["scale_factor"]
        physics = Physics(config.gravity, config.SofteningHalo, a, hubble_number(cosmology["omega_m0"], cosmology["omega_lambda0"], a, config.hubble0), config.box, config.MinNumPartOfSub, config.BoundMassPrecision, config.MaxSampleSizeOfPotentialEstimate, config.SourceSubRelaxFactor, config.RefineMostboundParticle)
        clock.append(("read", time.time()))
        from swarmtide.plans.workspace import Workspace

        work = Workspace(spark, "fold")
        done = work.keep(step(particles, members, tracks, lists, snapshot, physics, config))
        clock.append(("resolve", time.time()))
        old = (tracks.agg(F.max("track_id")).first()[0] if snapshot > config.MinSnapshotIndex else None)
        new = done.where("kind = 't' and track_id = -1").select("halo", "nbound")
        ids = work.keep(numbered(new, ["halo"], "new_id", 0 if old is None else old + 1).select(F.col("halo").alias("__halo"), "new_id"))
        named = done.join(ids, (F.col("halo") == F.col("__halo")) & ((F.col("track_id") == -1) | (F.col("parent") == -1) | (F.col("sink_track_id") == -1)), "left")
        track_id = F.when(F.col("track_id") == -1, F.col("new_id")).otherwise(F.col("track_id"))
        named = named.withColumn("track_id", track_id)
        named.where("kind = 't'").select(*META).write.mode("overwrite").parquet(f"{out}/subhalos/snapshot={snapshot:03}")
        named.where("kind = 'l'").select("track_id", "ord", "id", "is_bound").write.mode("overwrite").parquet(f"{out}/subhalo_particles/snapshot={snapshot:03}")
        clock.append(("save", time.time()))
        summary = named.where("kind = 't'").agg(F.count("*").alias("n_subhalos"), F.count_if(F.col("birth") == snapshot).alias("n_birth"), F.lit(a).alias("scale_factor"))
        summary.write.mode("overwrite").parquet(f"{out}/run_summary/snapshot={snapshot:03}")
        times = [(snapshot, name, t - clock[i][1]) for i, (name, t) in enumerate(clock[1:])]
        spark.createDataFrame(times, "snapshot_index int, stage string, seconds double").write.mode("overwrite").parquet(f"{out}/timings/snapshot={snapshot:03}")
