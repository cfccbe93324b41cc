"""Self-bound parts of particle groups: potentials, the unbinding fixpoint, and nests from the leaves up.

The kernels work on arrays of one group. Frames apply them per group; a nest of a host is one group, since what a
child loses feeds its parent. Groups above ``SAMPLE`` particles take their potential from a
deterministic sample of sources (by a hash of the ids), as the parameter files allow; 0 means exact sums; with ``refine`` the as many
particles that such a sample finds most bound are then ordered by their exact energies among themselves. Memory is the group's own particles.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Spline softening in units of 2.8 times the softening length, inner and outer branch.
CORE = 2.8
INNER = (-2.8, 5.333333333333, -9.6, 6.4)
OUTER = (-3.2, 0.066666666667, 10.666666666667, -16.0, 9.6, -2.133333333333)


@dataclass
class Physics:
    g: float = 43.0071
    softening: float = 0.01
    scale: float = 1.0
    hubble: float = 0.0
    box: float | None = None
    least: int = 20
    precision: float = 0.995
    sample: int = 0
    relax: float = 3.0
    refine: bool = False


def softened(r: np.ndarray, softening: float) -> np.ndarray:
    """Potential of a unit mass at distance r, comoving: -1/r outside the kernel."""
    h = CORE * softening
    u = r / h
    with np.errstate(divide="ignore", invalid="ignore"):
        inner = INNER[0] + u * u * (INNER[1] + u * u * (INNER[2] + INNER[3] * u))
        outer = OUTER[0] + OUTER[1] / u + u * u * (OUTER[2] + u * (OUTER[3] + u * (OUTER[4] + OUTER[5] * u)))
        return np.where(u >= 1, -1 / r, np.where(u < 0.5, inner, outer) / h)


def nearest_image(d: np.ndarray, box: float | None) -> np.ndarray:
    return d if box is None else d - box * (d > box / 2) + box * (d < -box / 2)


def potential(x: np.ndarray, mass: np.ndarray, at: np.ndarray, p: Physics, own: np.ndarray | None = None) -> np.ndarray:
    """Physical potential at points from sources; ``own[i]`` is the source that point i is itself (-1: none), whose share is left out."""
    out = np.empty(len(at))
    step = max(1, 4_000_000 // max(len(x), 1))
    for i in range(0, len(at), step):
        d = nearest_image(at[i : i + step, None, :] - x[None], p.box)
        phi = softened(np.sqrt((d * d).sum(2)), p.softening) * mass
        if own is not None:
            rows = np.flatnonzero(own[i : i + step] >= 0)
            phi[rows, own[i : i + step][rows]] = 0
        out[i : i + step] = phi.sum(1)
    return out * p.g / p.scale


def mean_frame(x: np.ndarray, v: np.ndarray, mass: np.ndarray, box: float | None) -> tuple[np.ndarray, np.ndarray]:
    w = mass / mass.sum()
    return x[0] + w @ nearest_image(x - x[0], box), w @ v


def _spread(ids: np.ndarray) -> np.ndarray:
    """Order of ids by a hash: a sample that no order of input decides."""
    z = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.lexsort((ids, z ^ (z >> np.uint64(27))))


def energies(ids, x, v, mass, thermal, frame, p: Physics) -> np.ndarray:
    sources = np.arange(len(ids))
    if p.sample and len(ids) > p.sample:
        sources = _spread(ids)[: p.sample]
    own = np.full(len(ids), -1)
    own[sources] = np.arange(len(sources))
    phi = potential(x[sources], mass[sources] * len(ids) / len(sources), x, p, own)
    d = nearest_image(x - frame[0], p.box) * p.scale
    w = v - frame[1] + p.hubble * d
    return 0.5 * (w * w).sum(1) + phi + thermal


@dataclass
class Bound:
    order: np.ndarray
    nbound: int
    energy: np.ndarray = field(default_factory=lambda: np.zeros(0))
    disrupted: bool = False


def unbind(ids, x, v, mass, thermal=None, frame=None, physics: Physics | None = None) -> Bound:
    """Order of particles, bound ones by rising energy first, and how many are bound.

    Removes what has energy >= 0 in the frame of the rest until 99.5 % stay. With fewer than the least number bound only the
    first particle stays, in front. Ties order by id.
    """
    p = physics or Physics()
    n = len(ids)
    thermal = np.zeros(n) if thermal is None else np.nan_to_num(thermal)
    if n <= 1:
        return Bound(np.arange(n), n, np.zeros(n))
    left = np.arange(n)
    frame = frame or mean_frame(x, v, mass, p.box)
    while True:
        e = energies(ids[left], x[left], v[left], mass[left], thermal[left], frame, p)
        stay = left[e < 0]
        if len(stay) < p.least:
            rest = np.arange(1, n)
            return Bound(np.concatenate([[0], rest]), 1, np.zeros(n), True)
        done = len(stay) >= p.precision * len(left)
        seen_from = frame
        frame = mean_frame(x[stay], v[stay], mass[stay], p.box)
        if done:
            energy = np.full(n, np.inf)
            energy[left] = e
            lost = np.setdiff1d(np.arange(n), stay)
            outer = energies(ids, x, v, mass, thermal, frame, p)[lost] if len(lost) else np.zeros(0)
            bound = stay[np.lexsort((ids[stay], energy[stay]))]
            if p.refine and 0 < p.sample < len(bound):
                top = bound[: p.sample]
                own = energies(ids[top], x[top], v[top], mass[top], thermal[top], seen_from, replace(p, sample=0))
                bound[: p.sample] = top[np.lexsort((ids[top], own))]
            lost_order = lost[np.lexsort((ids[lost], outer))]
            return Bound(np.concatenate([bound, lost_order]).astype(np.int64), len(bound), np.concatenate([energy[bound], outer[np.lexsort((ids[lost], outer))]]))
        left = stay


COLUMNS = ["x", "y", "z"], ["vx", "vy", "vz"]


def unbind_rows(rows: pd.DataFrame, p: Physics, frame=None) -> tuple[pd.DataFrame, Bound]:
    """One list (sorted by ``ord``) unbound and put in its new order."""
    rows = rows.sort_values(["ord", "id"], kind="stable").reset_index(drop=True)
    thermal = rows["internal_energy"].to_numpy(float) if "internal_energy" in rows else None
    got = unbind(rows["id"].to_numpy(), rows[COLUMNS[0]].to_numpy(float), rows[COLUMNS[1]].to_numpy(float), rows["mass"].to_numpy(float), thermal, frame, p)
    out = rows.iloc[got.order].reset_index(drop=True)
    out["ord"] = np.arange(len(out))
    out["is_bound"] = out["ord"] < got.nbound
    out["energy"] = got.energy[: len(out)]
    return out, got


def unbind_groups(particles: DataFrame, group: str, physics: Physics) -> DataFrame:
    """(group, ord, id, is_bound, energy) of independent groups with ``ord``, places, velocities and masses."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return unbind_rows(rows, physics)[0][[group, "ord", "id", "is_bound", "energy"]]

    kind = dict(particles.dtypes)[group]
    return particles.groupBy(group).applyInPandas(run, f"{group} {kind}, ord bigint, id bigint, is_bound boolean, energy double")


def resolve_nests(particles: DataFrame, nest: str, physics: Physics, merge: bool = True) -> DataFrame:
    """(nest, track, ord, id, is_bound, nbound, sink): lists after ``resolve``, each nest one group.

    ``particles``: rows of lists with ``track``, ``parent`` (null for the root of a nest), ``ord``, ``id``, place, velocity and mass.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = {int(t): g for t, g in rows.groupby("track")}
        parent = {t: int(g["parent"].iloc[0]) for t, g in lists.items() if not pd.isna(g["parent"].iloc[0])}
        parts = []
        for t, got in resolve(lists, parent, set(), physics, merge).items():
            ids = got["rows"]["id"].to_numpy()
            place = np.arange(len(ids))
            parts.append(pd.DataFrame({nest: rows[nest].iloc[0], "track": t, "ord": place, "id": ids, "is_bound": place < got["nbound"], "nbound": got["nbound"], "sink": got["sink"]}))
        return pd.concat(parts)

    kind = dict(particles.dtypes)[nest]
    return particles.groupBy(nest).applyInPandas(run, f"{nest} {kind}, track bigint, ord bigint, id bigint, is_bound boolean, nbound bigint, sink bigint")


def core(rows: pd.DataFrame, nbound: int, p: Physics, most: int = 20):
    """Mean place and velocity of the most bound particles, and their dispersions."""
    top = rows.iloc[: min(max(nbound, 1), most)]
    x, v, m = top[COLUMNS[0]].to_numpy(float), top[COLUMNS[1]].to_numpy(float), top["mass"].to_numpy(float)
    w = m / m.sum()
    d = nearest_image(x - x[0], p.box)
    spread = lambda a: float(np.sqrt(max(0.0, (w @ (a * a) - (w @ a) ** 2).sum())))
    return x[0] + w @ d, w @ v, spread(d), spread(v)


def sink_distance(place, velocity, core_, p: Physics) -> float:
    """Separation from a core in units of its dispersions; infinite where a dispersion is zero."""
    d = np.linalg.norm(nearest_image(place - core_[0], p.box))
    w = np.linalg.norm(velocity - core_[1])
    return d / core_[2] + w / core_[3] if core_[2] > 0 and core_[3] > 0 else np.inf


def resolve(lists: dict[int, pd.DataFrame], parent: dict[int, int], orphans: set[int], p: Physics, merge: bool = True, frames=None) -> dict[int, dict]:
    """A host's lists from the leaves of its nest up: unbind, hand what is stripped to the parent, merge what is trapped.

    ``parent``: of each list but the root. Orphans (one bound particle) pass through. Returns, per list: rows, nbound, disrupted and
    sink (the list it merged into, or -1). Lists lose what exceeds ``relax`` times their bound number.
    """
    children: dict[int, list[int]] = {}
    for c, q in parent.items():
        children.setdefault(q, []).append(c)
    order, stack = [], [t for t in lists if t not in parent]
    while stack:
        t = stack.pop()
        order.append(t)
        stack += children.get(t, [])
    order.reverse()
    out: dict[int, dict] = {}
    given: dict[int, list[pd.DataFrame]] = {}
    for t in order:
        rows = lists[t].sort_values(["ord", "id"], kind="stable")
        if t in orphans:
            out[t] = {"rows": rows.iloc[:1], "nbound": len(rows.iloc[:1]), "disrupted": False, "sink": -1}
            continue
        if t in given:
            rows = pd.concat([rows, *given.pop(t)]).drop_duplicates("id")
            rows["ord"] = np.arange(len(rows))
        rows, got = unbind_rows(rows, p, (frames or {}).get(t))
        most = got.nbound if got.nbound <= 1 else int(got.nbound * p.relax)
        if t in parent and len(rows) > got.nbound:
            given.setdefault(parent[t], []).append(rows.iloc[got.nbound :])
        out[t] = {"rows": rows.iloc[: max(most, 1)], "nbound": got.nbound, "disrupted": got.disrupted, "sink": -1}
    if merge:
        touched = []
        for t in order:
            q, place = parent.get(t), out[t]["rows"]
            if out[t]["sink"] >= 0 or not len(place):
                continue
            while q is not None:
                if out[q]["nbound"] > 1:
                    first = place.iloc[0]
                    c = core(out[q]["rows"], out[q]["nbound"], p)
                    if sink_distance(first[COLUMNS[0]].to_numpy(float), first[COLUMNS[1]].to_numpy(float), c, p) < 2:
                        out[t]["sink"] = q
                        if out[t]["nbound"] > 1:
                            both = pd.concat([out[q]["rows"].iloc[: out[q]["nbound"]], place, out[q]["rows"].iloc[out[q]["nbound"] :]]).drop_duplicates("id")
                            both["ord"] = np.arange(len(both))
                            out[q]["rows"] = both
                            out[t]["rows"], out[t]["nbound"] = place.iloc[:1], 1
                            touched.append(q)
                        break
                q = parent.get(q)
        for q in dict.fromkeys(touched):
            if out[q]["nbound"] > 1:
                rows, got = unbind_rows(out[q]["rows"], p)
                out[q] |= {"rows": rows.iloc[: max(int(got.nbound * p.relax), 1)], "nbound": got.nbound, "disrupted": got.disrupted}
    return out
