import math

import numpy as np
from pyspark.sql import functions as F

from swarmtide.llm import embeddings


def brute(rows, threshold):
    fine = {}
    for k, (i, v) in enumerate(rows):
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float64)
            fine[k] = u / np.linalg.norm(u)
    near = {k: [m for m in fine if m != k and len(fine[m]) == len(fine[k]) and fine[k] @ fine[m] >= threshold] for k in fine}
    root = {k: k for k in range(len(rows))}
    changed = True
    while changed:
        changed = False
        for k, found in near.items():
            for m in found:
                if rows[root[m]][0] < rows[root[k]][0]:
                    root[k], changed = root[m], True
    return sorted((rows[k][0], len(near.get(k, [])), rows[root[k]][0], rows[k][0] == rows[root[k]][0]) for k in range(len(rows)))


def test_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = [c + s * rng.normal(size=16) for c in centres for s in (0.1, 0.15, 0.25, 0.3, 0.4)]
    vectors = [v.astype(np.float32).astype(float).tolist() for v in vectors]
    vectors += [vectors[0]] * 9 + [[2 * x for x in vectors[0]], [0.0] * 16, [-0.0] * 15 + [1.0], [0.0] * 15 + [1.0], None, []]
    vectors += [[float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.1], [1e-30, 2e-30]]
    rows = [(1000 - 3 * i, v) for i, v in enumerate(vectors)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit(0)).withColumn("v", F.lit(1))
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for tile in (4096, 7):
        got = sorted(tuple(r) for r in embeddings.near_duplicates(df, tile=tile).collect())
        assert got == brute(as_float, 0.95)


def test_bounds_are_rigorous():
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    q, s, e = embeddings.quantise(a)
    b = q * s[:, None]
    assert (np.abs(a @ a.T - b @ b.T) <= e[:, None] * np.linalg.norm(b, axis=1) + e).all()


def test_empty(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
