from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from swarmtide.llm import sharding


@pytest.mark.parametrize(("n", "part_rows"), [(0, 50), (3, 50), (1003, 50), (1003, 5000)])
def test_exact_sizes_and_gapless_slots(spark, n, part_rows):
    rows = [(None if i % 97 == 5 else i // 2, "t" if i % 3 else None) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, text string").withColumn("shard", F.lit("x")).withColumn("p", F.lit(1)).withColumn("row", F.lit(2))
    got = sharding.shuffle(df, 7, ["id", "text"], part_rows=part_rows).collect()
    assert Counter((r.id, r.text) for r in got) == Counter(rows)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = [len(slots.get(s, [])) for s in range(7)]
    assert max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(7))


def test_same_again_and_other_seed(spark):
    df = spark.range(500)
    at = lambda seed: {r.id: (r.shard, r.slot) for r in sharding.shuffle(df, 5, ["id"], seed=seed, part_rows=40).collect()}
    assert at(1) == at(1) != at(2)


def test_matrix_margins_and_law():
    counts = np.array([10, 0, 25, 7])
    seen = np.zeros((4, 3))
    for seed in range(400):
        m = sharding.communication_matrix(counts, 3, seed)
        assert (m.sum(1) == counts).all() and m.sum(0).tolist() == [14, 14, 14]
        seen += m
    assert np.abs(seen / 400 - counts[:, None] / 3).max() < 0.3


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        sharding.shuffle(spark.range(3), 0, ["id"])
