"""Every registered query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from swarmtide.queries import ORACLES, QUERIES

DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DIR)
    columns = sorted(got.columns)
    a, b = got.select(*(f"`{c}`" for c in columns)).toPandas(), duck.execute(ORACLES[name]).df()[columns]
    for c in columns:  # beside nulls, whole numbers have another type on each side
        if a[c].isna().any() or b[c].isna().any():
            a[c], b[c] = a[c].astype("float64"), b[c].astype("float64")
    assert list(a.dtypes) == list(b.dtypes)
    rows = lambda df: sorted(repr([None if x != x else x for x in row]) for row in df.astype(object).values.tolist())
    assert rows(a) == rows(b)


def test_branches_follow_back(spark):
    rows = QUERIES["branch_follow"](spark, DIR).collect()
    assert len({r.id for r in rows}) == len(rows)


def test_branches_follow_back_through_every_snapshot(spark):
    """The fold over plain dictionaries."""
    from swarmtide.operators.branches import BRANCH
    from swarmtide.queries import _members

    held = {}
    for r in _members(spark, DIR).collect():
        held[r.snapshot, r.id] = min(r.halo_id, held.get((r.snapshot, r.id), r.halo_id))
    left = {i for _, i in held}
    want = dict.fromkeys(left)
    for snapshot in sorted({s for s, _ in held}, reverse=True):
        found = {i: held[snapshot, i] + snapshot * BRANCH for i in left if (snapshot, i) in held}
        n = {b: list(found.values()).count(b) for b in set(found.values())}
        main = min(n, key=lambda b: (-n[b], b), default=None)
        gone = {i: b for i, b in found.items() if b != main}
        want |= gone
        left -= gone.keys()
    assert {b // BRANCH for b in want.values() if b} - set(range(25, 30))
    assert {r.id: r.branch for r in QUERIES["branch_follow"](spark, DIR).collect()} == want
