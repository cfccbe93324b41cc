import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from swarmtide.llm import simhash
from swarmtide.plans.components import components
from swarmtide.plans.workspace import Workspace

LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def brute_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOW))
    shingles = [words[i : i + size] for i in range(len(words) - size + 1)] or ([words] if words else [])
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(keys, near):
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if near(a, b) and root[b] < root[a]:
                    root[a], changed = root[b], True
    return root


def test_rows_match_brute_force(spark):
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    texts = [None, "", "  \n ", "One", "one two", "ONE two", "É é\x0bx y", base, base.upper(), base + " tail", "w " * 500]
    texts += [" ".join(f"v{rng.randrange(50)}" for _ in range(rng.randrange(1, 40))) for _ in range(25)]
    for _ in range(15):
        words = base.split()
        words[rng.randrange(300)] = "changed"
        texts.append(" ".join(words))
    rows = [(i * 7 % 53, t) for i, t in enumerate(texts)] + [(7, None), (None, "x y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit(1)).withColumn("fp", F.lit(2))
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
    fps = [brute_fingerprint(t) for _, t in rows]
    near = lambda a, b: bin(a ^ b).count("1") <= 3
    distinct = sorted(set(fps))
    groups = brute_roots(distinct, near)
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[groups[f]] = min(least.get(groups[f], i), i)
    want = sorted((i if i is not None else -1, f"{f:016x}", least.get(groups[f])) for (i, _), f in zip(rows, fps))
    assert got == want


@pytest.mark.parametrize("crowd", [4096, 20])
def test_links_span_what_is_near(spark, crowd):
    rng = random.Random(9)
    centre = rng.getrandbits(64)
    values = {rng.getrandbits(64) for _ in range(60)}
    for _ in range(160):  # a crowd that shares its first blocks
        values.add(centre ^ sum(1 << rng.randrange(40, 64) for _ in range(rng.randrange(1, 6))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    work = Workspace(spark, "test")
    links = simhash.link(work, spark.createDataFrame([(v,) for v in signed], "fp long"), 3, crowd)
    roots = {r.node: r.root for r in components(spark, links).collect()}
    want = brute_roots(sorted(signed), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 3)
    assert {v: roots.get(v, v) for v in signed} == want


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(df).count() == 0
