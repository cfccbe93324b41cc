import math
import random
import time
import zlib

import numpy as np
from pyspark.sql import functions as F

from swarmtide.llm import toxicity


def brute_segments(values):
    """All maximal scoring segments, by their definition: the best segment, then the same on both sides."""
    best, at = 0.0, None
    for i in range(len(values)):
        for j in range(i + 1, len(values) + 1):
            s = sum(values[i:j])
            if s > best + 1e-12:
                best, at = s, (i, j)
    if at is None:
        return []
    i, j = at
    left, right = brute_segments(values[:i]), brute_segments(values[j:])
    return left + [(best, i, j)] + [(s, a + j, b + j) for s, a, b in right]


def test_segments_are_maximal():
    rng = random.Random(2)
    model = toxicity.Model({b"bad": 1.7, b"vile": 0.93, b"rude": 0.21}, 1.0, 0.05)
    for _ in range(60):
        words = [rng.choice([b"bad", b"vile", b"rude", *[b"ok"] * 9]) for _ in range(rng.randrange(0, 40))]
        values = [-toxicity.DRIFT if i and w == words[i - 1] else model.weights.get(w, -toxicity.DRIFT) for i, w in enumerate(words)]
        got = model.passages(words)
        want = brute_segments(values)
        assert len(got) == len(want)
        for (s, i, j), (t, a, b) in zip(got, want):
            assert abs(s - t) < 1e-9 and (i, j) == (a, b)


def corpus(n=400):
    rng = random.Random(4)
    plain = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(20, 200))]
        toxic = k % 5 == 0
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["Vile,", "scoundrel", "BEAST."]))
        rows.append((k, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy_and_edges(spark):
    rows = corpus()
    df = spark.createDataFrame([(k, t, 9) for k, t, _ in rows] + [(1000, None, 9), (1001, "", 9), (None, "vile beast", 9), (5, rows[5][1], 9)], "doc_id long, text string, score int")
    labels = [(k, y) for k, _, y in rows if k % 4 != 2] + [(3, None), (None, 1), (7, 0), (7, rows[7][2]), (99999, 1)]
    model = toxicity.fit(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = toxicity.score(df, model).collect()
    truth = {k: y for k, _, y in rows}
    assert len(got) == df.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    held = [r for r in got if r.doc_id in truth and r.doc_id % 4 == 2]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1000].score == by_id[1001].score < 0.3 and by_id[None].predicted == 1
    assert by_id[0].passages[0].stop > by_id[0].passages[0].start >= 0


def test_without_labels_or_rows(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(df, none)
    assert toxicity.score(df, model).first().predicted == 0
    assert toxicity.score(df.limit(0), model).count() == 0
    sample = toxicity.fit(df.withColumn("x", F.lit(1)), spark.createDataFrame([(1, 1)], "doc_id long, toxic int"), most_rows=1)
    assert sample.weights == {}


def test_segments_take_linear_time():
    model = toxicity.Model({b"bad": 1.0, b"good": -1.0}, 1.0, 0.05)
    rng = random.Random(3)
    texts = [[b"bad", b"ok"] * 100_000, [b"bad", *[b"good"] * 2] * 60_000, [*[b"good"] * 100_000, b"bad"], [rng.choice([b"bad", b"good", b"ok"]) for _ in range(200_000)]]
    texts.append([x for k in range(60_000) for x in (b"bad", *[b"ok"] * (10 + k % 7))])
    for words in texts:
        began = time.process_time()
        model.passages(words)
        assert time.process_time() - began < 2


def test_extreme_values_of_clean_texts():
    """The law that is fitted to one set of random texts holds for another."""
    rng = random.Random(6)
    model = toxicity.Model({b"a": 0.9, b"b": 0.5, b"c": -0.4}, 1.0, 1.0)
    text = lambda: [rng.choice([b"a", b"b", *[b"c"] * 6, *[f"w{k}".encode() for k in range(30)]]) for _ in range(rng.choice((50, 200, 800)))]
    best = lambda words: max((s for s, _, _ in model.passages(words)), default=0.0)
    some = [text() for _ in range(1500)]
    model.rate, model.scale = toxicity.extreme_value(np.array([best(x) for x in some]), np.array([len(x) for x in some]))
    share = sum(bool(model.significant(text())) for _ in range(1500)) / 1500
    assert 0.01 < share < 0.12
    assert toxicity.extreme_value(np.zeros(3), np.array([0, 5, 9]))[1] > 0 and toxicity.extreme_value(np.zeros(0), np.zeros(0, np.int64))[1] > 0


def plain_fit(rows, part_of):
    """Weights, lambda and K, slope and base by loops and grids. rows: (id, text, label)."""
    docs = [(set(toxicity.tokens(t)), toxicity.tokens(t), y, part_of[i]) for i, t, y in rows]

    def weights(some):
        size = [sum(d[2] == y for d in some) for y in (0, 1)]
        out = {}
        for w in set().union(*(d[0] for d in some)):
            n = [sum(w in d[0] for d in some if d[2] == y) for y in (0, 1)]
            a = toxicity.PRIOR * sum(n) / sum(size) + 1e-9
            odds = [math.log((n[y] + a) / (size[y] + toxicity.PRIOR + 0.5 - n[y] - a)) for y in (0, 1)]
            sure = abs(odds[1] - odds[0]) - toxicity.DOUBT * math.sqrt(sum(1 / (x + a) for x in n))
            if sum(n) >= toxicity.LEAST and sure > 0:
                out[w] = math.copysign(sure, odds[1] - odds[0]) - toxicity.DRIFT
        return out

    others = [toxicity.Model(weights([d for d in docs if d[3] != h]), 1.0, 1.0) for h in range(toxicity.PARTS)]
    best = [(max((s for s, _, _ in others[h].passages(words)), default=0.0), len(words)) for _, words, y, h in docs if not y]
    hits = sum(s > 0 for s, _ in best)
    grid = []
    for k in range(1, 4000):
        rate = 0.0125 * k
        scale = hits / sum(n * math.exp(-rate * s) for s, n in best)
        grid.append((toxicity.NATURAL * (math.log(rate) - rate) + sum(math.log(rate * scale) - rate * s for s, _ in best if s > 0) - scale * sum(n * math.exp(-rate * s) for s, n in best), rate, scale))
    _, rate, scale = max(grid)
    for m in others:
        m.rate, m.scale = rate, scale
    return weights(docs), rate, scale


def test_fit_matches_plain_loops(spark):
    rng = random.Random(9)
    rows = []
    for k, t, y in corpus(300):
        words = t.split()
        if not y and rng.random() < 0.4:
            words[rng.randrange(len(words))] = rng.choice(["vile", "beast", "scoundrel"])
        rows.append((k, " ".join(words), y))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    part = {r.doc_id: r.h for r in df.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(toxicity.PARTS)).alias("h")).collect()}
    want, rate, scale = plain_fit(rows, part)
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert model.weights.keys() == want.keys() and len(want) >= 3
    assert all(abs(model.weights[w] - want[w]) < 1e-9 for w in want)
    assert abs(model.rate - rate) < 0.02 and abs(model.scale / scale - 1) < 0.05
    for r in toxicity.score(df, model).collect():
        e = sum(x for x in (model.rate * s - math.log(model.scale * max(len(toxicity.tokens(r.text)), 1)) for s, _, _ in model.passages(toxicity.tokens(r.text))) if -math.expm1(-math.exp(-x)) <= toxicity.LEVEL)
        assert abs(r.score - 1 / (1 + math.exp(-model.base - model.slope * math.log1p(e)))) < 1e-9


def test_curve_is_the_likeliest():
    """Steep curves far from the start, which full Newton steps leave for a slope of 0.001."""
    rng = np.random.default_rng(5)
    for base, slope, clean in ((-24.8, 7.9, 175), (-28.2, 5.2, 158), (-16.3, 11.8, 1424), (-24.5, 9.9, 34757), (-9.0, 3.3, 12511)):
        for _ in range(8):
            bins = [(0.0, clean, 0)]
            for x in np.arange(11, 49) / 8:
                n = int(rng.integers(1, 200))
                y = int(rng.binomial(n, 1 / (1 + math.exp(-base - slope * x))))
                bins.append((float(x), n - y, y))
            got, at = toxicity._logistic(bins)

            def loss(slope, base):
                return sum(z * np.logaddexp(0, base + slope * x) + y * np.logaddexp(0, -base - slope * x) for x, z, y in bins) + 0.005 * (slope * slope + base * base)

            least = loss(got, at)
            assert least <= loss(slope, base) and all(least <= loss(got + a, at + b) + 1e-6 for a in (-0.01, 0, 0.01) for b in (-0.01, 0, 0.01))
    assert toxicity._logistic([]) == toxicity._logistic([(0.0, 1, 1)])


def test_query(spark):
    from swarmtide.llm.queries import QUERIES

    rows = QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    label = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.predicted, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.9 * len(held)


def test_names_with_dots(spark):
    df = spark.createDataFrame([(1, "a b", 2)], "doc_id long, text string, `a.b` int")
    assert toxicity.score(df, toxicity.Model({}, 1.0, 1.0)).first()["a.b"] == 2
