import random

from pyspark.sql import functions as F

from swarmtide.llm import decontamination as d


def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(300)] + ["the", "of", "and"] * 30
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, ". ".join(prose(rng.randrange(6, 20)).capitalize() for _ in range(rng.randrange(1, 4))) + ".") for k in range(40)]
    items += [(40, None), (41, ""), (42, "Tiny w1"), (None, prose(20)), (43, items[0][1])]
    texts = [None, "", "the of and", prose(400)]
    for k in range(45):
        x = items[k % 40][1]
        if k % 3 == 1:
            x = x.upper().replace(".", " ;")
        elif k % 3 == 2:
            w = x.split()
            for _ in range(1 + k % 5):
                w[rng.randrange(len(w))] = "edited"
            x = " ".join(w)
        texts.append(prose(rng.randrange(0, 90)) + " " + x + " " + prose(rng.randrange(0, 90)))
    texts += [prose(rng.randrange(1, 500)) for _ in range(12)] + ["x tiny W1, y"]
    return [(k // 1, t) for k, t in enumerate(texts)] + [(None, texts[4]), (7, texts[5])], items


def brute(docs, items):
    out = set()
    for i, x in items:
        w = d.words(x)
        if i is None or not w:
            continue
        parts = [w, *d._question_and_answer(x)]
        n = 2 * max(len(d.words(y)) for _, y in items if y)
        for k, t in docs:
            words = d.words(t)
            for at in range(0, max(1, len(words)), n // 2):
                run = words[at : at + n]
                share = lambda p: sum(any(run[j : j + len(s)] == list(s) for j in range(len(run))) for s in d.shingles(p)) / len(d.shingles(p)) if p else 1.0
                whole, q, a = map(share, parts)
                if run and (whole >= 0.8 or (q >= 0.8 and a >= 0.8)):
                    out.add((k, i))
    return out


def test_finds_what_brute_force_finds(spark):
    docs, items = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("score", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    leaky = {k for k, _ in brute(docs, items)}
    for size in (1 << 24, 1500):
        got = d.leaks(df, bench, shard_bytes=size)
        assert {(r.doc_id, r.item_id) for r in got.collect()} == brute(docs, items)
        left = d.clean(df.where("doc_id is not null and doc_id != 7"), bench, shard_bytes=size).select("doc_id").collect()
        assert sorted(r.doc_id for r in left) == sorted(k for k, _ in docs if k not in leaky | {None, 7})


def test_wand_equals_sums():
    _, items = corpus()
    index = d.Index([(i, x) for i, x in items if i is not None and x])
    rng = random.Random(3)
    for _ in range(100):
        terms = sorted(rng.sample(range(len(index.number)), rng.randrange(1, len(index.number))))
        want = {}
        for t in terms:
            for i, s in zip(*index.postings[t]):
                want[i] = want.get(i, 0) + s
        for low, end in ((0, 60), (7, 23)):
            got = dict(index.reach(terms, low, min(end, len(index.items))))
            assert got.keys() == {i for i, s in want.items() if s >= 1 - 1e-9 and low <= i < end}
            assert all(abs(got[i] - want[i]) < 1e-9 for i in got)


def test_empty_tables(spark):
    docs, items = corpus()
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert d.leaks(df.limit(0), bench).count() == 0
    assert d.leaks(df, bench.limit(0)).count() == 0


def test_short_items_and_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "I once went to Rome in spring", 5), (2, "what is the capital of France . Paris", 6)], "doc_id long, text string, `a.b` int")
    items = spark.createDataFrame([(1, "Paris"), (2, "..."), (3, "What is the capital of France? Paris")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()} == {(2, 1), (2, 3)}
    assert [r["a.b"] for r in d.clean(docs, items).collect()] == [5]
