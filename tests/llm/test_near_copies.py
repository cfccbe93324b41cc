import random
import re

import numpy as np

from swarmtide.llm import near_copies
from swarmtide.llm.hashing import strings
from swarmtide.llm.text import Words


def copies(seed=3):
    """Texts, and near copies of them with few words changed: (id, text, id of the original)."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    rows = []
    for k in range(80):
        words = [word() for _ in range(rng.randrange(60, 400))]
        rows.append((k, " ".join(words), k))
        for j in range(k % 3):
            near = list(words)
            for _ in range(max(1, len(words) // 90)):
                near[rng.randrange(len(near))] = word()
            rows.append((1000 + 10 * k + j, " ".join(near), k))
    return rows


def jaccard(a, b):
    s = [{tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a.split(), b.split())]
    return len(s[0] & s[1]) / len(s[0] | s[1])


def test_near_copies_go_and_others_stay(spark):
    rows = copies()
    passage = " ".join(f"common{k}" for k in range(40))
    rows += [(5000 + k, passage + " " + " ".join(f"own{k}x{j}" for j in range(120)), 5000 + k) for k in range(60)]
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")).collect()}
    text = {i: t for i, t, _ in rows}
    assert {i for i, _, of in rows if i == of} <= kept
    near = [i for i, t, of in rows if i != of and jaccard(t, text[of]) >= 0.85]
    assert len(near) > 50 and sum(i not in kept for i in near) >= 0.95 * len(near)


def test_one_of_each_group_stays(spark):
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(5, text), (3, text), (3, text), (9, "other words here " * 9), (None, text), (None, "lonely " * 8), (7, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "1 as fp", "'x' as w", "2 as blocks")
    got = near_copies.keep_one(df).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in got) == [(False, 0), (True, 3), (True, 7), (True, 9)]
    assert near_copies.keep_one(df.limit(0)).count() == 0


def test_hashes_and_fingerprints_of_texts():
    texts = [b"", b"one", b"one two three", b" ".join(b"w%d" % k for k in range(300)), b"x" * 5000 + b" end"]
    at = np.cumsum([0, *map(len, texts)])
    words = Words(np.frombuffer(b"".join(texts), np.uint8), at)
    for k, t in enumerate(texts):
        alone = Words(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        h, many = near_copies.shingle_hashes(alone, 5)
        whole, counts = near_copies.shingle_hashes(words, 5)
        assert (h == np.split(whole, np.cumsum(counts)[:-1])[k]).all()
        assert (near_copies.wide(h, many)[0] == near_copies.wide(whole, counts)[k]).all()


def test_words_that_polynomials_confuse():
    a = b"a"
    flip = bytes.maketrans(b"ab", b"ba")
    while len(a) < 1024:
        a += a.translate(flip)
    raw = a + a.translate(flip)
    x, y = strings(np.frombuffer(raw, np.uint8), np.array([0, 1024]), np.array([1024, 2048]))
    assert x != y
    same = strings(np.frombuffer(b"abcabcabd\0abd", np.uint8), np.array([0, 3, 6, 6, 10]), np.array([3, 6, 9, 10, 13]))
    assert same[0] == same[1] and same[2] == same[4] and len(set(same.tolist())) == 3


def families(many=80, seed=5):
    """Of each family an old version (the smallest id), a new one with a quarter of its words new, and a near copy of the new one."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for k in range(many):
        old = [word() for _ in range(400)]
        new = old[:300] + [word() for _ in range(100)]
        near = list(new)
        for _ in range(3):
            near[rng.randrange(len(near))] = word()
        rows += [(10 * k + i, " ".join(x)) for i, x in enumerate((old, new, near))]
    return rows


def test_copies_meet_beside_an_older_version(spark):
    rows = families()
    text = dict(rows)
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(jaccard(text[i], text[i + 1]) >= 0.9 for i in text if i % 10 == 1)
    assert {i for i in text if i % 10 == 0} <= kept
    assert not [i for i in kept if i % 10 == 2]


def plain_kept(rows):
    """What stays by shingle sets of five words and plain union of pairs at 0.8."""
    sets = {}
    for i, t in rows:
        w = re.split("[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)}).strip(" \t\n\v\f\r"))
        w = w if w != [""] else []
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    filed = {}
    for i, s in sets.items():
        for x in s or {()}:
            filed.setdefault(x, []).append(i)
    pairs = {(i, j) for group in filed.values() for j in group for i in group if i < j and 0.8 * max(len(sets[i]), len(sets[j])) <= min(len(sets[i]), len(sets[j]))}
    linked = 0
    for i, j in pairs:
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            linked += 1
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return {i for i in sets if find(i) == i}, linked


def spread(seed=12):
    """Copies of few texts at similarities all around 0.8, chained and starred, of many lengths."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.choice((12, 40, 90, 300, 900)))]
        for _ in range(rng.randrange(1, 7)):
            near = list(base)
            for _ in range(round(len(near) * rng.choice((0.005, 0.02, 0.03, 0.05, 0.1)))):
                near[rng.randrange(len(near))] = word()
            rows.append((len(rows), " ".join(near)))
            base = rng.choice((base, near))
    return rows


def test_kept_are_those_of_plain_shingles(spark):
    rows = spread()
    want, linked = plain_kept(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert linked > 60 and len(want) < len(rows) - 30
    assert {r.doc_id for r in near_copies.keep_one(df).collect()} == want
    # crowded keys and large components are split without loss
    assert {r.doc_id for r in near_copies.keep_one(df, crowd=3, together=3000).collect()} == want


def test_documents_keep_what_plain_shingles_keep(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want, linked = plain_kept([tuple(r) for r in docs.collect()])
    assert linked and {r.doc_id for r in near_copies.keep_one(docs).collect()} == want


def short(many=200, seed=9):
    """Texts of 10 to 50 words and copies with the last word changed, one word put before, or the last word dropped."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 8)))
    rows = []
    for k in range(many):
        words = [word() for _ in range(rng.randrange(10, 51))]
        near = (words[:-1] + [word()], [word(), *words], words[:-1])[k % 3]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(near))]
    return rows


def test_short_copies_go_by_jaccard(spark):
    rows = short()
    text = dict(rows)
    kept = {r.doc_id for r in near_copies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = {i for i in text if i % 10 and jaccard(text[i], text[i - 1]) >= 0.8}
    assert len(near) > 100 and {i for i in text if i % 10 == 0} <= kept
    assert not near & kept
