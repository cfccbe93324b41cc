import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from swarmtide.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def plain():
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def texts():
    rng = random.Random(1)
    out = ["", " ", "\n", " a ", "\n\n x", "don't  'S'll", "<|endoftext|>", "a" * 20_000, " " * 999, "x  y", "日本語 text  z", "é 🙂🙂", "\x1c\x1d a"]
    out += ["".join(chr(k) + " " for k in range(lo, lo + 256) if not 0xD800 <= k < 0xE000) for lo in range(0, 0x30000, 0x1500)]
    out += ["".join(rng.choice("aeth on\n.=-1é") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    out += [rng.choice("aeo=-*_ ") * rng.randrange(1, 70) + rng.choice("aeo=-*_ ") * rng.randrange(1, 70) for _ in range(400)]
    return out


def test_same_ids_as_ranks(plain):
    codec = bpe.Codec.of(RANKS, PATTERN)
    for text, ids in zip(texts(), codec.encode(texts())):
        assert ids.tolist() == plain.encode_ordinary(text)
        assert codec.decode(ids.tolist()) == text.encode()


def test_memory_starts_over(plain, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    codec = bpe.Codec(RANKS, PATTERN)
    for text in texts()[:60]:
        assert codec.encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_frames(spark, plain):
    rows = [(k, t) for k, t in enumerate([None, *texts()[:14], "x", "x"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("n_tokens", F.lit(0)).withColumn("a.b", F.lit(1))
    got = {r.doc_id: r for r in bpe.round_trip(df, RANKS, PATTERN).collect()}
    for k, t in rows:
        ids = plain.encode_ordinary(t or "")
        assert got[k].n_tokens == len(ids) and got[k].ids == "clash" and got[k].text == (t or "")
        assert got[k].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[k].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    coded = bpe.encode(df, RANKS, PATTERN, offsets=True)
    for r in bpe.decode(coded, RANKS, PATTERN).collect():
        assert bytes(r.decoded) == (r.text or "").encode() and len(r.starts) == len(r.ids)
        assert all(0 <= s < len(r.text) for s in r.starts) and r.starts == sorted(r.starts)
    assert bpe.round_trip(df.limit(0), RANKS, PATTERN).count() == 0


def test_characters_that_tokens_split():
    codec = bpe.Codec.of(RANKS, PATTERN)
    text = "日🙂本"
    ids = codec.encode([text])[0].tolist()
    assert len(ids) > 3 and codec.char_offsets(text)[0] == 0 and set(codec.char_offsets(text)) == {0, 1, 2} and len(codec.char_offsets(text)) == len(ids)


def test_common_words_are_learned_once(plain, monkeypatch):
    """When the memory is full, what comes again is taken from the older one."""
    monkeypatch.setattr(bpe, "REMEMBERED", 60)
    codec = bpe.Codec(RANKS, PATTERN)
    seen, encode_pieces = [], codec._encode_pieces
    codec._encode_pieces = lambda found: seen.extend(found) or encode_pieces(found)
    for k in range(40):
        text = "x the common, words é日 " + " ".join(f"rare{chr(97 + k % 26)}{chr(97 + k // 26)}{chr(97 + j)}" for j in range(8)) + " ."
        assert codec.encode([text])[0].tolist() == plain.encode_ordinary(text)
        assert len(codec.spaced) <= 30 and len(codec.older[" "]) <= 30
    assert seen.count(" the") == seen.count(" words") == 1
