import random

import numpy as np
import public_tokenizers
import pytest

from swarmtide.llm import token_files
from swarmtide.llm.bpe import Codec

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(files, end):
    out, start, n = [], 0, 0
    for i, x in enumerate(x for f in files for x in f):
        if x == end:
            out.append((len(out), start, n, True))
            start, n = i + 1, 0
        else:
            n += 1
    return out + ([(len(out), start, n, False)] if n else [])


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_documents_across_blocks_and_files(spark, tmp_path, block, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    rng = random.Random(2)
    files = [[rng.choice([0, 1, 2, 7, 65000]) for _ in range(rng.choice([0, 1, 5, 17, 40]))] for _ in range(11)]
    files[4], files[5], files[9] = [5] * 9, [6] * 4, [7, 7, 7]
    for k, ids in enumerate(files):
        (tmp_path / f"part-{k:03}.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = token_files.count(spark, str(tmp_path), "<u2", 7, block).collect()
    assert sorted((r.doc_no, r.start, r.n_tokens, r.closed) for r in got) == brute(files, 7)


def test_written_files_count_as_encoded(spark, tmp_path):
    texts = [None, "", "one two", "x" * 5000, "é\n\n ü", "one two"]
    df = spark.createDataFrame([(t, 1) for t in texts], "text string, value int")
    token_files.write(df.coalesce(1), str(tmp_path / "t"), RANKS, PATTERN)
    got = token_files.count(spark, str(tmp_path / "t")).orderBy("doc_no").collect()
    want = [len(x) for x in Codec.of(RANKS, PATTERN).encode([t or "" for t in texts])]
    assert [r.n_tokens for r in got] == want and all(r.closed for r in got)


def test_no_documents_and_broken_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"")
    assert token_files.count(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.bin").write_bytes(b"\0\0\0")
    with pytest.raises(Exception, match="whole ids"):
        token_files.count(spark, str(tmp_path))
