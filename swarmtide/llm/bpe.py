"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

Texts are split by the vocabulary's pattern; each match is encoded on its own, once per
worker and not once per place (words repeat), by a ``tokenizers`` BPE model over
the byte-to-character alphabet. The ranks give the merges: an entry comes from the one pair of entries that is left of it
when all lower ranks have been merged, and a match that is an entry is that entry. The library tells which ids belong to which
match, and by its offsets in which character a token begins.

Decoding turns ids into characters, characters back into bytes by the reversed table, and
only then joins bytes to text, so characters whose bytes lie in several tokens come
back whole.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from swarmtide.llm.text import extended, mapped, nested, slices

#: Encoded chunks of a kind that a worker remembers; half of them are the latest.
REMEMBERED = 600_000
#: Two white-space characters in a row.
DOUBLE = re.compile(r"\s\s")
#: Below it, letters are what both Python and the pattern call letters.
LATIN = "\u0250"
MARKS = frozenset(".,;:!?)")


def byte_alphabet() -> list[str]:
    """A printable character for each byte: itself where printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each entry of several bytes, by rising rank. Entries that no pair makes are left out."""
    out = []
    for token in sorted(ranks, key=ranks.__getitem__):
        most = ranks[token]
        lower = lambda x: ranks.get(x, most) < most
        found = [(token[:i], token[i:]) for i in range(1, len(token)) if lower(token[:i]) and lower(token[i:])]
        if len(found) > 1:  # what is left after all lower merges, the lowest first
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                rank, i = min((ranks.get(a + b, most), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if rank >= most:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            found = [tuple(parts)] if len(parts) == 2 else []
        out += found
    return out


#: Stands between pieces until they are spelled; no byte decodes to it.
SEPARATOR = "\u2028"


class Codec:
    """Encoder and decoder of one worker."""

    _made: dict[tuple[str, str], Codec] = {}

    def __init__(self, path: str, pattern: str) -> None:
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        ranks = read_ranks(path)
        alphabet = byte_alphabet()
        self.spelling = {b: c for b, c in enumerate(alphabet)} | {ord(SEPARATOR): " "}
        spell = lambda token: token.decode("latin-1").translate(self.spelling)
        byte_of = {c: b for b, c in enumerate(alphabet)}
        self.split = regex.compile(pattern).findall
        vocab = {spell(token): rank for token, rank in ranks.items()}
        pairs = [(spell(a), spell(b)) for a, b in merges(ranks)]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=pairs, cache_capacity=0, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()  # no byte's character is white space
        self.bytes_of = {rank: bytes(map(byte_of.__getitem__, spelled)) for spelled, rank in vocab.items()}
        self.kind = np.uint16 if max(ranks.values()) < 1 << 16 else np.uint32
        self.digits = {rank: str(rank) for rank in ranks.values()}
        self.line = self.spelling | {255: " "}  # no UTF-8 holds this byte: it may stand between pieces
        self.memory: dict[str, bytes] = {}
        self.spaced: dict[str, bytes] = {}
        self.older: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    @classmethod
    def of(cls, path: str, pattern: str) -> Codec:
        """The worker's codec; the rank file is read once."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(path, pattern)
        return cls._made[path, pattern]

    def _spelled(self, found: list[str]) -> tuple[list[int], np.ndarray, list[int]]:
        """Ids of pieces, which all go to the library as one line; where each token begins, and each piece, in characters of the line."""
        spelled = [x.encode().decode("latin-1") for x in found]
        coded = self.model.encode(SEPARATOR.join(spelled).translate(self.spelling), add_special_tokens=False)
        begins = np.cumsum([0, *(len(x) + 1 for x in spelled)])
        return coded.ids, np.fromiter((i for i, _ in coded.offsets), np.int64, len(coded.ids)), begins

    def _encode_pieces(self, found: list[str]) -> list[bytes]:
        """Ids of each piece. All go to the library as one line; it tells which piece each id belongs to."""
        line = b"\xff".join(map(str.encode, found)).decode("latin-1").translate(self.line)
        coded = self.model.encode(line, add_special_tokens=False)
        raw = np.array(coded.ids, self.kind).tobytes()
        ends = np.cumsum(np.bincount(np.array(coded.word_ids, np.int64), minlength=len(found))) * np.dtype(self.kind).itemsize
        ends = ends.tolist()
        return [raw[i:j] for i, j in zip([0, *ends], ends)]

    def _parts(self, chunk: str) -> list[str]:
        """Matches of the pattern in a chunk."""
        if chunk[0] == " " and max(chunk) < LATIN:  # one word, or a word and one mark
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in MARKS and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.split(chunk)

    def learn(self, memory: dict[str, bytes], chunks: set[str], before: str) -> None:
        """Remembers the ids of chunks that are not known yet; ``before`` stands before each of them.

        A full memory becomes the older one, from which comes back what is met again: common words are learned once.
        """
        new = [x for x in chunks if x not in memory]
        if len(memory) + len(new) > REMEMBERED // 2:
            self.older[before] = memory.copy()
            memory.clear()
            new = list(chunks)
        if older := self.older[before]:
            memory.update((x, older[x]) for x in new if x in older)
            new = [x for x in new if x not in older]
        for i in range(0, len(new), 10_000):
            some = new[i : i + 10_000]
            if before == " ":  # after a space a word is one match
                words = [x for x in some if x.isalpha() and (x.isascii() or max(x) < LATIN)]
                memory.update(zip(words, self._encode_pieces([" " + x for x in words]) if words else ()))
                some = [x for x in some if x not in memory]
            parts = {x: self._parts(before + x) for x in some}
            pieces = list(set(chain.from_iterable(parts.values())))
            known = dict(zip(pieces, self._encode_pieces(pieces))) if pieces else {}
            for x, found in parts.items():
                memory[x] = b"".join(map(known.__getitem__, found)) if len(found) != 1 else known[found[0]]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text.

        No match crosses a space that follows no white space and precedes none, so texts without
        double white space are cut there; others are cut into their matches.
        """
        rows: list[tuple[list[str], list[str]]] = []  # chunks; chunks without the space before them
        for text in texts:
            if DOUBLE.search(text):
                rows.append((self.split(text), []))
            else:
                head, *tail = text.split(" ")
                rows.append(([head] if head else [], tail))
        self.learn(self.memory, set(chain.from_iterable(x for x, _ in rows)), "")
        self.learn(self.spaced, set(chain.from_iterable(x for _, x in rows)), " ")
        of, of_spaced = self.memory.__getitem__, self.spaced.__getitem__
        return [np.frombuffer(b"".join(chain(map(of, x), map(of_spaced, y))), self.kind) for x, y in rows]

    def decode(self, ids: list[int]) -> bytes:
        """Bytes of the ids, joined before anything reads them as characters."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def char_offsets(self, text: str) -> list[int]:
        """The character of ``text`` in which each of its tokens begins."""
        _, at, begins = self._spelled(self.split(text))
        if not len(at):
            return []
        raw = np.frombuffer(text.encode(), np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        return char[at - np.searchsorted(begins, at, side="right") + 1].tolist()


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", offsets: bool = False) -> DataFrame:
    """Adds ``ids`` (array of int), and with ``offsets`` also ``starts``: each token's first character.

    A null text counts as empty and gets an empty array. Other columns pass through; a column that is
    already called ``ids`` or ``starts`` is replaced. ``path`` is a rank file that every executor can open.
    """
    new = ["ids", *["starts"] * offsets]
    kept = [c for c in df.columns if c not in new]
    schema = extended(df, kept, ", ".join(f"{name} array<int>" for name in new))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for part in slices(batch, kept.index(text)):
                texts = [x or "" for x in part.column(kept.index(text)).to_pylist()]
                ids = codec.encode(texts)
                columns = [nested([x.astype(np.int32) for x in ids])]
                if offsets:
                    columns.append(nested([np.array(codec.char_offsets(t), np.int32) for t in texts]))
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=[*kept, *new])

    return mapped(df, kept, run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded`` (binary) from ``ids``; null ids decode to no bytes. Cast it to string where it is whole text."""
    kept = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            out = [codec.decode(x or []) for x in batch.column(kept.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*kept, "decoded"])

    return mapped(df, kept, run, extended(df, kept, "decoded binary"))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass and replaces it by what came back.

    Adds ``n_tokens`` (long), ``ids_sha256`` (of the decimal ids, joined by one space) and ``decoded_sha256``;
    these names replace columns of the same name. Null counts as empty, and comes back empty.
    """
    new = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [c for c in df.columns if c not in new]
    at = kept.index(text)
    schema = extended(df, kept, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(path, pattern)
        for batch in batches:
            for part in slices(batch, at):
                rows = [x.tolist() for x in codec.encode([x or "" for x in part.column(at).to_pylist()])]
                back = [codec.decode(x) for x in rows]
                columns = part.columns
                columns[at] = pa.array(back, pa.binary()).cast(part.schema.field(at).type)
                listed = (" ".join(map(codec.digits.__getitem__, x)).encode() for x in rows)
                columns += [
                    pa.array([len(x) for x in rows], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in listed]),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back]),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *new])

    return mapped(df, kept, run, schema)
