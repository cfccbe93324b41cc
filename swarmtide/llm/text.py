"""Texts of Arrow batches as flat byte buffers, for operators that work with numpy.

A piece holds whole texts of up to ``PIECE`` bytes together (a longer text is a piece of
its own), so working memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Bytes of text that are worked on at a time.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER[9:14] = 32


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n + 1 offsets of a string or binary column; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def pieces(column: pa.Array, size: int = PIECE) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for runs of whole texts of up to ``size`` bytes."""
    raw, at = flat(column)
    n, first = len(at) - 1, 0
    while first < n:
        last = int(np.searchsorted(at, at[first] + size, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield slice(first, last), raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of some texts, A-Z lower-cased, each followed by one space.

    ``joined``: the words' bytes. ``start`` and ``end``: of each word there. ``first``:
    n + 1 word numbers, where each text's words begin.
    """

    def __init__(self, raw: np.ndarray, at: np.ndarray) -> None:
        low = _LOWER[raw]
        inside = low != 32
        left = np.empty(len(low), bool)
        left[1:] = inside[:-1]
        edges = at[:-1][at[:-1] < len(low)]
        left[edges] = False
        begins = inside & ~left
        heads = np.flatnonzero(begins)
        order = np.cumsum(begins)[inside]
        size = len(order)
        joined = np.full(size + len(heads), 32, np.uint8)
        joined[np.arange(size) + order - 1] = low[inside]
        lengths = np.bincount(order - 1, minlength=len(heads)) if size else np.zeros(0, np.int64)
        self.end = np.cumsum(lengths + 1) - 1
        self.start = self.end - lengths
        self.joined = joined
        self.first = np.searchsorted(heads, at)
        self.first[-1] = len(heads)

    def __len__(self) -> int:
        return len(self.start)


def slices(batch: pa.RecordBatch, column: int, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with whole texts of up to ``size`` bytes together."""
    for rows, _, _ in pieces(batch.column(column), size):
        yield batch.slice(rows.start, rows.stop - rows.start)


def nested(rows: list[np.ndarray]) -> pa.Array:
    """A list column of 32-bit integers."""
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int32), *rows])))


def extended(df: DataFrame, kept: list[str], ddl: str) -> StructType:
    """Schema of the kept columns and then the new ones."""
    return StructType(df.select(*(f"`{c}`" for c in kept)).schema.fields + StructType.fromDDL(ddl).fields)


def mapped(df: DataFrame, kept: list[str], run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """``run`` over batches of the kept columns; what it yields has the columns of ``schema`` in order. Names may hold dots."""
    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema.fields)])

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in run(batches):
            yield pa.RecordBatch.from_arrays(batch.columns, names=plain.names)

    inner = df.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)))
    return inner.mapInArrow(renamed, plain).toDF(*schema.names)
