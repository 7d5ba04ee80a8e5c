"""Shared pieces of the training-data operators: keys, word splitting, batches of bytes, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.sources.scratch import BROADCAST_BYTES, drop_table, shared_dir, small, table

__all__ = ["BROADCAST_BYTES", "drop_table", "shared_dir", "small", "table"]

#: The six white-space bytes that separate words.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: Keys of documents without a doc_id are below this.
KNOWN = -(1 << 63) + (1 << 61)


def real_id(key: Column, docs: DataFrame) -> Column:
    """The doc_id of a document_key, in its own type; null for documents without one."""
    return F.when(key >= F.lit(KNOWN), key).cast(docs.schema["doc_id"].dataType)


def document_key(docs: DataFrame, text: str = "text") -> Column:
    """`_d`, a long: doc_id, or for a null one a number far below all ids that tells its text apart; such rows come first."""
    unknown = F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64(docs[text]), 3)
    return F.coalesce(docs["doc_id"].cast("long"), unknown).alias("_d")


def word_array(text: Column) -> Column:
    """Words between runs of the six white-space characters; null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN))


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def binary_text(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """keys and the UTF-8 bytes of the text as `_bytes` (null text: empty), whatever else docs holds."""
    return docs.select(*keys, F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))


def byte_slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about `most` bytes: first row, last row (exclusive), their bytes, offsets of the rows in them.

    A single longer row comes alone.
    """
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = column.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, side="right")) - 1)
        yield i, j, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


_MULT = 0x9E3779B97F4A7C15
_INVERSE = pow(_MULT, -1, 1 << 64)
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(0)
    if have is None or len(have[0]) < n:
        with np.errstate(over="ignore"):
            size = max(n, 1 << 16)
            have = tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size, x, np.uint64))]) for x in (np.uint64(_MULT), np.uint64(_INVERSE)))
        if size <= 8 << 20:
            _POWERS[0] = have
    return have


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class RollingHash:
    """64-bit fingerprints of any spans of an array of bytes or wider numbers, from one prefix sum over random values of each."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        values = _TABLE[data] if data.dtype == np.uint8 else mix64(data.astype(np.uint64) + np.uint64(_MULT))
        np.cumsum(values * up[: len(data)], out=self._sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self._sums[end] - self._sums[start]) * self._down[start] + (end - start).astype(np.uint64))


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of all words of some rows, and where each row's words begin among them (one more entry than rows)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    rows = offsets[:-1][offsets[:-1] < len(data)]
    begins[rows] = solid[rows]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] = solid[last]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return starts, stops, np.searchsorted(starts, offsets)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case."""
    return np.where((data >= 65) & (data <= 90), data + data.dtype.type(32), data)


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some rows, and where each row's words begin (one more entry than rows)."""
    starts, stops, begin = word_spans(data, offsets)
    if not len(data):
        return np.zeros(0, np.uint64), begin
    return RollingHash(lowered(data) if lower else data).spans(starts, stops), begin
