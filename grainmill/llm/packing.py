"""Operator 8: packing documents into sequences by the sum-of-squares rule."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import binary_text, table

CAPACITY = 2048
REMEMBERED = 300_000
#: Pieces that one task packs together; more pieces only mean more such groups.
GROUP_PIECES = 12_000


class WordIds(dict):
    """Ids (little-endian, 32 bits) of a string without ASCII white space, by the library on first use.

    The tokenizer turns white space into single spaces and then drops it, so no token spans it and none of the
    steps (composition, lower case, splitting, merges, added tokens) looks across it.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self._encode, self._merge = whole.encode, whole.model.tokenize

    def __missing__(self, word: bytes) -> bytes:
        core, tail = (word[:-1], word[-1:]) if word[-1] in b".,;:!?" else (word, b"")
        if core.isalpha():  # ASCII letters: lower case is all that the tokenizer's first steps do to them
            ids = [t.id for t in self._merge(core.lower().decode())] + [t.id for t in self._merge(tail.decode())] * bool(tail)
        else:
            ids = self._encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) < REMEMBERED:
            self[word] = packed
        return packed


@lru_cache(2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each document's ids and the end id, cut only if above the capacity."""
    source = binary_text(docs, "doc_id")
    schema = source.select("doc_id").schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, end, size = word_ids(tokenizer_path).__getitem__, int(end_id).to_bytes(4, "little"), 4 * capacity
        for b in batches:
            rows, out = [], ([], [], [], [])
            for i, x in enumerate(b.column(1)):
                ids = b"".join(map(get, x.as_py().split())) + end
                for k, at in enumerate(range(0, len(ids), size)):
                    part = ids[at : at + size]
                    rows.append(i)
                    for o, v in zip(out, (k, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        o.append(v)
            made = [pa.array(o, t) for o, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *made], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return source.mapInArrow(run, f"{schema}, piece int, start long, length long, ids_crc32 long")


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset for each length, placed in the given order.

    count[h] is the number of open bins with a gap of h. A piece of length s goes into a gap h (or a new bin,
    h = capacity) for which the sum of count[h]**2 over open gaps becomes smallest: moving a bin from h to h - s
    changes it by 2 * (count[h - s] - count[h] + 1), by 1 - 2 * count[h] if that closes the bin, by
    2 * count[capacity - s] + 1 if the bin is new. Of equals the smallest gap is taken, a new bin last.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for i, s in enumerate(lengths.tolist()):
        here = count[s:capacity]
        change = 2 * (count[: capacity - s] - here) + 2
        if len(change):
            change[0] = 1 - 2 * here[0]
            change[here == 0] = 1 << 40
            best = int(change.argmin())
            value = int(change[best])
        fresh = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        if s < capacity and len(change) and value <= fresh:
            h = s + best
            k = stacks[h].pop()
            count[h] -= 1
        else:
            h, k, made = capacity, made, made + 1
        bins[i], offsets[i] = k, capacity - h
        if h > s:
            stacks[h - s].append(k)
            count[h - s] += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each row of docs.

    Null, empty and blank texts are the end id alone. Repeated rows are packed once each. A long text is one row whose
    ids are held at once. Pieces are dealt out into groups of about group_pieces, packed one group a task, longest
    first; a sequence never mixes groups, so what is left open at a group's end is the price (under one in a hundred
    sequences). Only doc_id and text are read, whatever other columns are named. An empty table gives no rows.
    """
    pieces = table(cut_pieces(docs, tokenizer_path, capacity), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in pieces.schema)}, sequence_id long, offset long"

    def one(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns(["_group"]).sort_by([("length", "descending"), ("ids_crc32", "ascending"), ("doc_id", "ascending"), ("piece", "ascending")])
        bins, offsets = sum_of_squares(rows.column("length").to_numpy(), capacity)
        return rows.append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    # Dealt one after the other along the written table: groups are even, whatever repeats in it.
    return pieces.withColumn("_group", F.pmod(F.monotonically_increasing_id(), F.lit(groups))).groupBy("_group").applyInArrow(one, schema)
