"""Operator 7: removal of repeated byte strings by distributed prefix doubling over sampled suffixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import RollingHash, binary_text, byte_slices, document_key, drop_table, mix64, table

LENGTH = 100
#: Length of the first rank; suffixes start where such a string is the least of all in some window of LENGTH bytes.
FIRST = 32
TILE = 2 << 20
#: Windows that a task ranks at a time.
WINDOWS = 1 << 20
_PLACE_BITS = np.uint64(22)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, tile: int = TILE) -> np.ndarray:
    """Fingerprints of short spans, whose values do not depend on where they stand; a long text is hashed a tile at a time."""
    if len(data) <= tile:
        return RollingHash(data).spans(start, end)
    out = np.zeros(len(start), np.uint64)
    for at in range(0, len(data), tile):
        here = np.flatnonzero((start >= at) & (start < at + tile))
        if len(here):
            out[here] = RollingHash(data[at : int(end[here].max())]).spans(start[here] - at, end[here] - at)
    return out


def _in_parts(sizes: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of entries with about `most` in all, at least one entry each."""
    ends, i = np.cumsum(sizes), 0
    while i < len(sizes):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + most, side="right")))
        yield slice(i, j)
        i = j


def sampled_suffixes(data: np.ndarray, offsets: np.ndarray, length: int, first: int) -> tuple[np.ndarray, ...]:
    """For each run of windows of `length` bytes with one least `first`-byte string: row, rank, hash of the run's bytes, window start, last start, place of the string.

    The least string of a window depends on the window's bytes alone (the leftmost of equals), so equal windows
    have it at the same place: every repeated window is met again at a sampled suffix of the same rank.
    """
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    n = len(data)
    if n < length:
        return none
    rolling = RollingHash(data)
    start = np.arange(n - first + 1)
    rank = rolling.spans(start, start + first)
    low = np.uint64((1 << int(_PLACE_BITS)) - 1)
    least, width, want = (rank & ~low) | start.astype(np.uint64), 1, length - first + 1
    while 2 * width <= want:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < want:
        least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
    place = (least & low).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    windows = np.flatnonzero(np.arange(len(place)) + length <= offsets[row + 1])
    if not len(windows):
        return none
    place, row = place[windows], row[windows]
    cut = np.flatnonzero((place[1:] != place[:-1]) | (row[1:] != row[:-1])) + 1
    lo, hi = windows[np.concatenate([[0], cut])], windows[np.concatenate([cut - 1, [len(windows) - 1]])]
    row, place = row[np.concatenate([[0], cut])], place[np.concatenate([[0], cut])]
    whole = rolling.spans(lo, hi + length) * np.uint64(257) + (place - lo).astype(np.uint64)
    base = offsets[row]
    return row, rank[place], whole, lo - base, hi - base, place - base


def _tiles(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """As byte_slices, with a long row in overlapping pieces: first row, place in the row, bytes, offsets."""
    for i, _, data, off in byte_slices(column):
        if len(off) > 2 or len(data) <= TILE:
            yield i, 0, data, off
        else:
            for at in range(0, len(data) - length + 1, TILE):
                part = data[at : at + TILE + length - 1]
                yield i, at, part, np.array([0, len(part)])


def _known(ids: np.ndarray, order: tuple[np.ndarray, ...], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(known, rank): rows of a batch that an earlier row of it with equal ids precedes are known to repeat.

    order: the place, as keys for lexsort (least first). Known rows get ranks of their own, so that common strings
    do not meet in one task: they are decided already. Rows of one place are not earlier than each other.
    """
    by = np.lexsort((*order[::-1], ids))
    same = np.concatenate([[False], ids[by][1:] == ids[by][:-1]])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))
    later = np.zeros(len(by), bool)
    for o in order:
        later |= o[by] != o[by][head]
    known = np.zeros(len(by), bool)
    known[by] = same & later
    own = mix64(order[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + order[1].astype(np.uint64))
    return known, np.where(known, own, rank)


def _suffixes(docs: DataFrame, length: int, first: int) -> DataFrame:
    """_d, rank, whole, at, known: one row for each sampled suffix; at packs start << 16 | place - start << 8 | last start - start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at, data, off in _tiles(b.column(1), length):
                row, rank, whole, lo, hi, place = sampled_suffixes(data, off, length, first)
                packed = (lo + at) << 16 | (place - lo) << 8 | (hi - lo)
                doc = b.column(0).to_numpy()[row + i]
                known, rank = _known(mix64(rank) ^ whole, (doc, packed), rank)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rank.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(packed), pa.array(known)], names=["_d", "rank", "whole", "at", "known"])

    return binary_text(docs.select(document_key(docs), "text"), "_d").mapInArrow(run, "_d long, rank long, whole long, at long, known boolean")


def _with_text(docs: DataFrame, lists: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """_d, _bytes, keys and the column of lists. Texts are shuffled once and streamed past a hash table of the short lists; never sorted."""
    return binary_text(docs.select(document_key(docs), *keys, "text"), "_d", *keys).join(lists.hint("shuffle_hash"), "_d", how)


def _longer(docs: DataFrame, live: DataFrame, length: int, first: int) -> DataFrame:
    """Doubles: ranks of about twice the first length to the right and to the left of the live suffixes; unique ones go.

    A window of LENGTH bytes around a suffix holds all of the right string or all of the left one.
    """
    reach = (length - first) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, x, ats in zip(b.column(0), b.column(1), b.column(2), strict=True):
                at = np.asarray(ats.values)
                lo, to, wide = at >> 16, (at >> 8) & 255, at & 255
                place = lo + to
                data = np.frombuffer(x.as_buffer(), np.uint8)
                right, left = lo + wide >= place - reach, lo < place - reach
                out = []
                for side, mask, s, e in ((0, right, place, place + first + reach), (1, left, place - reach - 1, place + first)):
                    out.append((span_hashes(data, s[mask], e[mask]).view(np.int64), at[mask], np.full(int(mask.sum()), side, np.int32)))
                cols = [np.concatenate(c) for c in zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), d.as_py(), np.int64)), *map(pa.array, cols)], names=["_d", "rank", "at", "side"])

    lists = table(live.groupBy("_d").agg(F.collect_list("at").alias("_at")), "live")
    pairs = _with_text(docs, lists).mapInArrow(run, "_d long, rank long, at long, side int")
    seen = F.count("*").over(Window.partitionBy("rank", "side"))
    kept = table(pairs.withColumn("_n", seen).where("_n > 1").select("_d", "at", "side"), "longer")
    drop_table(lists)
    return kept


def _windows(docs: DataFrame, live: DataFrame, length: int, first: int) -> DataFrame:
    """_d, at: windows (start << 16) that begin earlier elsewhere, among those of the live suffixes: ranks of the full length."""
    reach = (length - first) // 2

    def ranked(*parts: list[np.ndarray]) -> pa.RecordBatch:
        doc, rank, start = map(np.concatenate, parts)
        known, rank = _known(rank, (doc, start), rank)
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(rank.view(np.int64)), pa.array(start), pa.array(known)], names=["_d", "rank", "start", "known"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs_of, ranks, starts, held = [], [], [], 0
            for d, x, ats in zip(b.column(0), b.column(1), b.column(2), strict=True):
                data = np.frombuffer(x.as_buffer(), np.uint8)
                packed = np.asarray(ats.values)
                at, side = packed >> 1, packed & 1
                lo, hi, place = at >> 16, (at >> 16) + (at & 255), (at >> 16) + ((at >> 8) & 255)
                lo, hi = np.where(side == 0, np.maximum(lo, place - reach), lo), np.where(side == 1, np.minimum(hi, place - reach - 1), hi)
                order = np.argsort(lo, kind="stable")
                lo, n = lo[order], (hi - lo + 1)[order]
                for part in _in_parts(n, WINDOWS):
                    k = n[part]
                    start = np.repeat(lo[part] - np.cumsum(k) + k, k) + np.arange(int(k.sum()))
                    base, top = int(start.min()), int(start.max()) + length
                    docs_of.append(np.full(len(start), d.as_py(), np.int64))
                    ranks.append(span_hashes(data[base:top], start - base, start - base + length))
                    starts.append(start)
                    held += len(start)
                    if held >= WINDOWS:
                        yield ranked(docs_of, ranks, starts)
                        docs_of, ranks, starts, held = [], [], [], 0
            if held:
                yield ranked(docs_of, ranks, starts)

    lists = table(live.groupBy("_d").agg(F.collect_list(F.shiftleft("at", 1).bitwiseOR(F.col("side").cast("long"))).alias("_at")), "live")
    ranks = _with_text(docs, lists).mapInArrow(run, "_d long, rank long, start long, known boolean")
    place = F.rank().over(Window.partitionBy("rank").orderBy("_d", "start"))
    return ranks.withColumn("_k", place).where("known OR _k > 1").select("_d", F.shiftleft("start", 16).alias("at"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """_d (document_key) and spans array<bigint> (start, end, start, end ...): bytes to remove, maximal and in order.

    Three rounds of ranks at growing lengths, in each of which Spark sorts (rank, place) and drops what is unique:
    `first` bytes at sampled suffixes, twice that to either side, then all `length` bytes of the windows left.
    Suffixes whose whole surroundings (the hash `whole`) occur earlier need no further round, and what a task sees to
    repeat within its own rows is decided there: common strings are thinned before they are moved.
    """
    at_rank, in_class = Window.partitionBy("rank"), Window.partitionBy("rank", "whole").orderBy("_d", "at")
    ranked = _suffixes(docs, length, first).withColumns({"_fd": F.first("_d").over(in_class), "_fa": F.first("at").over(in_class)})
    ranked = ranked.withColumns({"_one": F.min("whole").over(at_rank), "_two": F.max("whole").over(at_rank)})
    again = F.col("known") | (F.col("_d") != F.col("_fd")) | (F.col("at") != F.col("_fa"))
    ranked = table(ranked.select("_d", "at", again.alias("again"), (F.col("_one") != F.col("_two")).alias("others")).where("again OR others"), "ranked")
    live = ranked.where("NOT again").select("_d", "at").distinct()
    longer = _longer(docs, live, length, first)
    found = ranked.where("again").select("_d", "at").unionByName(_windows(docs, longer, length, first))
    lists = found.groupBy("_d").agg(F.collect_list("at").alias("_at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for ats in b.column(1):
                at = np.unique(np.asarray(ats.values))
                start, end = at >> 16, np.maximum.accumulate((at >> 16) + (at & 255) + length)
                head = np.concatenate([[True], start[1:] > end[:-1]])
                spans.append(np.stack([start[head], end[np.concatenate([head[1:], [True]])]], 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["_d", "spans"])

    out = table(lists.mapInArrow(run, "_d long, spans array<bigint>"), "spans")
    drop_table(ranked)
    drop_table(longer)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, first: int = FIRST) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans, kept (bytes): each row of docs without the bytes that repeat earlier ones.

    Null and empty texts have no bytes; texts under `length` bytes lose none. Rows without a doc_id come before all others
    and are told apart by their texts. Rows with one doc_id must hold one text; such repeated rows are one place, so neither removes the other, and each
    is returned. Long texts are hashed in overlapping tiles. An empty table gives no rows. Further columns of
    docs do not matter. Only the suffixes that are the least 32-byte string of some window take part, some 3 in 100: all
    windows that repeat are met at one of them.
    """
    spans = repeated_spans(docs, length, first)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, spans array<bigint>, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, removed, kept = [], [], []
            for x, found in zip(b.column(1), b.column(2), strict=True):
                data = x.as_buffer().to_pybytes()
                cut = found.as_py() or []
                edges = [0, *cut, len(data)]
                rest = b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)) if cut else data
                n.append(len(data))
                removed.append(len(data) - len(rest))
                kept.append(rest)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), b.column(2), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return _with_text(docs, spans, "doc_id", how="left").select("doc_id", "_bytes", "spans").mapInArrow(run, schema)


def digest(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of remove_repeats()."""
    out = remove_repeats(docs, length)
    return out.select("doc_id", "n_bytes", "n_removed", F.coalesce(F.size("spans") / 2, F.lit(0)).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")).withColumn("n_spans", F.greatest(F.lit(0).cast("long"), "n_spans"))
