"""Deduplication: exact by fingerprint, across batches, by vectors, by word overlap, by MinHash."""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.text import fingerprint, word_list
from grainmill.operators.components import connected_components
from grainmill.sources.scratch import drop_table, small, table, with_numbers


def with_fingerprint(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn("_fingerprint", fingerprint(F.coalesce(F.col(text), F.lit(""))))


def marked_copies(df: DataFrame, order: str, key: str = "_fingerprint") -> DataFrame:
    """df with _dedup_reason: exact_duplicate for all but the first of a key by `order`.

    Rows that tie on `order` stand as they are read; those without it come last. A _dedup_reason that df
    has already is replaced. df is computed and written once, with a number for each row. The first rows of repeated keys come from a narrow aggregate that combines before the shuffle
    and is written, so that the join with the rows' keys is a broadcast, or one whose hot keys Spark splits; whole rows
    meet only the numbers of later copies, which are unique. A null key is no copy of another.
    """
    held = table(df.drop("_dedup_reason").withColumn("_gm_row", F.monotonically_increasing_id()), "rows")
    narrow = held.select(F.col(key).alias("_gm_key"), F.struct(F.col(order).isNull().alias("n"), F.col(order).alias("o"), F.col("_gm_row").alias("r")).alias("_gm_at"))
    first = table(narrow.groupBy("_gm_key").agg(F.count("*").alias("_gm_n"), F.min("_gm_at").alias("_gm_first")).where("_gm_n > 1").drop("_gm_n"), "first")
    later = table(narrow.join(small(first, 80), "_gm_key").where("_gm_at > _gm_first").select("_gm_at.r").withColumnRenamed("r", "_gm_row"), "later")
    drop_table(first)
    return held.join(small(later, 16).withColumn("_dedup_reason", F.lit("exact_duplicate")), "_gm_row", "left").drop("_gm_row")


def exact(df: DataFrame, order: str, key: str = "_fingerprint") -> tuple[DataFrame, DataFrame]:
    """(kept, removed)."""
    marked = marked_copies(df, order, key)
    return marked.where("_dedup_reason IS NULL").drop("_dedup_reason"), marked.where("_dedup_reason IS NOT NULL")


def against(df: DataFrame, existing: DataFrame, key: str = "_fingerprint") -> tuple[DataFrame, DataFrame]:
    """(rows whose key is not in existing, rows whose key is); both are plain hash joins on the key."""
    known = existing.select(key).distinct()
    return df.join(known, key, "left_anti"), df.join(known, key, "left_semi").withColumn("_dedup_reason", F.lit("exact_duplicate"))


def fingerprints(df: DataFrame, text: str = "text") -> DataFrame:
    return with_fingerprint(df, text).select("_fingerprint").distinct()


def sha256(df: DataFrame, text: str = "text") -> DataFrame:
    """Extension: the stronger digest of the exact text."""
    return df.withColumn("_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def padded(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows of one matrix, shorter ones filled up with zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(lists), width))
    out[np.repeat(np.arange(len(lists)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


#: Vectors that are compared at a time, and of one cell, about, where cells tell vectors apart.
BLOCK = 1024
#: Bytes of the vectors that a task holds while others stream past. Where cells do not tell vectors apart, there are as many parts of so many
#: bytes as it takes, and PARTS of BLOCK vectors or more at most otherwise: a vector is moved to each of them.
HELD_BYTES, PARTS = 32 << 20, 8
#: What moving a row costs, in comparisons, and how often it may be moved in exchange for fewer of them.
MOVE, MOVES = 1024, 4
#: Cells at most, and bytes of their pivots: these are sent to all tasks.
CELLS, PIVOT_BYTES = 1024, 16 << 20
#: Slack of distances, for their rounding.
SLACK = 1e-9


class Cells:
    """A metric partition: a vector lies in the cell of its nearest pivot, cells lie in rings around their pivots.

    For inner products of at least `least`, |x - y|^2 = |x|^2 + |y|^2 - 2 xy is at most reach(x)^2 = |x|^2 + top^2 - 2 least,
    with top the longest vector's norm. So y can lie in a cell only if x is no farther than reach(x) from its half-space
    (between the two pivots) and from its ring.
    """

    def __init__(self, pivots: np.ndarray, top: float, least: float):
        self.pivots, self.top, self.least = pivots, top, least
        self.apart = np.sqrt(np.maximum(self._squares(pivots), 0))

    def _squares(self, v: np.ndarray) -> np.ndarray:
        return (v * v).sum(1)[:, None] + (self.pivots * self.pivots).sum(1)[None] - 2 * v @ self.pivots.T

    def home(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each vector and its distance from the pivot."""
        d = self._squares(v)
        at = d.argmin(1)
        return at, np.sqrt(np.maximum(d[np.arange(len(v)), at], 0))

    def reached(self, v: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells beyond a vector's own (by number) that its partners may lie in; inner, outer: the rings."""
        squares = self._squares(v)
        home = squares.argmin(1)
        d = np.sqrt(np.maximum(squares, 0))
        reach = np.sqrt(np.maximum((v * v).sum(1) + self.top**2 - 2 * self.least, 0))[:, None] + 1e-6
        near = (d >= inner[None] - reach) & (d <= outer[None] + reach)
        near &= squares - squares[np.arange(len(v)), home][:, None] <= 2 * self.apart[home] * reach + SLACK
        near &= np.arange(len(self.pivots))[None] > home[:, None]
        return np.nonzero(near)


def vector_classes(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(classes, members): equal vectors are one class, a (its smallest key) and v; members has b and a of all others.

    Vectors that are null or hold null or non-finite components, and null keys, take no part. Vectors too short to be
    similar to themselves are classes of their own. Copies are counted before they are moved: the hot ones meet in an
    aggregate that combines within each task.
    """
    held = df.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("k"), F.transform(F.col(vector), lambda x: x.cast("double")).alias("v"))
    held = table(held.withColumn("own", F.when(dot(F.col("v"), F.col("v")) < least, F.col("k"))), "vectors")
    classes = table(held.groupBy("v", "own").agg(F.min("k").alias("a"), F.count("*").alias("n")), "classes")
    several = table(classes.where("n > 1").select("v", "a"), "several")
    width = held.select(F.coalesce(F.max(F.size("v")), F.lit(0))).first()[0]
    members = held.where("own IS NULL").join(small(several, 8 * width + 16), "v").where("k > a").select(F.col("k").alias("b"), "a").distinct()
    return classes.select("a", "v"), table(members, "members")


def _partition(drawn: np.ndarray, top: float, least: float, n: int, cells: int | None, fewest: int, most: int) -> Cells:
    """Cells around the first of the drawn vectors: as many as asked for, else as many (fewest to most) as seem to cost least.

    The others of the drawn vectors, looked at with rings around all, tell how often a vector would be copied. More cells than the
    fewest are taken only if a vector is moved MOVES times at most, or no more often. This decides only what a job costs.
    """
    best, bound = None, MOVES
    for k in [cells] if cells else sorted({fewest, *(c for c in (16, 64, 256, 1024) if fewest < c < most), most} if n else {0}):
        partition = Cells(drawn[:k], top, least)
        if cells or not len(drawn):
            return partition
        at, far = partition.home(drawn)
        inner, outer = np.full(k, np.inf), np.full(k, -np.inf)
        np.minimum.at(inner, at, far)
        np.maximum.at(outer, at, far)
        rest = drawn[most:] if len(drawn) > most else drawn
        moves = 1 + len(partition.reached(rest, inner, outer)[0]) / len(rest)
        cost = moves * (MOVE + n / k)
        bound = max(bound, moves) if best is None else bound
        if moves <= bound and (best is None or cost <= best[0]):
            best = (cost, partition)
    return best[1]


def class_pairs(classes: DataFrame, least: float, cells: int | None = None, moved: list | None = None, across: str | None = None) -> DataFrame:
    """(a, b, sim) with a < b for all pairs of classes (a, v) whose inner product is at least `least`, by cells of a metric partition.

    A shorter vector counts as if it ended in zeros. Pivots are a bounded sample, in a hashed order. Each vector stays in its
    own cell and is copied to those of greater number that its partners may lie in: at high thresholds to few of clustered
    vectors. Of vectors spread evenly over many dimensions no bound tells the cells apart; there are then few, of up to HELD_BYTES,
    so that a vector is moved for each of those, not for each BLOCK. A larger cell is dealt out in parts; a task holds one part and
    lets the other vectors stream past it. cells: their number, if not by the rows. moved: a list that gets the number of vectors so
    dealt. across: a boolean column; only pairs of which one has it are wanted.
    """
    n, width, top = classes.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(dot(F.col("v"), F.col("v"))), F.lit(0.0))).first()
    width = max(1, width)
    most = max(1, min(CELLS, PIVOT_BYTES // (8 * width), n))
    sample = classes.select("v", F.xxhash64("a").alias("h"), "a").orderBy("h", "a").limit(2 * most).collect()  # bounded by CELLS and PIVOT_BYTES
    drawn = np.zeros((len(sample), width))
    for row, r in zip(drawn, sample, strict=True):
        row[: len(r["v"])] = r["v"]
    per = max(BLOCK, HELD_BYTES // (8 * width))
    # Few rows are dealt out as well, to several tasks.
    per = min(per, max(BLOCK, -(-n // PARTS)))
    partition = _partition(drawn, float(np.sqrt(top)), least, n, min(cells, most) if cells else None, min(most, max(1, -(-n // per))), most)
    k = len(partition.pivots)

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at, far = partition.home(padded(b.column("v"), width))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("v"), b.column("x"), pa.array(at, pa.int32()), pa.array(far)], names=["a", "v", "x", "cell", "far"])

    homes = table(classes.select("a", "v", F.col(across) if across else F.lit(False).alias("x")).toDF("a", "v", "x").mapInArrow(settle, "a long, v array<double>, x boolean, cell int, far double"), "cells")
    inner, outer, parts = np.full(k, np.inf), np.full(k, -np.inf), np.ones(k, np.int64)
    for r in homes.groupBy("cell").agg(F.min("far").alias("i"), F.max("far").alias("o"), F.count("*").alias("n")).collect():  # one row for each of at most CELLS cells
        inner[r["cell"]], outer[r["cell"]], parts[r["cell"]] = r["i"] - SLACK, r["o"] + SLACK, -(-r["n"] // per)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector to its part (held) and the later parts of its cell, and to all parts of the cells that it reaches."""
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                piece = b.slice(at, BLOCK)
                key, home = piece.column("a").to_numpy(), piece.column("cell").to_numpy().astype(np.int64)
                part = ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts[home]
                row, cell = partition.reached(padded(piece.column("v"), width), inner, outer)
                times = parts[cell]
                later = parts[home] - part - 1
                rows = np.concatenate([np.arange(len(key)), np.repeat(np.arange(len(key)), later), np.repeat(row, times)])
                to = np.concatenate([home, np.repeat(home, later), np.repeat(cell, times)])
                count = lambda n: np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                parts_of = np.concatenate([part, np.repeat(part + 1, later) + count(later), count(times)])
                visit = np.arange(len(rows)) >= len(key)
                for i in range(0, len(rows), 4 * BLOCK):
                    s = slice(i, i + 4 * BLOCK)
                    yield pa.RecordBatch.from_arrays([*(piece.column(c).take(pa.array(rows[s])) for c in ("a", "v", "x")), pa.array(to[s], pa.int32()), pa.array(parts_of[s]), pa.array(visit[s])], names=["a", "v", "x", "cell", "part", "visit"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by cell and part, those that the part holds first; each batch is compared with what is held."""
        here, keys, held, old = None, [], [], []
        for b in batches:
            if not b.num_rows:
                continue
            k, v, visit, x = b.column("a").to_numpy(), padded(b.column("v"), width), b.column("visit").to_numpy(zero_copy_only=False), b.column("x").to_numpy(zero_copy_only=False)
            group = b.column("cell").to_numpy().astype(np.int64) << 32 | b.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(group[1:] != group[:-1]) + 1), len(group)]
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if group[lo] != here:
                    here, keys, held, old = group[lo], [], [], []
                own = lo + int((~visit[lo:hi]).sum())
                # What is held is kept in pieces; a row that is held as well meets those before it.
                for at in range(lo, hi, BLOCK):
                    to = min(at + BLOCK, hi)
                    if at < own:
                        keys.append(k[at : min(to, own)]), held.append(v[at : min(to, own)]), old.append(x[at : min(to, own)])
                    for i in range(len(keys)):
                        sim = v[at:to] @ held[i].T
                        r, c = np.nonzero(sim >= least - 1e-12)
                        good = (at + r >= own) | (i < len(keys) - 1) | (c < r)
                        if across:
                            good &= x[at + r] != old[i][c]
                        r, c = r[good], c[good]
                        if len(r):
                            p, q = k[at + r], keys[i][c]
                            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(sim[r, c])], names=["a", "b", "sim"])

    dealt = homes.select("a", "v", "x", "cell").mapInArrow(deal, "a long, v array<double>, x boolean, cell int, part long, visit boolean")
    if moved is not None:
        moved.append(dealt.count())
    sorted_rows = dealt.repartition("cell", "part").sortWithinPartitions("cell", "part", "visit")
    return sorted_rows.mapInArrow(compare, "a long, b long, sim double").where((F.col("sim") >= least) & (F.col("a") < F.col("b")))


def similar_pairs(df: DataFrame, least: float, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(a, b, sim) with a < b: pairs of vectors whose inner product is at least `least`, equal vectors standing as one.

    Of each class of equal vectors the smallest key has all its pairs with other classes, and one with each other
    member of its own; those have no pairs beside that one. Vectors that take no part: see vector_classes().
    """
    classes, members = vector_classes(df, least, key, vector)
    own = members.join(classes, "a").select("a", "b", dot(F.col("v"), F.col("v")).alias("sim"))
    return class_pairs(classes, least).unionByName(own)


#: Vectors of the first range of keys, about; each further range ends at GROWTH times as many.
FIRST, GROWTH = 4096, 4


def _across(held: DataFrame, rows: DataFrame, least: float) -> DataFrame:
    """k, near, sim: vectors of rows (a, v) with those of held (a, v), none of which is in rows, that are similar. Few held ones are sent to the tasks, more meet by cells."""
    n, width = held.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1))).first()
    width = max(1, width, rows.select(F.coalesce(F.max(F.size("v")), F.lit(1))).first()[0])
    if n * width * 8 > HELD_BYTES // 2:
        flag = lambda df, x: df.select("a", "v", F.lit(x).alias("x"))
        pairs = class_pairs(table(flag(held, True).unionByName(flag(rows, False)), "across"), least, across="x")
        pairs = table(pairs.select(F.col("b").alias("k"), F.col("a").alias("near"), "sim").unionByName(pairs.select(F.col("a").alias("k"), F.col("b").alias("near"), "sim")), "across")
        return pairs.join(small(held.select(F.col("a").alias("near")), 16), "near").select("k", "near", "sim")
    sent = held.select("a", "v").toArrow()  # HELD_BYTES / 2 at most
    keys, vectors = sent.column("a").to_numpy(), padded(sent.column("v"), width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, v = b.column("a").to_numpy(), padded(b.column("v"), width)
            for at in range(0, len(k), BLOCK):
                for i in range(0, len(keys), 4 * BLOCK):
                    sim = v[at : at + BLOCK] @ vectors[i : i + 4 * BLOCK].T
                    r, c = np.nonzero(sim >= least)
                    if len(r):
                        yield pa.RecordBatch.from_arrays([pa.array(k[at + r]), pa.array(keys[i + c]), pa.array(sim[r, c])], names=["k", "near", "sim"])

    return rows.select("a", "v").mapInArrow(compare, "k long, near long, sim double")


def _independent(pairs: DataFrame) -> DataFrame:
    """k, kept: the nodes of pairs (a, b), a < b, and whether they are in the first independent set in order of key.

    Each round decides the rows that have a kept earlier neighbour (out), or only removed ones (kept); rounds end when all are decided.
    """
    state = table(pairs.select(F.col("b").alias("k")).union(pairs.select("a")).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state")
    while True:
        earlier = pairs.join(state.select(F.col("k").alias("a"), F.col("kept").alias("ka")), "a").groupBy("b").agg(F.max(F.coalesce("ka", F.lit(False))).alias("some"), F.max(F.col("ka").isNull()).alias("open"))
        now = state.join(earlier.withColumnRenamed("b", "k"), "k", "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("some", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)
        after = table(now.select("k", decided.alias("kept")), "state")
        drop_table(state)
        state = after
        if state.where("kept IS NULL").isEmpty():
            return state


def _first_independent(classes: DataFrame, least: float) -> DataFrame:
    """a, v: the classes of the first independent set in order of key, by ranges of keys.

    Each range is decided among those of its classes that no kept one of an earlier range is similar to. Most pairs of a dense table
    are so never made: what is left of a range has few of them, however many its classes have in all.
    """
    n, cuts, at = classes.count(), [], FIRST
    while at < n:
        cuts.append(at / n)
        at *= GROWTH
    cuts = sorted(set(classes.approxQuantile("a", cuts, 0.001))) if cuts else []
    left, kept = classes, []
    for cut in [*cuts, None]:
        mine = left if cut is None else table(left.where(F.col("a") <= cut), "range")
        pairs = table(class_pairs(mine, least).select("a", "b"), "pairs")
        state = _independent(pairs)
        kept.append(table(mine.join(small(state.where("NOT kept").select(F.col("k").alias("a")), 16), "a", "left_anti"), "kept"))
        drop_table(pairs)
        if cut is not None:
            later = left.where(F.col("a") > cut)
            out = table(_across(kept[-1], later, least).select(F.col("k").alias("a")).distinct(), "out")
            left = table(later.join(small(out, 16), "a", "left_anti"), "left")
    out = kept[0]
    for k in kept[1:]:
        out = out.unionByName(k)
    return out


def semantic(df: DataFrame, least: float = 0.92, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """df with _dedup_reason (semantic_duplicate or null) and _sim_score: a row goes if a kept earlier row is that similar.

    The kept rows are the first independent set in order of key, found by ranges (_first_independent); only classes of equal vectors
    are compared, and all but the first of a class go in any case. A removed row's score comes from the kept ones alone.
    Keys are the order and must be unique: rows that share one are decided together.
    """
    classes, members = vector_classes(df, least, key, vector)
    kept = _first_independent(classes, least)
    gone_rows = table(classes.join(small(kept.select("a"), 16), "a", "left_anti"), "gone")
    gone = gone_rows.select(F.col("a").alias("k"))
    # Kept classes near each removed one; a later copy may have more of them before it than the first of its class. The slack takes a
    # product that came out otherwise, by rounding, when the row was decided.
    near = table(_across(kept, gone_rows, least - SLACK).select(F.col("k").alias("a"), "near", "sim"), "near")
    self_sim = classes.join(small(members.select("a").distinct(), 16), "a").select("a", dot(F.col("v"), F.col("v")).alias("sim"))
    of_first = near.where("near < a").select(F.col("a").alias("k"), "sim")
    of_copies = members.join(near, "a").where("near < b").select(F.col("b").alias("k"), "sim")
    of_kept = members.join(small(gone.withColumnRenamed("k", "a"), 16), "a", "left_anti").join(self_sim, "a").select(F.col("b").alias("k"), "sim")
    best = of_first.unionByName(of_copies).unionByName(of_kept).groupBy("k").agg(F.round(F.max("sim"), 4).alias("_sim_score"))
    out = best.select("k", F.lit("semantic_duplicate").alias("_dedup_reason"), "_sim_score")
    rest = df.select(*[c for c in df.columns if c not in ("_dedup_reason", "_sim_score")])
    return rest.join(out, rest[key] == out["k"], "left").drop(out["k"])


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.size(b))


#: Rows of one range of the fold, about.
RANGE = 4096
_FOLD = "block int, kind int, o long, near_of long, copy boolean, g string, w array<string>, f string"


def _fold(least: float, window: int):
    """Folds rows (block, kind, o, g, w, f, known, was, redone), sorted by block and kind, into rows of _FOLD.

    Kind 0 are the accepted rows that a range finds before it, kind 1 those that it was given the time before (if any), kind 2
    its own, with what they were near to then (`was`, if `redone`). Where the windows of both times are the same, the rest is the same as
    well and is not compared again (not with values of f, which reach farther than a window). What comes out: kind 1, each
    own row's result; kind 2, the accepted rows that the next range finds; kind 3, marks of the window found (o) and left
    (near_of), from the numbers of their rows; kind 4, the rows found.
    """

    def mark(g: str | None, held: list) -> int:
        return int.from_bytes(hashlib.blake2b(repr((g, list(held)) if held else None).encode(), digest_size=8).digest(), "big", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split(" ")[0] for f in _FOLD.split(", ")]
        shape = pa.schema([("block", pa.int32()), ("kind", pa.int32()), ("o", pa.int64()), ("near_of", pa.int64()), ("copy", pa.bool_()), ("g", pa.string()), ("w", pa.list_(pa.string())), ("f", pa.string())])
        block, out = None, []
        # The window: numbers and sets of words (or words not yet looked at), and the numbers it had the time before.
        held, sets, old = deque(maxlen=window), deque(maxlen=window), deque(maxlen=window)

        def left():
            yield from ((block, 2, o, None, None, group, list(w) if isinstance(w, set) else w.as_py(), None) for o, w in zip(held, sets, strict=True))
            yield (block, 3, found if found is not None else mark(group, held), mark(group, held), None, None, None, None)

        def flushed(rows):
            return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=shape)

        for b in batches:
            words = b.column(4)
            for i, (at, kind, o, g, f, known, was, redone) in enumerate(zip(*[b.column(c).to_pylist() for c in (0, 1, 2, 3, 5, 6, 7, 8)], strict=True)):
                if at != block:
                    if block is not None:
                        out.extend(left())
                    block, group, old_group, found, seen, settled = at, g, None, None, set(), False
                    held.clear(), sets.clear(), old.clear()
                if kind == 0:
                    group = g
                    held.append(o), sets.append(set(words[i].as_py() or ()))
                    out.append((block, 4, o, None, None, g, None, None))
                    continue
                if kind == 1:
                    old_group = g
                    old.append(o)
                    continue
                if found is None:
                    found = mark(group, held)
                if g != group:
                    group = g
                    held.clear(), sets.clear()
                if g != old_group:
                    old_group = g
                    old.clear()
                settled = settled or (redone and f is None and held == old)
                if settled:
                    near, copy = was, False
                    if near is None:
                        held.append(o), sets.append(words[i])
                else:
                    copy = f is not None and (known or f in seen)
                    mine = set(words[i].as_py() or ())
                    near, n = None, len(mine)
                    if n and not copy:
                        # Sets whose sizes are too far apart cannot reach the share: they are not intersected.
                        near = next((k for k, w in zip(held, sets, strict=True) if w and (n / len(w) if n < len(w) else len(w) / n) >= least and len(mine & w) / max(n, len(w)) >= least), None)
                    if near is None and not copy:
                        held.append(o), sets.append(mine)
                        if f is not None:
                            seen.add(f)
                    if redone and was is None:
                        old.append(o)
                out.append((block, 1, o, near, copy, None, None, f))
                if len(out) >= 4096:
                    yield flushed(out)
                    out = []
        if block is not None:
            out.extend(left())
        yield flushed(out)

    return run


def overlap_window(df: DataFrame, order: str, text: str = "text", least: float = 0.85, window: int = 200, group: str | None = None, copy_of: str | None = None, block: int = RANGE) -> DataFrame:
    """order, near_of (order of the accepted row it is near to, or null), copy: an ordered fold over the last `window` accepted rows.

    A row is near to another if their sets of words share `least` of the larger one; a row that is near to none in the
    window is accepted. copy_of: a column in which accepted rows are told apart: a row whose value an accepted row of any
    distance before it has is a copy, is compared with nothing and not accepted. group: a column in which folds are apart.
    Numbers of `order` are unique; texts without words are accepted.

    The rows are sorted and numbered, and each `block` of them is a range; ranges are folded side by side, at first as if nothing stood before them. A range
    whose window is not the one that the range before it leaves, or in which another row is a copy than was taken, is folded
    anew, until there is none: the first range is right from the start, and each round at least the next one, so the
    result is that of the fold in sequence. Where two folds have accepted the same rows for a window, they go on alike, so few
    ranges need more than two rounds. Each round writes its results; a task holds a window.
    """
    key = F.col(group).cast("string") if group else F.lit(None).cast("string")
    # Texts are sorted as they are: a sort looks at its rows twice, to sample them and to move them.
    held = df.select(key.alias("g"), F.col(order).cast("long").alias("o"), F.col(text).alias("t"), (F.col(copy_of) if copy_of else F.lit(None)).cast("string").alias("f"))
    held = table(held.orderBy("g", "o").withColumn("_gm_row", F.monotonically_increasing_id()), "sorted")
    words = F.array_distinct(word_list(F.lower(F.coalesce("t", F.lit("")))))
    rows = table(with_numbers(held).select("g", "o", words.alias("w"), "f", F.expr(f"int((_gm_number - 1) DIV {block})").alias("block")), "ranges")
    drop_table(held)
    blocks = (rows.agg(F.max("block")).first()[0] or 0) + 1
    if copy_of:
        repeated = table(rows.where("f IS NOT NULL").groupBy("f").agg(F.count("*").alias("n")).where("n > 1").select("f", F.lit(True).alias("again")), "repeated")
        marked = table(rows.join(small(repeated, 64), "f", "left").withColumn("f", F.when(F.col("again"), F.col("f"))).drop("again"), "ranges")
        drop_table(rows)
        drop_table(repeated)
        rows = marked
    last = rows.select("block").distinct().withColumn("before", F.lag("block").over(Window.partitionBy(F.lit(0)).orderBy("block")))  # one row for each range
    last = table(last, "range-order")
    fold = _fold(least, window)
    nothing = F.lit(None).cast("boolean")

    def folded(of: DataFrame, *windows: DataFrame) -> DataFrame:
        own = of.select("block", F.lit(2).alias("kind"), "o", "g", "w", "f", "known", "was", "redone")
        for kind, w in enumerate(windows):
            own = own.unionByName(w.select("block", F.lit(kind).alias("kind"), "o", "g", "w", F.lit(None).cast("string").alias("f"), nothing.alias("known"), F.lit(None).cast("long").alias("was"), nothing.alias("redone")))
        return own.repartition(blocks, "block").sortWithinPartitions("block", "kind", "o").mapInArrow(fold, _FOLD)

    state, known = table(folded(rows.withColumns({"known": nothing, "was": F.lit(None).cast("long"), "redone": nothing})), "folds"), None
    while True:
        marks = state.where("kind = 3").select("block", F.col("o").alias("found"), F.col("near_of").alias("left"))
        before = marks.select(F.col("block").alias("before"), F.col("left").alias("there"))
        redo = last.join(marks, "block").join(before, "before").where("found != there").select("block", "before")
        if copy_of:
            # From which range on a value is taken; ranges behind the old or the new one, that hold it, change.
            taken = table(state.where("kind = 1 AND f IS NOT NULL AND NOT copy AND near_of IS NULL").groupBy("f").agg(F.min("block").alias("at")), "taken")
            moved = taken.withColumn("was", F.lit(None).cast("int")) if known is None else taken.join(known.withColumnRenamed("at", "was"), "f", "full")
            moved = table(moved.where("NOT (at <=> was)").withColumns({"lo": F.least("at", "was"), "hi": F.when(F.col("at").isNotNull() & F.col("was").isNotNull(), F.greatest("at", "was"))}), "moved")
            again = rows.where("f IS NOT NULL").select("f", "block").distinct().join(small(moved, 80), "f").where("block > lo AND (hi IS NULL OR block <= hi)").select("block").distinct()
            redo = redo.unionByName(again.join(last, "block").select("block", "before")).distinct()
            known = taken
        redo = table(redo, "redo")
        if redo.isEmpty():
            break
        of = rows.join(small(redo.select("block"), 8), "block")
        of = of.join(small(known, 80), "f", "left").withColumn("known", F.coalesce(F.col("at") < F.col("block"), F.lit(False))).drop("at") if copy_of else of.withColumn("known", nothing)
        windows = state.where("kind = 2").select(F.col("block").alias("before"), "o", "g", "w").join(small(redo, 16), "before")
        if copy_of:
            of, given = of.withColumns({"was": F.lit(None).cast("long"), "redone": nothing}), []
        else:
            was = state.where("kind = 1").join(small(redo.select("block"), 8), "block").select("o", F.col("near_of").alias("was"), F.lit(True).alias("redone"))
            of, given = of.join(small(was, 16), "o"), [state.where("kind = 4").select("block", "o", "g", "w").join(small(redo.select("block"), 8), "block")]
        done = table(folded(of, windows, *given).unionByName(state.join(small(redo.select("block"), 8), "block", "left_anti")), "folds")
        drop_table(state)
        state = done
    return state.where("kind = 1").select(F.col("o").alias("order"), "near_of", "copy")


#: Distinct sets of one part of a neighbourhood.
PART = 256
#: Words that a task counts common ones of at a time.
COLUMNS = 8192


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
        return x ^ (x >> np.uint64(31))


def _classes_of_size(least: float, largest: int) -> list[int]:
    """First sizes of classes of sizes: sets that are `least` alike lie in one class or in neighbouring ones."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(int(firsts[-1] / least + 1e-9) + 1)
    return firsts + [int(firsts[-1] / least + 1e-9) + 1, int(firsts[-1] / least**2 + 1e-9) + 2]


def _signature(words: np.ndarray, least: float, firsts: list[int]) -> np.ndarray:
    """Hashes of a set's parts, of which two different sets that are `least` alike share one, whatever the words.

    Words are dealt to parts by a hash. Sets of a class of sizes and the next one differ in at most `apart` words, so of more parts
    than that some are the same; each set has those of its own class and those of the one below. Parts without words are the same in
    many sets, and count only where a set has so many that all others may differ; its partner then has as many.
    """
    own = int(np.searchsorted(firsts, len(words), side="right")) - 1
    out = []
    for c in (own - 1, own):
        apart = int(2 * (firsts[c + 2] - 1) * (1 - least) / (1 + least) + 1e-9) if c >= 0 else 0
        if not apart:
            continue  # only equal sets are so alike
        n = apart + 2 + apart // 24
        mixed = _mixed(words + np.uint64(c))
        part = ((mixed >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        sums = np.zeros(n, np.uint64)
        np.add.at(sums, part, mixed)
        used = np.bincount(part, minlength=n) > 0
        if n - int(used.sum()) >= n - apart:
            used[:] = True
        out.append(_mixed(_mixed(sums[used] + np.uint64(c << 32)) + np.flatnonzero(used).astype(np.uint64)))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def _sketch(words: np.ndarray) -> bytes:
    """As many bits as words or more, each the parity of the words that are hashed to it. Two sets differ in at least as many words as their sketches in bits.

    Halves of a sketch, one upon the other, are the next shorter one.
    """
    bits = max(64, 1 << (len(words) - 1).bit_length())
    place = (_mixed(words ^ np.uint64(0x9E3779B97F4A7C15)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits) & 1).tobytes()


def _hopeful(sketches: list[bytes], sizes: np.ndarray, side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): each set that has others, across sides if given, that its sketch does not rule out, with the first set that they connect it to."""
    width = 8 * min(map(len, sketches))
    signs = np.stack([np.bitwise_xor.reduce(np.unpackbits(np.frombuffer(s, np.uint8)).reshape(-1, width), axis=0) for s in sketches]).astype(np.float32) * 2 - 1
    both = sizes[:, None] + sizes
    good = (width - signs @ signs.T) / 2 <= both * (1 - least) / (1 + least) + 1e-9
    good &= np.minimum(sizes[:, None], sizes) >= least * np.maximum(sizes[:, None], sizes) - 1e-9
    if side is not None:
        good &= side[:, None] != side
    label = np.arange(len(sizes))
    for i, j in zip(*np.nonzero(np.triu(good, 1)), strict=True):
        if label[i] != label[j]:
            x, y = sorted((label[i], label[j]))
            label[label == y] = x
    i = np.flatnonzero(label != np.arange(len(sizes)))
    return i, label[i]


def _by_groups(rows: DataFrame, close, out: str) -> DataFrame:
    """close(rows of one (center, lo, hi), sides or None), a batch, for each such group of rows (center, lo, hi, at, s, ...); one group at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            group = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            if group.num_rows > 1:
                yield close(group, None if here[1] == here[2] else group.column("at").to_numpy())

        for b in batches:
            groups = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            edges = [i for i in range(len(groups)) if i == 0 or groups[i] != groups[i - 1]]
            for lo, hi in zip(edges, [*edges[1:], len(groups)], strict=True):
                if groups[lo] != here and held:
                    yield from ended()
                    held = []
                here = groups[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from ended()

    return rows.repartition("center", "lo", "hi").sortWithinPartitions("center", "lo", "hi", "s").mapInArrow(run, out)


def _in_blocks(groups: DataFrame) -> DataFrame:
    """center, lo, hi, at, s of groups (center, s): one of up to PART sets is one task's, a larger one becomes all pairs of hashed blocks of about that."""
    blocks = table(groups.groupBy("center").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"), F.count("*").alias("n")).where("n > 1").drop("n"), "blocks")
    dealt = groups.join(small(blocks, 24), "center").withColumn("at", F.pmod(F.xxhash64("s"), F.col("parts").cast("long")).cast("int"))
    dealt = dealt.select("center", "s", "at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return dealt.select("center", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "at", "s")


def alike(sets: list[np.ndarray], side: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, jaccard) with i < j of all pairs of sets, across sides if given, that are `least` alike: every pair is counted, as a product of matrices."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(flat, return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        both += part @ part.T
    share = both / (sizes[:, None] + sizes - both)
    good = np.triu(share >= least, 1)
    if side is not None:
        good &= side[:, None] != side
    i, j = np.nonzero(good)
    return i, j, share[i, j]


def minhash(df: DataFrame, key: str, text: str = "text", least: float = 0.85) -> DataFrame:
    """Extension: (a, b, jaccard) of word sets that are `least` alike, found by hashed parts of the sets; none is missed.

    Equal word sets are one from the start, held by their smallest key: each further row of a set is returned with that key and 1.0.
    Sets that share a hash (see _signature) form a neighbourhood. There sketches tell which sets may be alike; what they let through
    connects sets into clusters, and only those are moved, once for each block of a cluster, and verified. Words of one 64-bit
    hash count as one, and sets of one 64-bit hash.
    """
    words = F.array_distinct(word_list(F.lower(F.coalesce(F.col(text), F.lit("")))))
    rows = df.select(F.col(key).alias("k"), F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))).alias("w"), F.monotonically_increasing_id().alias("row"))
    # Without words: left out behind the table, as a filter before it would split each text twice.
    rows = table(rows.withColumn("s", F.xxhash64("w")), "words").where("size(w) > 0")
    named = table(rows.groupBy("s").agg(F.min("k").alias("a"), F.count("*").alias("n")), "named")
    copies = rows.select("s", F.col("k").alias("b")).join(small(named.where("n > 1").select("s", "a"), 24), "s").where("b > a").select("a", "b", F.lit(1.0).alias("jaccard")).distinct()
    # The sets, each once: of rows with a set in common only the first is looked at; rows repeated as a whole are told apart by number.
    again = table(rows.select("s", "row").join(small(named.where("n > 1").select("s"), 8), "s").groupBy("s").agg(F.min("row").alias("kept")), "again")
    sets = rows.join(small(again, 16), "s", "left").where("kept IS NULL OR kept = row").select("s", "w")
    firsts = _classes_of_size(least, rows.agg(F.coalesce(F.max(F.size("w")), F.lit(1))).first()[0])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = b.column(1).values.to_numpy().view(np.uint64), b.column(1).offsets.to_numpy().tolist()
            held = [flat[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]
            signed = pa.array([_signature(w, least, firsts).view(np.int64) for w in held], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(w) for w in held], pa.int64()), pa.array([_sketch(w) for w in held], pa.binary()), signed], names=["s", "n", "bits", "h"])

    def narrow(group: pa.RecordBatch, side: np.ndarray | None) -> pa.RecordBatch:
        s, (i, j) = group.column("s"), _hopeful(group.column("bits").to_pylist(), group.column("n").to_numpy(), side, least)
        return pa.RecordBatch.from_arrays([s.take(pa.array(i)), s.take(pa.array(j))], names=["a", "b"])

    def verify(group: pa.RecordBatch, side: np.ndarray | None) -> pa.RecordBatch:
        words, s = group.column("w"), group.column("s")
        i, j, share = alike([words[x].values.to_numpy().view(np.uint64) for x in range(len(words))], side, least)
        return pa.RecordBatch.from_arrays([s.take(pa.array(i)), s.take(pa.array(j)), pa.array(share)], names=["x", "y", "jaccard"])

    signed = table(sets.mapInArrow(sign, "s long, n long, bits binary, h array<bigint>"), "signed")
    hashes = signed.select(F.explode("h").alias("h"), "s")
    # Counted in an aggregate that combines within each task, and written, so that the join is a broadcast or one whose hot keys Spark splits.
    shared = table(hashes.groupBy("h").agg(F.min("s").alias("center"), F.max("s").alias("_most")).where("center != _most").drop("_most"), "shared")
    met = table(hashes.join(small(shared, 16), "h").select("center", "s").distinct(), "met")
    drop_table(shared)
    drawn = _in_blocks(met).join(signed.select("s", "n", "bits"), "s").select("center", "lo", "hi", "at", "s", "n", "bits")
    near = table(_by_groups(drawn, narrow, "a long, b long").distinct(), "near")
    clusters = table(connected_components(near).select(F.col("root").alias("center"), F.col("node").alias("s")), "clusters")
    for t in (signed, met, near):
        drop_table(t)
    wanted = table(sets.join(small(clusters.select("s"), 8), "s", "left_semi"), "wanted")
    moved = _in_blocks(clusters).join(wanted, "s").select("center", "lo", "hi", "at", "s", "w")
    pairs = _by_groups(moved, verify, "x long, y long, jaccard double")
    of = lambda s, k: small(named.join(small(clusters.select("s"), 8), "s", "left_semi").select(F.col("s").alias(s), F.col("a").alias(k)), 24)
    pairs = pairs.join(of("x", "_kx"), "x").join(of("y", "_ky"), "y").where("_kx != _ky")
    return pairs.select(F.least("_kx", "_ky").alias("a"), F.greatest("_kx", "_ky").alias("b"), "jaccard").unionByName(copies)


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first by order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")
