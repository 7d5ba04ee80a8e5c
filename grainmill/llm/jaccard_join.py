"""Operator 6: n-gram Jaccard join. Rare-first prefixes find candidates, a count-vector R-tree bounds their overlap, survivors are verified."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import binary_text, byte_slices, document_key, drop_table, mix64, real_id, small, table, word_hashes
from grainmill.llm.components import connected_components, forest

WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Shingles to a group, about: the groups that tokens are hashed to are the coordinates of the count vectors, and
#: their number is a power of two that follows the size of the set. Halves of a vector add up to the next coarser one.
PER_GROUP, LEAST_GROUPS = 8, 16
#: Entries of a leaf of the tree, and of its inner nodes.
LEAF = 16
#: Sets of one block, and their shingles' bytes; larger neighbourhoods are dealt out as pairs of such blocks.
BLOCK, BLOCK_BYTES = 256, 32 << 20
#: Bytes of texts that a task makes shingles of at a time: hashing holds some 40 times as many.
SLICE_BYTES = 1 << 19
#: Shingles that a task counts common ones of at a time.
COLUMNS = 8192
#: Columns of the rows that tasks compare.
DEALT = ("_key", "_lo", "_hi", "_at", "set_id", "n", "made")
#: Counters of shingles, each shared by those that are hashed to it: how many documents hold them, over all documents. They
#: give the order of prefixes, rare shingles first; any order finds every link.
COUNTERS = 1 << 20
#: Rows that hold them, each a run of counters: what tasks hand on are few rows, not one for each counter.
COUNTER_PARTS = 64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingles of each row."""
    hashes, begin = word_hashes(data, offsets, lower=True)
    n = len(hashes)
    with np.errstate(over="ignore"):
        salts = mix64(np.arange(1, words + 1, dtype=np.uint64))
        whole = np.zeros(max(n - words + 1, 0), np.uint64)
        for k in range(words):
            whole = mix64(whole + hashes[k : k + len(whole)] * (salts[k] | np.uint64(1)))
    out = []
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(whole[a : b - words + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for i in range(a, b):
                short = mix64(short * np.uint64(31) + hashes[i : i + 1])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sliced_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """Runs of about SLICE_BYTES of a column of texts: first row, last row (exclusive), their shingles. A single longer text comes alone."""
    for i, j, data, off in byte_slices(column, SLICE_BYTES):
        yield i, j, shingle_sets(data, off, words)


def _set_id(shingles: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([np.bitwise_xor.reduce(mix64(shingles + np.uint64(77))) + shingles.sum() * np.uint64(0x9E3779B97F4A7C15)]))[0].view(np.int64))


def count_vector(shingles: np.ndarray) -> np.ndarray:
    groups = max(LEAST_GROUPS, 1 << max(0, len(shingles) // PER_GROUP).bit_length())
    return np.bincount(((shingles >> np.uint64(32)) & np.uint64(groups - 1)).astype(np.int64), minlength=groups)


class Counts:
    """How many documents hold the shingles of each counter."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts

    def ordered(self, shingles: np.ndarray) -> np.ndarray:
        """One order of all shingles: by the count of their counter, the least first, then by value. Given in order of value."""
        return shingles[np.argsort(self.counts[(shingles & np.uint64(len(self.counts) - 1)).astype(np.int64)], kind="stable")]


def _partial_counts(docs: DataFrame, words: int) -> DataFrame:
    """part, counts: every document's shingles, counted; a task hands on its sums as COUNTER_PARTS rows at most, in the least width that holds them."""
    size, share = COUNTERS, COUNTERS // COUNTER_PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for b in batches:
            for _, _, sets in sliced_sets(b.column(0), words):
                counts += np.bincount((np.concatenate(sets) & np.uint64(size - 1)).astype(np.int64), minlength=size)
        parts = np.flatnonzero(counts.reshape(-1, share).any(1)).tolist()
        held = [(x := counts[p * share : (p + 1) * share]).astype(np.min_scalar_type(int(x.max()))).tobytes() for p in parts]
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(held, pa.binary())], names=["part", "counts"])

    return binary_text(docs.select("text")).mapInArrow(run, "part int, counts binary")


def _frequent(docs: DataFrame, words: int) -> Counts:
    """The sums of all tasks' counts, each part's in one task, which adds row after row."""
    size, share, most = COUNTERS, COUNTERS // COUNTER_PARTS, np.iinfo(np.int32).max

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for part, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                sums.setdefault(part, np.zeros(share, np.int64))
                sums[part] += np.frombuffer(held, f"u{len(held) // share}").astype(np.int64)
        rows = [np.minimum(x, most).astype(np.int32).tobytes() for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(rows, pa.binary())], names=["part", "counts"])

    counts = np.zeros(size, np.int32)
    for part, held in _partial_counts(docs, words).repartition("part").mapInArrow(add, "part int, counts binary").collect():  # COUNTER_PARTS rows, 4 bytes a counter
        counts[part * share : (part + 1) * share] = np.frombuffer(held, np.int32)
    return Counts(counts)


def _prefix(shingles: np.ndarray, frequent: Counts, numerator: int, denominator: int) -> np.ndarray:
    """The first shingles in one order of all shingles: two sets that link share one of them."""
    n = len(shingles)
    return frequent.ordered(shingles)[: n - (n * numerator + denominator - 1) // denominator + 1]


class Tree:
    """A packed R-tree over count vectors: leaves of neighbours in size and first coordinates, nodes over nodes, each with the top of its bounding box and its least size.

    For a query vector the sum over coordinates of min(query, box top) bounds its overlap with any set below the node;
    the sum of min(query, vector) bounds that with one set. (A box's floor bounds nothing from above, so it is not kept.) A link of sets of a and b shingles needs an overlap of
    num / (num + den) of a + b.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, numerator: int, denominator: int):
        self._share = (numerator, numerator + denominator)
        order = np.lexsort((vectors[:, 1], vectors[:, 0] // 2, sizes))
        self.order, self.vectors, self.sizes = order, vectors[order], sizes[order]
        #: From the leaves up: the top of each node's box and the least size below it.
        self._levels, tops, least = [], self.vectors, self.sizes
        while not self._levels or len(tops) > LEAF:
            starts = np.arange(0, len(tops), LEAF)
            tops, least = np.maximum.reduceat(tops, starts, axis=0), np.minimum.reduceat(least, starts)
            self._levels.append((tops, least))

    @staticmethod
    def _below(nodes: np.ndarray, n: int) -> np.ndarray:
        """The entries of some nodes, of n in all on that level."""
        rows = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
        return rows[rows < n]

    def near(self, vector: np.ndarray, size: int, skip: np.ndarray) -> np.ndarray:
        """Places (in the tree's order) of sets whose bound reaches the need, best bound first; those marked in skip are passed over."""
        num, den = self._share
        rows = np.arange(len(self._levels[-1][0]))
        for level in range(len(self._levels) - 1, -1, -1):
            tops, least = self._levels[level]
            rows = rows[den * np.minimum(tops[rows], vector).sum(1) >= num * (size + least[rows])]
            rows = self._below(rows, len(self._levels[level - 1][0]) if level else len(self.order))
        rows = rows[~skip[rows]]
        bound = np.minimum(self.vectors[rows], vector).sum(1)
        good = den * bound >= num * (size + self.sizes[rows])
        return rows[good][np.argsort(-bound[good], kind="stable")]


def _linked(a: np.ndarray, b: np.ndarray, numerator: int, denominator: int) -> bool:
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    both = int((a[at] == b).sum())
    return denominator * both >= numerator * (len(a) + len(b) - both)


def _spread(vectors: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None, linked, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Pairs that connect what `linked` connects among sets within each other's bound.

    There is a tree for each vector length, over the sets of that length and, folded, of twice that: sets that
    link are no further apart (the shares of at least two thirds that this module is used with see to that). Each
    set asks its tree for sets that are not yet connected to it; a link connects two components, whose other pairs
    need no check. side: only pairs across sides are looked at (the others are another task's).
    """
    label, found = np.arange(len(vectors)), []
    width = np.array([len(v) for v in vectors])
    for g in np.unique(width).tolist():
        own, above = np.flatnonzero(width == g), np.flatnonzero(width == 2 * g)
        members = np.concatenate([own, above])
        if len(members) < 2:
            continue
        tree = Tree(np.stack([vectors[i] if width[i] == g else vectors[i][:g] + vectors[i][g:] for i in members]).astype(np.int32), sizes[members], numerator, denominator)
        place = members[tree.order]
        asked = np.zeros(len(place), bool)
        for i in np.flatnonzero(tree.order < len(own)).tolist():
            asked[i] = True  # each pair once
            skip = asked | (label[place] == label[place[i]])
            if side is not None:
                skip |= side[place] == side[place[i]]
            for j in tree.near(tree.vectors[i], int(tree.sizes[i]), skip).tolist():
                a, b = int(place[i]), int(place[j])
                if label[a] != label[b] and linked(a, b):
                    found.append((a, b))
                    label[label == label[b]] = label[a]
    return found


def bounded_links(ids: np.ndarray, vectors: list[np.ndarray], sizes: np.ndarray, side: np.ndarray | None = None, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Pairs that connect all sets whose count vectors allow a link."""
    return [(int(ids[i]), int(ids[j])) for i, j in _spread(vectors, sizes, side, lambda i, j: True, numerator, denominator)]


def spanning_links(ids: np.ndarray, sets: list[np.ndarray], side: np.ndarray | None = None, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple[int, int]]:
    """Verified links that connect what any links among these sets connect: other pairs are connected, bounded away or verified not to link."""
    sizes = np.array([len(s) for s in sets])
    pairs = _spread([count_vector(s) for s in sets], sizes, side, lambda i, j: _linked(sets[i], sets[j], numerator, denominator), numerator, denominator)
    return [(int(ids[i]), int(ids[j])) for i, j in pairs]


def set_classes(docs: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """_d, n, set_id, prefix: written once, without the texts."""
    frequent = _frequent(docs, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in sliced_sets(b.column(1), words):
                keys = [_prefix(s, frequent, numerator, denominator).view(np.int64) if len(s) else s.view(np.int64) for s in sets]
                flat, ends = np.concatenate(keys), np.cumsum([0, *map(len, keys)])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([_set_id(s) if len(s) else None for s in sets], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["_d", "n", "set_id", "prefix"])

    return table(binary_text(docs.select(document_key(docs), "text"), "_d").mapInArrow(run, "_d long, n long, set_id long, prefix array<bigint>"), "sets")


def _neighbourhoods(classes: DataFrame) -> DataFrame:
    """center, set_id, n: for each prefix shingle of several sets, all of them with the smallest. Two sets that share one meet in a neighbourhood.

    Shared shingles are counted in an aggregate that combines within each task, and written before rows are moved by them:
    the join is then a broadcast, or one of two plain exchanges, in which Spark splits a very common shingle.
    """
    keys = classes.where("n > 0").select(F.explode("prefix").alias("k"), "set_id", "n")
    shared = table(keys.groupBy("k").agg(F.min("set_id").alias("center"), F.max("set_id").alias("_most")).where("center != _most").drop("_most"), "shared")
    met = table(keys.join(small(shared, 16), "k").select("center", "set_id", "n").distinct(), "met")
    drop_table(shared)
    return met


def _dealt(groups: DataFrame, key: str) -> DataFrame:
    """_key, set_id, _at, _lo, _hi: groups of up to BLOCK sets and BLOCK_BYTES are one task's; larger ones become all pairs of hashed blocks of about that.

    Sizes are counted first and written, so that the join is a broadcast, or one whose hot keys Spark splits.
    """
    blocks = groups.groupBy(key).agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") * 8 / BLOCK_BYTES)).cast("int").alias("_nb"), F.count("*").alias("_m")).where("_m > 1").drop("_m")
    dealt = groups.join(small(table(blocks, "blocks"), 24), key).withColumn("_at", F.pmod(F.xxhash64("set_id"), F.col("_nb").cast("long")).cast("int"))
    dealt = dealt.select(key, "set_id", "_at", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)).alias("_other"))
    return dealt.select(F.col(key).alias("_key"), "set_id", "_at", F.least("_at", "_other").alias("_lo"), F.greatest("_at", "_other").alias("_hi"))


def _pairs_of(rows: DataFrame, close, after=iter) -> DataFrame:
    """a, b: what `close` finds in each run of equal (_key, _lo, _hi), one group at a time held, and `after`, in the same Python worker, makes of a task's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def ended() -> list[tuple[int, int]]:
            if len(held) < 2:
                return []
            return close(np.array(list(held)), [v[1:] for v in held.values()], None if key[1] == key[2] else np.array([v[0] for v in held.values()]))

        def batch(out: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(2)], names=["a", "b"])

        for b in batches:
            out: list[tuple[int, int]] = []
            names, *rest = [b.column(i).to_pylist() for i in range(5)], *b.columns[5:]
            for i, (k, lo, hi, side, s) in enumerate(zip(*names, strict=True)):
                if (k, lo, hi) != key:
                    out += ended()
                    key, held = (k, lo, hi), {}
                held.setdefault(s, (side, *(c[i].as_py() for c in rest)))
            if out:
                yield batch(out)
        yield batch(ended())

    return rows.repartition("_key", "_lo", "_hi").sortWithinPartitions("_key", "_lo", "_hi").mapInArrow(lambda batches: after(run(batches)), "a long, b long")


def _made(docs: DataFrame, first: DataFrame, words: int, shingles: bool) -> DataFrame:
    """set_id, n, made: the shingles of the sets of `first` (set_id, _d), or their count vectors, from their documents' texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, sets in sliced_sets(b.column(1), words):
                made = [s if shingles else count_vector(s).astype(np.uint16 if len(s) < 1 << 16 else np.uint32) for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array([m.tobytes() for m in made], pa.binary())], names=["set_id", "n", "made"])

    text = binary_text(docs.select(document_key(docs), "text"), "_d").join(small(first, 24), "_d")
    return text.select("_d", "_bytes", "set_id").mapInArrow(run, "set_id long, n long, made binary")


def _clusters(docs: DataFrame, classes: DataFrame, words: int, numerator: int, denominator: int) -> tuple[DataFrame, DataFrame]:
    """(set_id, root, n; set_id, n, made): sets whose bounds connect them, each link's ends in one cluster, and their shingles.

    What is needed of a set is made again from one document's text: no shingles are kept of all documents. First
    the trees work on count vectors alone, in each neighbourhood: what they let through connects sets into
    clusters, and each set is in one. Only then are shingles made and moved, once for each set in a cluster.
    """
    met = _neighbourhoods(classes)
    needed = met.select("set_id").distinct()
    first = table(classes.where("n > 0").groupBy("set_id").agg(F.min("_d").alias("_d"), F.first("n").alias("n")).join(needed, "set_id", "left_semi"), "first")
    vectors = table(_made(docs, first.drop("n"), words, shingles=False), "vectors")

    def bound(ids, rows, side):
        held = [np.frombuffer(v, np.uint16 if n < 1 << 16 else np.uint32).astype(np.int32) for n, v in rows]
        return bounded_links(ids, held, np.array([n for n, _ in rows]), side, numerator, denominator)

    # Pairs go as they are found into the forest of their task, which is what is written.
    near = connected_components(_pairs_of(_dealt(met, "center").join(vectors, "set_id").select(*DEALT), bound, forest), stars=True)
    clusters = table(near.select(F.col("node").alias("set_id"), "root").join(first.select("set_id", "n"), "set_id"), "clusters")
    wanted = table(first.drop("n").join(clusters.select("set_id"), "set_id", "left_semi"), "wanted")
    shingles = table(_made(docs, wanted, words, shingles=True), "shingles")
    for t in (met, first, vectors, wanted):
        drop_table(t)
    return clusters, shingles


def _roots(docs: DataFrame, classes: DataFrame, words: int, numerator: int, denominator: int) -> DataFrame:
    """set_id, root: sets with links, and the smallest set id that verified links connect each to."""

    def verify(ids, rows, side):
        return spanning_links(ids, [np.frombuffer(s, np.uint64) for _, s in rows], side, numerator, denominator)

    clusters, shingles = _clusters(docs, classes, words, numerator, denominator)
    roots = connected_components(_pairs_of(_dealt(clusters, "root").join(shingles, "set_id").select(*DEALT), verify, forest), stars=True)
    for t in (clusters, shingles):
        drop_table(t)
    return roots.withColumnsRenamed({"node": "set_id"})


def linked_weights(ids: np.ndarray, sets: list[np.ndarray], weights: np.ndarray, side: np.ndarray | None = None, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> list[tuple[int, int]]:
    """For each set that links, the sum of the weights of all other sets that it links with. Every pair is verified, as a product of matrices."""
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    _, column, held = np.unique(flat[order], return_inverse=True, return_counts=True)
    shared = held[column] > 1
    owner, column = owner[order][shared], np.unique(column[shared], return_inverse=True)[1]
    both = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        part = np.zeros((len(sets), COLUMNS), np.float32)
        part[owner[i:j], column[i:j] - at] = 1
        both += (part @ part.T).astype(np.int64)
    linked = denominator * both >= numerator * (sizes[:, None] + sizes - both)
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side
    total = linked.astype(np.int64) @ weights
    return [(int(ids[i]), int(total[i])) for i in np.flatnonzero(total)]


def join_links(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_links: one row for each row of docs, with the number of other documents (doc_ids) that it links with.

    Links are those of join_components, all of them: each pair of distinct sets in a cluster is verified in the task
    of its two blocks, which writes sums and not pairs, and each set counts as often as it has documents. Texts
    without shingles (null, empty, blank) have no links. Repeated rows are each returned and count once. A null doc_id
    stays null and is a document of its own, told from others by its text. Long texts are one set, as in join_components.
    Only doc_id and text are read, whatever other columns are named. An empty table gives no rows.
    """
    classes = set_classes(docs, words, numerator, denominator)
    clusters, shingles = _clusters(docs, classes, words, numerator, denominator)
    copies = table(classes.where("n > 0").groupBy("set_id").agg(F.countDistinct("_d").alias("_copies")), "copies")
    weighed = table(shingles.join(copies, "set_id"), "weighed")

    def count(ids, rows, side):
        return linked_weights(ids, [np.frombuffer(s, np.uint64) for _, s, _ in rows], np.array([c for *_, c in rows]), side, numerator, denominator)

    parts = _pairs_of(_dealt(clusters, "root").join(weighed, "set_id").select(*DEALT, "_copies"), count)
    others = table(parts.groupBy(F.col("a").alias("set_id")).agg(F.sum("b").alias("_others")), "others")
    # Written before they are joined, as in join_components: a set may be that of a third of all documents.
    total = table(copies.join(others, "set_id", "left").select("set_id", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("_n")), "total")
    for t in (clusters, shingles, copies, weighed, others):
        drop_table(t)
    out = classes.select("_d", "set_id").join(small(total, 24), "set_id", "left")
    return out.select(real_id(F.col("_d"), docs).alias("doc_id"), F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"))


def _components(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """_d, n, _c: the key of each row, its number of shingles, the least key of its component."""
    classes = set_classes(docs, words, numerator, denominator)
    root = _roots(docs, classes, words, numerator, denominator)
    first = classes.where("n > 0").groupBy("set_id").agg(F.min("_d").alias("_first"), F.max("_d").alias("_last"))
    # Only sets of several documents or with links need a name. Written before they are joined, as in _dealt: a
    # component may hold a third of all sets, and a set be that of a third of all documents.
    named = table(first.join(root, "set_id", "left").where("root IS NOT NULL OR _first != _last").select("set_id", F.coalesce("root", "set_id").alias("root"), "_first"), "named")
    least = table(named.groupBy("root").agg(F.min("_first").alias("_least")), "least")
    named = table(named.join(small(least, 24), "root").select("set_id", "_least"), "named")
    out = classes.select("_d", "n", "set_id").join(small(named, 24), "set_id", "left")
    return out.select("_d", "n", F.coalesce("_least", "_d").alias("_c"))


def join_components(docs: DataFrame, words: int = WORDS, numerator: int = NUMERATOR, denominator: int = DENOMINATOR) -> DataFrame:
    """doc_id, n_shingles, component_id: one row for each row of docs.

    Documents link if den * |A and B| >= num * |A or B| for their sets of distinct word shingles. component_id is the
    smallest doc_id that links reach, itself included. Equal sets are one set from the start, so groups of copies
    cost one verification, and no group's pairs are written out. Null, empty and blank texts have no shingles and
    stand alone. A null doc_id stays null, counts as the smallest, and is told from others by its text. Repeated rows
    are each returned. Long texts are one set; blocks of sets are bounded by their bytes, a single larger set comes
    alone. Only doc_id and text are read, whatever other columns are named. An empty table gives no rows.
    """
    out = _components(docs, words, numerator, denominator)
    return out.select(real_id(F.col("_d"), docs).alias("doc_id"), F.col("n").alias("n_shingles"), real_id(F.col("_c"), docs).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs without all but the first document (smallest doc_id) of each component; documents without shingles stay.

    Of repeated rows (one doc_id, one text) one stays. Rows without a doc_id come first and are told apart by their texts.
    Null, empty and blank texts stay. Long texts are one set. Columns of any name are carried along. An empty table stays empty.
    """
    own = docs.columns
    first = _components(docs).where("_c = _d").select("_d").distinct()
    held = docs.select(document_key(docs), F.xxhash64(docs["text"]).alias("_h"), F.struct(*own).alias("_row"))
    return held.join(first, "_d", "left_semi").dropDuplicates(["_d", "_h"]).select("_row.*").select(*own)
