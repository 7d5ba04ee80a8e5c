"""Operator 9: exact top-k search by inner product, with pivot-table elimination."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import drop_table, table

K, SCALE, EVERY = 10, 1024, 100
#: Pivots, and the sample that they are taken from (any choice is exact; it only moves the bounds).
PIVOTS, PIVOT_SAMPLE = 32, 2000
#: Queries that one pass over the vectors asks: the only rows that are sent to its tasks. Passes of one job run side by side.
QUERY_BLOCK, JOB_BLOCKS = 4096, 16
#: Vectors of one task, and evaluated at a time.
TASK_VECTORS, STEP = 16_384, 256


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    """Rows of equal width; shorter vectors are filled up with zeros, which add nothing to a product."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(kind)
    out = np.zeros((len(lists), width), kind)
    row = np.repeat(np.arange(len(lists)), n)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Farthest-first: each next pivot is farthest from those before."""
    if not len(sample):
        return sample.astype(np.float64)
    points = sample.astype(np.float64)
    chosen, far = [0], ((points - points[0]) ** 2).sum(1)
    while len(chosen) < min(pivots, len(points)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(1))
    return points[chosen]


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """The pivot table: a row for each point."""
    p = points.astype(np.float64)
    square = (p**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * p @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def exact_scores(points: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products; those beyond it are plus or minus 2^63 - 1."""
    top, wide = (int(np.abs(points.astype(np.float64)).max()) if points.size else 0), int(np.abs(query.astype(np.float64)).max()) if query.size else 0
    if top * wide * max(1, len(query)) < 1 << 52:
        return (points.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    if top * wide * max(1, len(query)) < 1 << 62:
        return (points * query).sum(1)
    return np.array([max(1 - (1 << 63), min((1 << 63) - 1, sum(int(a) * int(b) for a, b in zip(row, query, strict=True)))) for row in points], np.int64)


def search_block(queries: np.ndarray, query_ids: np.ndarray, points: np.ndarray, ids: np.ndarray, to_point: np.ndarray, to_query: np.ndarray, k: int, best: list[list[tuple[int, int]]], floors: np.ndarray | None = None) -> int:
    """Improves best[q] (pairs of -score, id, ascending, k at most) by the points; returns how many products were evaluated.

    to_point and to_query are rows of the pivot table. With d(q, x) >= L = max over pivots of |d(q, p) - d(x, p)|,
    q.x = (|q|^2 + |x|^2 - d^2) / 2 is at most (|q|^2 + |x|^2 - L^2) / 2. Points are evaluated by falling bound, and the
    search stops at the first bound below the k-th score so far; a bound equal to it goes on, since ties go to the
    smaller id. floors: scores that k other rows are known to reach, to start from.
    """
    norm, done = (points.astype(np.float64) ** 2).sum(1), 0
    for i in range(len(queries)):
        own = float((queries[i].astype(np.float64) ** 2).sum())
        gap = np.abs(to_point - to_query[i]).max(1) if to_point.shape[1] else np.zeros(len(points))
        # Room for rounding: bounds are never too low.
        bound = (own + norm - gap**2) / 2
        bound += 1 + 1e-9 * (own + norm)
        have = best[i]
        least = -have[-1][0] if len(have) == k else None
        if floors is not None:
            least = floors[i] if least is None else max(least, floors[i])
        near = np.flatnonzero(bound >= least) if least is not None else np.arange(len(points))
        near = near[np.argsort(-bound[near], kind="stable")]
        for at in range(0, len(near), STEP):
            part = near[at : at + STEP]
            if len(have) == k and bound[part[0]] < -have[-1][0]:
                break
            score = exact_scores(points[part], queries[i])
            done += len(part)
            own_row = ids[part] == query_ids[i]
            good = ~own_row if len(have) < k else ~own_row & (score >= -have[-1][0])
            if good.any():
                pairs = [*have, *zip((-score[good]).tolist(), ids[part][good].tolist(), strict=True)]
                have = best[i] = sorted(pairs)[:k]
    return done


def known_floors(queries: np.ndarray, query_ids: np.ndarray, sample: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among the rows of a sample, less room for rounding: no result is below it; least where they are too few."""
    floors = np.full(len(queries), -np.inf)
    for at in range(0, len(queries), 256):
        score = queries[at : at + 256].astype(np.float64) @ sample.astype(np.float64).T
        score[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        if score.shape[1] >= k:
            top = np.partition(score, -k, axis=1)[:, -k]
            floors[at : at + 256] = top - 1 - 1e-9 * np.abs(top)
    return floors


def pivot_table(vectors: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """vec_id, v, to_pivots: each vector with its distances to all pivots, written once for all passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = distances(_matrix(b.column(1), width), pivots)
            ends = pa.array(np.arange(0, d.size + 1, max(1, d.shape[1])) if d.shape[1] else np.zeros(len(d) + 1), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(ends, pa.array(d.ravel()))], names=["vec_id", "v", "to_pivots"])

    return table(vectors.mapInArrow(run, "vec_id long, v array<bigint>, to_pivots array<double>"), "pivots")


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all rows but its own for each row whose vec_id is divisible by `every`.

    The pivot table is written once. Queries go in blocks of QUERY_BLOCK rows (a fixed bound, sent to the tasks of their
    pass), JOB_BLOCKS passes side by side in a job; each starts from the scores that a bounded sample reaches, and each
    task keeps k rows a query; a rank over those gives the result. Vectors that are null or hold null or non-finite
    components, and null ids, take no part. Vectors of unequal length are compared as if the shorter ended in zeros.
    Components beyond a long, once scaled, are the nearest long; scores beyond it are plus or minus 2^63 - 1. "Its own" is every row with the query's
    id; of repeated query rows one asks (of several vectors of one id the least); repeated candidates each take a place.
    Fewer than k candidates give fewer rows; an empty table none. Further columns do not matter.
    """
    good = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    shaped = table(good.select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v")), "vectors")
    n, width = shaped.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    tasks = max(1, -(-n // TASK_VECTORS))
    sample = shaped.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow()
    some, some_ids = _matrix(sample.column("v"), width), sample.column("vec_id").to_numpy().astype(np.int64)
    pivots = choose_pivots(some, PIVOTS)
    held = pivot_table(shaped.repartition(tasks), pivots, width)
    asked = table(shaped.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "asked")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))

    def one_pass(b: int) -> DataFrame:
        mine = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy("vec_id").toArrow()
        query_ids, queries = mine.column("vec_id").to_numpy().astype(np.int64), _matrix(mine.column("v"), width)
        to_query, floors = distances(queries, pivots), known_floors(queries, query_ids, some, some_ids, k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[list[tuple[int, int]]] = [[] for _ in query_ids]
            for batch in batches:
                if batch.num_rows and len(query_ids):
                    to_point = _matrix(batch.column(2), len(pivots), np.float64)
                    search_block(queries, query_ids, _matrix(batch.column(1), width), batch.column(0).to_numpy(), to_point, to_query, k, best, floors)
            flat = [(q, i, -s) for q, rows in zip(query_ids.tolist(), best, strict=True) for s, i in rows]
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in flat], pa.int64()) for c in range(3)], names=["query_id", "vec_id", "score"])

        return held.mapInArrow(run, "query_id long, vec_id long, score long")

    parts = [table(reduce(DataFrame.unionByName, [one_pass(b) for b in range(at, min(at + JOB_BLOCKS, blocks))]), "best") for at in range(0, blocks, JOB_BLOCKS)]
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    out = table(reduce(DataFrame.unionByName, parts).withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "top")
    for t in (shaped, held, asked, *parts):
        drop_table(t)
    return out
