"""Connected components of an edge table, by joins alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.sources.scratch import drop_table, small, table

#: So many edges at most (counted first) are connected in one task, by union and find: some 40 MB there.
ONE_TASK = 1 << 18


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one partition as stars: each node with the least node that the partition connects it to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    ends = [(x, r) for x in root if (r := find(x)) != x]
    yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in ends], pa.int64()) for i in range(2)], names=["a", "b"])


def connected_components(edges: DataFrame, one_task: int = ONE_TASK, stars: bool = False) -> DataFrame:
    """node, root: for each node of edges (a, b), the smallest node that it is connected to. Null ends are dropped.

    First each partition, as it lies, turns its edges into stars. If few edges are left, one task connects them. Else two
    star steps alternate until nothing changes: each node's larger neighbours are hung on its smallest neighbour, then
    its smaller neighbours likewise. Edges never grow in number; rounds are about the logarithm of the longest path.
    Each round is a table in the shared folder. stars: edges are what `forest` makes of each partition; a step in Python that
    finds them calls it itself, since each further one in a stage takes a Python worker of its own for each task.
    """
    if not stars:
        given = edges.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        edges = given.mapInArrow(forest, "a long, b long")
    now, mark = table(edges.distinct(), "edges"), None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == tuple(seen):
            break
        if seen[0] <= one_task:
            after = table(now.coalesce(1).mapInArrow(forest, "a long, b long"), "edges")
            drop_table(now)
            now = after
            break
        mark = tuple(seen)
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Written before it is joined: the join is then a broadcast, or one whose hot nodes Spark splits.
        least = table(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "least")
        # Larger neighbours of each node go to its smallest neighbour (or itself).
        large = table(both.where("b > a").join(small(least, 24), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Smaller neighbours of each node, and the node, go to the smallest.
        low = table(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        hung = large.join(small(low, 24), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).distinct()
        after = table(hung, "edges")
        for t in (now, least, large, low):
            drop_table(t)
        now = after
    roots = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
