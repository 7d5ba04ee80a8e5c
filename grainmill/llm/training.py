"""The bounded, repeatable training sample of the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, per_class: int, class_bytes: int, longest: int) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Whole texts, labels and weights of at most per_class documents and class_bytes bytes of each class, never of the held-out fold.

    Documents come in the order of a hash of doc_id, so a rerun takes the same; those longer than `longest` bytes do
    not train, and the first that would go beyond class_bytes ends its class. Weights give each class its share of all
    labelled rows of the other folds. Ids are chosen from the narrow labels first; only their texts reach the driver.
    An id with several labels or texts has the least of each.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % folds != held))
    known = known.groupBy("doc_id").agg(F.min(F.col(label).cast("int")).alias("_y"))
    share = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    if not share:
        return [], np.zeros(0), np.zeros(0)
    picked = [known.where(F.col("_y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in sorted(share)]
    chosen = picked[0] if len(picked) == 1 else picked[0].unionByName(picked[1])
    # At most 2 * per_class rows: a fixed bound.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_b")).where(F.octet_length("_b") <= longest).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.min("_b").alias("_b"))
    so_far = F.sum(F.octet_length("_b")).over(Window.partitionBy("_y").orderBy(F.xxhash64("doc_id"), "doc_id"))
    rows = rows.withColumn("_sum", so_far).where(F.col("_sum") <= class_bytes).drop("_sum").toArrow().sort_by("doc_id")
    y = rows.column("_y").to_numpy().astype(np.float32)
    if not len(y):
        return [], np.zeros(0), np.zeros(0)
    total = sum(share.values())
    weight = {c: (share.get(int(c), 0) / total) / max((y == c).mean(), 1e-9) for c in (0.0, 1.0)}
    return [bytes(b) for b in rows.column("_b").to_pylist()], y, np.array([weight[float(c)] for c in y], np.float32)
