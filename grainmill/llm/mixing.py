"""Operator 2: mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.llm.common import document_key, table, word_count

WEIGHTS = (3, 1, 2)
#: Words taken in all, per hundred words there are; most copies of a source.
TAKE_PERCENT, CAP = 150, 2
#: Documents of one size stand in 4,096 cells by a hash of their doc_id, in rows of so many cells.
CELL_ROW = 64


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = TAKE_PERCENT, cap: int = CAP) -> DataFrame:
    """source, source_size, n_docs, target: weights by code point of the source (null last), capped water filling.

    A source is capped if cap * size / weight is below the level that the others reach; sorted by that ratio the
    capped ones are a prefix, so two running sums replace the rounds of resharing. One row a source: small.
    """
    by = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").cast("long").alias("n_docs"))
    every = Window.partitionBy(F.lit(1))
    place = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source").cast("binary")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((place - 1) % len(weights) + 1).cast("int")).cast("long")
    by = by.withColumn("_w", weight)
    order = every.orderBy((cap * F.col("source_size")).cast("double") / F.col("_w"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select(
        "*",
        (F.sum("source_size").over(every) * percent).cast("double").alias("_total"),
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("_s"),
        (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0))).alias("_rest"),
    )
    level = (F.col("_total") / 100 - cap * F.col("_s")) / F.col("_rest")
    by = by.withColumn("_level", level).withColumn("_free", F.col("_level") * F.col("_w") < cap * F.col("source_size"))
    held = F.first(F.when(F.col("_free"), F.col("_level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least((cap * F.col("source_size")).cast("double"), F.coalesce(held * F.col("_w"), (cap * F.col("source_size")).cast("double")))
    return by.select("source", "source_size", "n_docs", target.alias("target"))


def _offset(seed: str) -> Column:
    """One number in [0, 1) for each source."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("source"), F.lit("")), F.when(F.col("source").isNull(), "n").otherwise("s")))
    return F.conv(F.substring(key, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def plan(docs: DataFrame, seed: str = "mix-1", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, source, size, source_size, target, copies, taken: one row for each row of docs.

    Each document of a source is expected target / source_size times. Documents stand in the order of size, then
    of a hash of doc_id, then doc_id, and a document is emitted once for each integer that the running sum of
    expected copies, moved by the source's offset, crosses in it. Ordering by size keeps the words taken within
    about one document of the target. The running sum is a rank times a constant, so it is made of three bounded
    pieces: sizes below (a row for each distinct size of a source), hash cells before (4,096 at most, in two steps of
    64), and the place in the cell; no source and no size is gathered in one task. Long texts are only counted. Null and blank texts have size 0 and count as documents; a null
    source is a source; rows without a doc_id come first in their cells, which are by their texts; repeated rows stand
    together, in any order among equals, each with its own copies. An empty table gives no rows.
    """
    # Documents without a doc_id are spread by their texts.
    name = F.coalesce(F.col("doc_id").cast("string"), F.when(F.col("text").isNotNull(), F.xxhash64("text").cast("string")), F.lit(""))
    cell = F.conv(F.substring(F.md5(name), 1, 3), 16, 10).cast("int")
    sizes = table(docs.select(*keep, "source", word_count(F.col("text")).alias("size"), cell.alias("_cell"), F.col("doc_id").alias("_id")), "sizes")
    # Nulls never meet in an equi-join: sources carry a flag and a filled name.
    flag, filled = F.col("source").isNull().alias("_n"), F.coalesce("source", F.lit("")).alias("_s")
    at, row = ["_n", "_s", "size"], F.floor(F.col("_cell") / CELL_ROW).cast("int").alias("_row")
    cells = sizes.groupBy(flag, filled, "size", row, "_cell").agg(F.count("*").alias("_k"))
    # Three running sums, none over more than CELL_ROW rows of one size (or the distinct sizes of one source).
    rows = cells.groupBy(*at, "_row").agg(F.sum("_k").alias("_k"))
    heights = rows.groupBy(*at).agg(F.sum("_k").alias("_h"))
    before = lambda total, by, order: F.sum(total).over(Window.partitionBy(*by).orderBy(order)) - F.col(total)
    below = heights.select(*at, before("_h", at[:2], "size").alias("_below"))
    beside = rows.select(*at, "_row", before("_k", at, "_row").alias("_beside"))
    inside = cells.select(*at, "_row", "_cell", before("_k", [*at, "_row"], "_cell").alias("_inside"))
    starts = inside.join(beside, [*at, "_row"]).join(below, at).select(*at, "_cell", (F.col("_below") + F.col("_beside") + F.col("_inside")).alias("_start"))
    targets = source_targets(sizes).select(flag, filled, "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*at, "_cell").orderBy("_id"))
    out = sizes.select(*sizes.columns, flag, filled).withColumn("_rank", rank).join(starts, [*at, "_cell"]).join(targets, ["_n", "_s"])
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("_start") + F.col("_rank")
    crossed = F.floor(place * each + _offset(seed)) - F.floor((place - 1) * each + _offset(seed))
    return out.withColumn("copies", crossed.cast("long")).select(*keep, "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, seed: str = "mix-1") -> DataFrame:
    """The rows of docs, each as often as plan() says, with their own columns, whatever their names.

    Rows that share a doc_id (or have none and share a text) all get their largest count. Null, empty and long texts,
    repeated rows and empty tables are as in plan().
    """
    own = docs.columns
    held = docs.select("doc_id", "source", "text", document_key(docs))
    copies = plan(held, seed, ("_d",)).groupBy("_d").agg(F.max("copies").alias("_copies")).where("_copies > 0")
    rows = docs.select(document_key(docs), F.struct(*own).alias("_own")).join(copies, "_d")
    return rows.select("_own", F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_copy")).select("_own.*").select(*own)
