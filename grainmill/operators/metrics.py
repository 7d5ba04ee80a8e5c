"""Training-data preparation and classification metrics, as aggregates over small label dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions.taxonomy import CATEGORIES, INTENTS
from grainmill.sources.scratch import small, table


def labels_table(spark: SparkSession, labels: Sequence) -> DataFrame:
    return spark.createDataFrame([(i, v) for i, v in enumerate(labels)], f"idx int, label {'int' if isinstance(labels[0], int) else 'string'}")


def shuffle_key(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def _placed(df: DataFrame, key: str, seed: int, *by: str) -> DataFrame:
    """df with _gm_place, a row's place (from 1) in a seeded hash order, and _gm_n, the rows, within each value of `by`.

    Places come from a histogram of hash prefixes (at most 65,536 for each value) and a rank within one prefix, so that
    neither the table nor a value of `by` is sorted in one task.
    """
    keyed = df.select("*", shuffle_key(F.col(key), seed).alias("_gm_h"), *[F.col(c).alias(f"_gm_by{i}") for i, c in enumerate(by)]).withColumn("_gm_p", F.substring("_gm_h", 1, 4))
    own = [f"_gm_by{i}" for i in range(len(by))]
    counts = table(keyed.groupBy(*own, "_gm_p").agg(F.count("*").alias("_gm_k")), "histogram")
    within = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    starts = counts.select(*own, "_gm_p", (F.sum("_gm_k").over(within.orderBy("_gm_p")) - F.col("_gm_k")).alias("_gm_start"), F.sum("_gm_k").over(within).alias("_gm_n"))
    rank = F.row_number().over(Window.partitionBy(*own, "_gm_p").orderBy("_gm_h", key))
    starts = small(starts.withColumnsRenamed({c: f"{c}_s" for c in [*own, "_gm_p"]}), 64)
    met = F.col("_gm_p") == F.col("_gm_p_s")
    for c in own:
        met = met & F.col(c).eqNullSafe(F.col(f"{c}_s"))
    return keyed.withColumn("_gm_rank", rank).join(starts, met).select(*df.columns, (F.col("_gm_start") + F.col("_gm_rank")).alias("_gm_place"), "_gm_n")


def train_val(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """df with split: val for max(1, int(share * n)) rows that come first in a seeded hash order, else train."""
    want = F.greatest(F.lit(1), F.floor(F.col("_gm_n") * share))
    return _placed(df, key, seed).withColumn("split", F.when(F.col("_gm_place") <= want, "val").otherwise("train")).drop("_gm_place", "_gm_n")


def stratified(df: DataFrame, key: str, label: str, shares: dict[str, float], seed: int = 42) -> DataFrame:
    """Extension: df with split, each label divided by `shares` in a seeded hash order (bounded by rounding down the running share)."""
    total, edges = 0.0, []
    for name, share in shares.items():
        total += share
        edges.append((name, round(total, 9)))
    split = F.lit(edges[-1][0])
    for name, edge in reversed(edges[:-1]):
        split = F.when(F.col("_gm_place") <= F.floor(F.col("_gm_n") * edge), name).otherwise(split)
    return _placed(df, key, seed, label).withColumn("split", split).drop("_gm_place", "_gm_n")


def class_weights(df: DataFrame, label: str = "intent", labels: Sequence[str] = INTENTS) -> DataFrame:
    """idx, label, n, weight = total / (number of labels * n); labels that are absent count as 1. The total holds other labels too."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    out = labels_table(df.sparkSession, labels).join(counts, "label", "left").crossJoin(total)
    n = F.coalesce("n", F.lit(1))
    return out.select("idx", "label", n.alias("n"), (F.col("total") / (F.lit(len(labels)) * n)).alias("weight"))


def index_of(label: Column, labels: Sequence[str], default: int) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for i, v in enumerate(labels) for x in (v, i)])[label], F.lit(default))


def intent_index(label: Column) -> Column:
    return index_of(label, INTENTS, INTENTS.index("casual_chat"))


def category_index(label: Column) -> Column:
    return index_of(label, CATEGORIES, CATEGORIES.index("neutral"))


def ordinal(level: Column, levels: int = 5) -> Column:
    """[level > 1, ..., level > levels - 1] as 0 and 1."""
    return F.array(*[(level > k).cast("int") for k in range(1, levels)])


def ordinal_level(logits: Column) -> Column:
    """1 and the number of thresholds whose probability is above a half."""
    return F.size(F.filter(logits, lambda x: x > 0)) + 1


def softmax(logits: Column) -> Column:
    top = F.array_max(logits)
    odds = F.transform(logits, lambda x: F.exp(x - top))
    total = F.aggregate(odds, F.lit(0.0), lambda s, x: s + x)
    return F.transform(odds, lambda x: x / total)


def best_label(logits: Column, labels: Sequence[str]) -> tuple[Column, Column]:
    """(label of the greatest logit, its probability to four places)."""
    at = F.array_position(logits, F.array_max(logits)).cast("int")
    return F.element_at(F.array(*[F.lit(v) for v in labels]), at), F.round(F.array_max(softmax(logits)), 4)


def accuracy(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.agg(F.round(F.avg((F.col(true) == F.col(pred)).cast("double")), 4).alias("accuracy"))


def per_class(df: DataFrame, true: str, pred: str, labels: Sequence) -> DataFrame:
    """idx, label, tp, fp, fn, support, precision, recall, f1 for the whole list of labels, absent ones with zeros.

    The rows are counted once by (true, pred), a table of labels squared; everything else is of that size.
    """
    counts = df.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    by_true = counts.groupBy(F.col("t").alias("label")).agg(F.sum("n").alias("support"), F.sum(hit).alias("tp"))
    by_pred = counts.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("predicted"))
    out = labels_table(df.sparkSession, labels).join(by_true, "label", "left").join(by_pred, "label", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp = F.col("tp")
    out = out.withColumns({"fp": F.col("predicted") - tp, "fn": F.col("support") - tp, "precision": share(tp, F.col("predicted")), "recall": share(tp, F.col("support"))})
    return out.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select("idx", "label", "tp", "fp", "fn", "support", "precision", "recall", "f1")


def macro_f1(df: DataFrame, true: str, pred: str, labels: Sequence) -> DataFrame:
    return per_class(df, true, pred, labels).agg(F.round(F.avg("f1"), 4).alias("macro_f1"))


def worst_first(report: DataFrame) -> DataFrame:
    return report.select("idx", "label", *[F.round(c, 3).alias(c) for c in ("precision", "recall", "f1")], "support").orderBy("f1", "idx")


def confusion(df: DataFrame, true: str, pred: str, labels: Sequence) -> DataFrame:
    """A row for each true label that occurs, a column for each label."""
    return df.groupBy(F.col(true).alias("label")).pivot(pred, list(labels)).agg(F.count(F.lit(1))).na.fill(0)


def urgency_errors(df: DataFrame, true: str, pred: str) -> DataFrame:
    """mae and within_one of ordinal predictions."""
    off = F.abs(F.col(true) - F.col(pred))
    return df.agg(F.round(F.avg(off.cast("double")), 4).alias("mae"), F.round(F.avg((off <= 1).cast("double")), 4).alias("within_one"))


def missed_urgent(df: DataFrame, true: str, pred: str, least: int = 4) -> DataFrame:
    """Share of urgent rows that are predicted below `least`."""
    return df.where(F.col(true) >= least).agg(F.round(F.avg((F.col(pred) < least).cast("double")), 4).alias("false_negative_rate"))


def error_pairs(df: DataFrame, true: str, pred: str, text: str, order: str, most: int = 10) -> DataFrame:
    """true, pred, n, example (the first by order) of wrong predictions, the most frequent first."""
    wrong = df.where(F.col(true) != F.col(pred)).groupBy(F.col(true).alias("true"), F.col(pred).alias("pred"))
    return wrong.agg(F.count("*").alias("n"), F.min_by(text, order).alias("example")).orderBy(F.desc("n"), "true", "pred").limit(most)


def level_counts(df: DataFrame, true: str, pred: str, levels: Sequence[int] = (1, 2, 3, 4, 5)) -> DataFrame:
    """level, n_true, n_pred, zero-filled."""
    both = df.select(F.explode(F.array(F.struct(F.col(true).cast("int").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p")), F.struct(F.col(pred).cast("int").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p")))).alias("x")).select("x.*")
    counts = both.groupBy("label").agg(F.sum("t").alias("n_true"), F.sum("p").alias("n_pred"))
    return labels_table(df.sparkSession, list(levels)).join(counts, "label", "left").na.fill(0).select(F.col("label").alias("level"), "n_true", "n_pred")


def joint_loss(intent: Column, category: Column, urgency: Column, weights: tuple[float, float, float] = (1.0, 0.7, 0.5)) -> Column:
    return intent * weights[0] + category * weights[1] + urgency * weights[2]


def early_stopping(log: DataFrame, epoch: str = "epoch", score: str = "score", patience: int = 3, run: str | None = None) -> DataFrame:
    """log with best_so_far, improved, stale (epochs since the best), stopped (an epoch at or before ran out of patience)."""
    by = Window.partitionBy(run if run else F.lit(0)).orderBy(epoch)
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    before = F.max(score).over(by.rowsBetween(Window.unboundedPreceding, -1))
    log = log.withColumns({"best_so_far": F.max(score).over(so_far), "improved": before.isNull() | (F.col(score) > before)})
    log = log.withColumn("_at", F.max(F.when(F.col("improved"), F.col(epoch))).over(so_far)).withColumn("stale", F.col(epoch) - F.col("_at"))
    return log.withColumn("stopped", F.max(F.col("stale") >= patience).over(so_far)).drop("_at")


def warmup_steps(total: Column) -> Column:
    return F.floor(total * F.lit(0.1)).cast("int")
