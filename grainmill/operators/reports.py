"""Dataset reports: distributions, gaps against targets, seed quality checks, ids, calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.taxonomy import INTENT_TABLE, SEED_INTENTS, SEED_TARGETS, TARGETS
from grainmill.functions.text import folded, found, seed_fingerprint
from grainmill.operators.dedup import overlap_window
from grainmill.sources.scratch import numbered_rows, small, table


def distribution(df: DataFrame, column: str, most: int | None = None) -> DataFrame:
    """value, n, percent (one decimal), most frequent first; missing values are `unknown`."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    out = counts.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))), 1)).orderBy(F.desc("n"), "value")
    return out.limit(most) if most else out


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, value, n, percent of several columns at once: one scan, one shuffle of counts, most frequent first within each column."""
    values = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in columns])
    sets = values.groupingSets([[c] for c in columns], *columns).agg(F.grouping_id().alias("_set"), F.count("*").alias("n"))
    # The bit of the only column that a set does not leave out is 0.
    bits = {c: (1 << len(columns)) - 1 - (1 << (len(columns) - 1 - i)) for i, c in enumerate(columns)}
    name = F.coalesce(*[F.when(F.col("_set") == b, F.lit(c)) for c, b in bits.items()])
    out = sets.select(name.alias("column"), F.coalesce(*columns).alias("value"), "n")
    return out.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("column")), 1)).orderBy("column", F.desc("n"), "value")


def gaps(df: DataFrame, column: str = "intent", targets: dict[str, int] = TARGETS) -> DataFrame:
    """label, n, target, gap of the labels below their target, widest first."""
    want = df.sparkSession.createDataFrame(list(targets.items()), "label string, target int")
    have = df.groupBy(F.col(column).alias("label")).agg(F.count("*").alias("n"))
    out = want.join(have, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("label", "n", "target", (F.col("target") - F.col("n")).alias("gap")).where("gap > 0").orderBy(F.desc("gap"), "label")


def seed_gaps(df: DataFrame, column: str = "intent", per_call: int = 20, crisis_most: int = 50) -> DataFrame:
    """label, n, target, gap, this_run, this_call for the seed set; crisis is filled slowly."""
    out = gaps(df, column, SEED_TARGETS).withColumn("this_run", F.when(F.col("label") == "crisis_signal", F.least("gap", F.lit(crisis_most))).otherwise(F.col("gap")))
    return out.withColumn("this_call", F.least("this_run", F.lit(per_call)))


def quality_reason(text: Column, urgency: Column, intent: Column, low: Column | None = None) -> Column:
    """The first reason of a row on its own, else null. low: folded(text), best in a column of its own."""
    low = folded(text) if low is None else low
    return (
        F.when(F.length(text) < 10, "too_short").when(F.length(text) > 1500, "too_long")
        .when(found(low, P.SEED_TEMPLATED), "templated_text").when(found(low, P.SEED_UNSAFE), "unsafe_crisis_content")
        .when(found(low, P.SEED_METAPHOR) & (urgency >= 3), "metaphor_crisis_mismatch").when(~F.coalesce(intent.isin(SEED_INTENTS), F.lit(False)), "invalid_intent")
    )


def quality_check(df: DataFrame, order: str, text: str = "text", urgency: str = "urgency_level", intent: str = "intent", group: str | None = None) -> DataFrame:
    """df with rejection_reason (null: accepted): reasons of the row, then copies of accepted rows, then rows near to one of the last 200 accepted.

    Only accepted rows make later ones copies: a copy of a row that was rejected as near is judged anew, and accepted if
    what that was near to has left the window. With `group`, folds and copies are those of each group. Values of `order`
    are unique.
    """
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_low", folded(F.col("_t")))
    own = quality_reason(F.col("_t"), F.coalesce(F.col(urgency), F.lit(1)), F.col(intent), F.col("_low"))
    fp = seed_fingerprint(F.col("_t"))
    df = table(df.withColumns({"_own": own, "_fp": F.concat_ws(":", fp, F.coalesce(F.col(group).cast("string"), F.lit(""))) if group else fp}).drop("_low"), "checked")
    good = df.where("_own IS NULL").select(F.col(order).alias("_at"), "_t", "_fp", *([F.col(group).alias("_group")] if group else []))
    fold = overlap_window(good, "_at", "_t", group="_group" if group else None, copy_of="_fp")
    judged = fold.select(F.col("order").alias("_at"), F.when(F.col("copy"), "exact_duplicate").when(F.col("near_of").isNotNull(), "near_duplicate").alias("_folded")).where("_folded IS NOT NULL")
    out = df.join(small(judged, 32), df[order] == judged["_at"], "left").withColumn("rejection_reason", F.coalesce("_own", "_folded"))
    return out.drop("_t", "_own", "_fp", "_at", "_folded")


def reasons(df: DataFrame, column: str = "rejection_reason") -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def assign_ids(df: DataFrame, order: str, existing: DataFrame | None = None, split: str = "train", name: str = "seed") -> DataFrame:
    """df with id (<name>_<split>_<number>) and split; numbers go on from the greatest in existing, in order.

    The table is sorted by sampled ranges and written; a row's number is the rows of the partitions before its own and
    its place there, so no task ranks the whole table, however the values of order are spread.
    """
    prefix = f"{name}_{split}_"
    start = 0
    if existing is not None:
        tail = F.expr(f"try_cast(substring(id, {len(prefix) + 1}) AS bigint)")
        start = existing.where(F.col("id").startswith(prefix)).agg(F.coalesce(F.max(tail), F.lit(0))).first()[0]
    rows = numbered_rows(df.orderBy(order))
    number = F.lit(start) + F.col("_gm_number")
    digits = F.when(number < 10_000, F.lpad(number.cast("string"), 4, "0")).otherwise(number.cast("string"))
    return rows.withColumns({"id": F.concat(F.lit(prefix), digits), "split": F.lit(split)}).drop("_gm_number")


def calls(wanted: DataFrame, n: str = "gap", per_call: int = 10) -> DataFrame:
    """One row for each call of up to per_call records: call (from 0), ask."""
    k = F.ceil(F.col(n) / per_call).cast("int")
    return wanted.where(F.col(n) > 0).select("*", F.explode(F.sequence(F.lit(0), k - 1)).alias("call")).withColumn("ask", F.least(F.lit(per_call), F.col(n) - F.col("call") * per_call))


def generation_prompts(wanted: DataFrame, template: str, crisis_note: str, label: str = "label", n: str = "ask") -> DataFrame:
    """wanted with category, urgency range, language, prompt and its 8-character hash, from the intent table.

    template may use {n}, {intent}, {category}, {low}, {high}, {language}, {note}.
    """
    dim = F.broadcast(wanted.sparkSession.createDataFrame([r[:5] for r in INTENT_TABLE], f"{label} string, category string, low int, high int, language string"))
    out = wanted.join(dim, label, "left").na.fill({"category": "emotional", "low": 2, "high": 3, "language": "en"})
    text = F.lit(template)
    for name, value in {"n": F.col(n), "intent": F.col(label), "category": F.col("category"), "low": F.col("low"), "high": F.col("high"), "language": F.col("language"), "note": F.when(F.col("category") == "crisis", crisis_note).otherwise("")}.items():
        text = F.replace(text, F.lit("{" + name + "}"), value.cast("string"))
    return out.withColumn("prompt", text).withColumn("prompt_hash", F.substring(F.md5("prompt"), 1, 8))
