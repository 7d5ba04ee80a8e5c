"""Operator 3: quality rules, a threshold table compiled into one native Spark projection."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import SPACES, word_array

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages.
STOP_WORDS = (
    "the be to of and that have with in is it for a as was on "
    "le la de et un une des que en les du "
    "der die und das ist nicht ein den von zu "
    "el y los se del por con para"
).split()


class Rule(NamedTuple):
    """A document passes if least <= numerator / denominator <= most; an empty denominator passes."""

    name: str
    numerator: str
    denominator: str | None
    least: float | None
    most: float | None


#: The threshold table. Names of numerators and denominators are columns of signals().
RULES = (
    Rule("word_length", "word_chars", "n_words", 2.0, 20.0),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 0.25),
    Rule("shouting", "n_upper", "word_chars", None, 0.5),
    Rule("exclamations_per_word", "n_exclaims", "n_words", None, 0.5),
    Rule("stop_words", "n_stop_words", "n_words", 0.01, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 0.5),
)
SIGNALS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _chars_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def signals(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` and one long column for each signal of a document's whole text.

    Null and blank texts have 0 everywhere. Each array is made in a projection of its own and used more than
    once in the next, so that Catalyst does not fold its computation into a loop over its elements. Repeated
    three-word windows are found by sorting a document's windows and comparing neighbours: n log n for long texts.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("_t"), word_array(F.col("text")).alias("_w"), F.split(text, "\n").alias("_l"))
    n = F.size("_w")
    step = step.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", SPACES, "")).cast("long").alias("word_chars"),
        _chars_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        _chars_of(F.col("_t"), "!").alias("n_exclaims"),
        F.regexp_count("_t", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.filter("_l", lambda x: F.btrim(x, F.lit(SPACES)) != "").alias("_l"),
        F.sort_array(
            F.transform(
                F.slice(F.arrays_zip(F.col("_w").alias("a"), F.slice("_w", 2, F.greatest(n, F.lit(1))).alias("b"), F.slice("_w", 3, F.greatest(n, F.lit(1))).alias("c")), F.lit(1), F.greatest(n - 2, F.lit(0))),
                lambda x, i: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["c"].alias("c"), i.alias("i")),
            )
        ).alias("_s"),
    )
    same = lambda p: (p["x"]["a"] == p["y"]["a"]) & (p["x"]["b"] == p["y"]["b"]) & (p["x"]["c"] == p["y"]["c"])
    pairs = F.arrays_zip(F.col("_s").alias("x"), F.slice("_s", 2, F.greatest(F.size("_s"), F.lit(1))).alias("y"))
    covered = F.flatten(F.transform(F.filter(pairs, same), lambda p: F.array(*[p[s]["i"] + k for s in "xy" for k in range(3)])))
    lines = [c for c in step.columns if c not in ("_l", "_s")]
    return step.select(
        *lines,
        F.size("_l").cast("long").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(covered)).cast("long").alias("n_repeat_words"),
    )


def passes(rule: Rule) -> Column:
    value = F.col(rule.numerator).cast("double")
    if rule.denominator:
        value = value / F.when(F.col(rule.denominator) > 0, F.col(rule.denominator))
    inside = F.lit(True)
    if rule.least is not None:
        inside = inside & (value >= rule.least)
    if rule.most is not None:
        inside = inside & (value <= rule.most)
    return F.coalesce(inside, F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the signals, base_failed, kept, failed_rules (names, in table order).

    Null, empty and blank texts have under 50 words and so fail the base. Repeated rows are judged alike, one
    row each. Only `text` and `keep` are read; further columns of docs, whatever their names, do not matter. A long text is
    judged whole, in one row's arrays. An empty table gives no rows.
    """
    failed = F.filter(F.array(*[F.when(~passes(r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    out = signals(docs, keep).withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that judge() keeps, with their own columns, whatever their names: all in one narrow pass.

    Null, empty and blank texts go; of repeated rows all stay or go; null ids do not matter; long texts are judged whole; an
    empty table stays empty.

    A random column stands between, so that Catalyst leaves the filter above the projections (1 is above any such
    number, 0 is not): pushed below them it would hold their expressions several times over.
    """
    own = docs.columns
    inner = docs.select(F.struct(*own).alias("_row"), F.col("text").alias("text"))
    return judge(inner, rules, ("_row",)).withColumn("_r", F.rand(0)).where(F.col("kept").cast("int") > F.col("_r")).select("_row.*").select(*own)
