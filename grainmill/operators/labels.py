"""Schema checks and label correction with an audit trail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.taxonomy import CATEGORIES, INTENT_CATEGORY, INTENTS, LANGUAGES
from grainmill.functions.text import folded, found, messages, quoted, strip
from grainmill.sources.scratch import table

REQUIRED = {"text": "", "intent": "casual_chat", "category": "neutral", "urgency": 1}


def category_of(intent: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in INTENT_CATEGORY.items() for x in pair])[intent]


def whole_number(df: DataFrame, column: str) -> Column:
    """As int() reads it: numbers are truncated, texts must be whole numbers; else null."""
    kind = df.schema[column].dataType.simpleString()
    if kind == "string":
        text = strip(F.col(column))
        return F.when(text.rlike(r"^[+-]?[0-9]+(_[0-9]+)*$"), F.expr(f"try_cast(regexp_replace(trim(`{column}`), '_', '') AS bigint)"))
    return F.col(column).cast("bigint")


def validate(df: DataFrame, strict: bool = False, missing: dict[str, Column] | None = None) -> DataFrame:
    """df with text, intent, category, urgency, language corrected, and _corrections, _drop_reason (null: kept).

    Rules run in order, each on what the one before left. missing tells, by field, which rows lack it (a whole
    column that df lacks is missing everywhere) and gets the default; a null that is there is a value: no text, label or
    number. A missing language is en, without a word.
    Corrections are listed in the order in which they were made, missing fields by name.
    """
    lacking = {f: (missing or {}).get(f, F.lit(f not in df.columns)) for f in sorted(REQUIRED)}
    for f, value in (REQUIRED | {"language": "en"}).items():
        if f not in df.columns:
            df = df.withColumn(f, F.lit(value))
        elif missing and f in missing:
            df = df.withColumn(f, F.when(missing[f], F.lit(value).cast(df.schema[f].dataType)).otherwise(F.col(f)))
    filled = messages(*[F.when(c, F.lit(f"filled_default:{f}")) for f, c in lacking.items()])
    absent = F.array_join(messages(*[F.when(c, F.lit(f)) for f, c in lacking.items()]), ",")
    df = df.withColumns({"_gm_absent": absent, "_gm_said": filled, "_gm_text": strip(F.coalesce(F.col("text").cast("string"), F.lit("")))})
    df = df.withColumn("_gm_folded", folded(F.col("_gm_text")))
    number, has = whole_number(df, "urgency"), lambda p: found(F.col("_gm_folded"), p)
    df = df.withColumns({
        "_gm_meta": has(P.LABEL_METAPHOR), "_gm_risk": has(P.LABEL_CRISIS), "_gm_low": has(P.LABEL_DISTRESS),
        "_gm_u": F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(1)), F.lit(5))).cast("int"),
        "_gm_i": strip(F.coalesce(F.col("intent"), F.lit("None"))), "_gm_c": strip(F.coalesce(F.col("category"), F.lit("None"))), "_gm_l": strip(F.coalesce(F.col("language"), F.lit("None"))),
    })
    df = df.withColumns({
        "_gm_i1": F.when(F.col("_gm_i").isin(INTENTS), F.col("_gm_i")).otherwise("casual_chat"),
        "_gm_u1": F.coalesce("_gm_u", F.lit(2)),
        "_gm_l1": F.when(F.col("_gm_l").isin(LANGUAGES), F.col("_gm_l")).otherwise("en"),
    })
    df = df.withColumn("_gm_c1", F.when(F.col("_gm_c").isin(CATEGORIES), F.col("_gm_c")).otherwise(category_of(F.col("_gm_i1"))))
    promote, demote = F.col("_gm_risk") & ~F.col("_gm_meta"), F.col("_gm_meta") & (F.col("_gm_c1") == "crisis")
    is_crisis_intent = F.col("_gm_i1").isin("self_harm_intent", "suicidal_thoughts")
    df = df.withColumns({
        "_gm_c2": F.when(promote, "crisis").when(demote, "life_stressor").otherwise(F.col("_gm_c1")),
        "_gm_i2": F.when(promote & ~is_crisis_intent, "suicidal_thoughts").otherwise(F.col("_gm_i1")),
        "_gm_u2": F.when(promote, 5).when(demote, F.least("_gm_u1", F.lit(2))).otherwise(F.col("_gm_u1")),
    })
    floor = F.when(F.col("_gm_c2") == "crisis", F.greatest("_gm_u2", F.lit(4))).when(F.col("_gm_c2") == "high_distress", F.greatest("_gm_u2", F.lit(3))).when(F.col("_gm_c2") == "neutral", F.lit(1)).otherwise(F.col("_gm_u2"))
    df = df.withColumn("_gm_u3", floor)
    raised = (F.col("_gm_u3") >= 4) & ~F.col("_gm_c2").isin("crisis", "high_distress") & F.col("_gm_low")
    df = df.withColumns({"_gm_c4": F.when(raised, "high_distress").otherwise(F.col("_gm_c2")), "_gm_want": category_of(F.col("_gm_i2"))})
    align = (F.col("_gm_c4") != F.col("_gm_want")) & ~(F.col("_gm_risk") & (F.col("_gm_want") != "crisis"))
    df = df.withColumn("_gm_c5", F.when(align, F.col("_gm_want")).otherwise(F.col("_gm_c4")))
    arrow = lambda name, a, b: F.concat(F.lit(f"{name}:"), a, F.lit("→"), b)
    text_of = lambda c: F.col(c).cast("string")
    made = messages(
        F.when(F.col("_gm_u").isNull(), F.lit("urgency_coerced_to_int")),
        F.when(F.col("_gm_i") != F.col("_gm_i1"), F.concat(F.lit("intent_invalid:"), quoted(F.col("_gm_i")))),
        F.when(F.col("_gm_c") != F.col("_gm_c1"), arrow("category_fixed_from_intent", quoted(F.col("_gm_c")), quoted(F.col("_gm_c1")))),
        F.when(F.col("_gm_l") != F.col("_gm_l1"), arrow("language_defaulted", quoted(F.col("_gm_l")), F.lit("en"))),
        F.when(promote & (F.col("_gm_c1") != "crisis"), arrow("category_crisis_promoted", quoted(F.col("_gm_c1")), F.lit("crisis"))),
        F.when(promote & ~is_crisis_intent, arrow("intent_crisis_promoted", quoted(F.col("_gm_i1")), F.lit("suicidal_thoughts"))),
        F.when(promote & (F.col("_gm_u1") < 5), arrow("urgency_crisis_promoted", text_of("_gm_u1"), F.lit("5"))),
        F.when(demote & ~promote, F.lit("category_metaphor_demoted:crisis→life_stressor")),
        F.when(demote & ~promote & (F.col("_gm_u1") > 2), arrow("urgency_metaphor_capped", text_of("_gm_u1"), F.lit("2"))),
        F.when((F.col("_gm_c2") == "crisis") & (F.col("_gm_u2") < 4), arrow("urgency_crisis_floor", text_of("_gm_u2"), F.lit("4"))),
        F.when((F.col("_gm_c2") == "high_distress") & (F.col("_gm_u2") < 3), arrow("urgency_distress_floor", text_of("_gm_u2"), F.lit("3"))),
        F.when((F.col("_gm_c2") == "neutral") & (F.col("_gm_u2") > 1), arrow("urgency_neutral_cap", text_of("_gm_u2"), F.lit("1"))),
        F.when(raised, arrow("category_high_urgency_escalated", quoted(F.col("_gm_c2")), F.lit("high_distress"))),
        F.when(align, arrow("category_intent_aligned", quoted(F.col("_gm_c4")), quoted(F.col("_gm_want")))),
    )
    reason = F.when(F.lit(strict) & (F.col("_gm_absent") != ""), F.concat(F.lit("missing_fields:"), F.col("_gm_absent"))).when(F.col("_gm_text") == "", "empty_text")
    df = df.withColumns({"_corrections": F.concat("_gm_said", made), "_drop_reason": reason})
    df = df.withColumns({"text": F.col("_gm_text"), "intent": F.col("_gm_i2"), "category": F.col("_gm_c5"), "urgency": F.col("_gm_u3"), "language": F.col("_gm_l1")})
    return df.drop("_gm_absent", "_gm_said", "_gm_text", "_gm_folded", "_gm_meta", "_gm_risk", "_gm_low", "_gm_u", "_gm_i", "_gm_c", "_gm_l", "_gm_i1", "_gm_u1", "_gm_l1", "_gm_c1", "_gm_c2", "_gm_i2", "_gm_u2", "_gm_u3", "_gm_c4", "_gm_want", "_gm_c5")


def split_validated(df: DataFrame, **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(clean, corrected, dropped): the rules run once, into a table in the shared folder, and the three are filters on it."""
    done = table(validate(df, **options), "validated")
    kept, some = F.col("_drop_reason").isNull(), F.size("_corrections") > 0
    return done.where(kept & ~some).drop("_drop_reason"), done.where(kept & some).drop("_drop_reason"), done.where(~kept)
