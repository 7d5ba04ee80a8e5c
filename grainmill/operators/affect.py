"""Language, intent, emotion, tone and technique of a text, by ordered pattern rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions import taxonomy as X
from grainmill.functions.text import count_words, folded, found, found_words, may_match, messages, quick, strip, word_hits, word_list


def language_of(text: Column, lowered: Column) -> Column:
    mixed = F.size(F.array_intersect(word_list(lowered), F.array(*[F.lit(w) for w in P.MIXED_WORDS]))) >= 2
    return F.when(text.rlike("[\\x{0900}-\\x{097F}]"), "hi").when(text.rlike("[\\x{0980}-\\x{09FF}]"), "bn").when(mixed, "hi-en-mix").otherwise("en")


def sentiment(low: Column, hits: Column) -> Column:
    score = (count_words(low, hits, P.POSITIVE_WORDS) - count_words(low, hits, P.NEGATIVE_WORDS)) * F.lit(0.2)
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score)), 2)


def idioms(text: Column, low: Column) -> Column:
    return messages(*[F.when(F.coalesce(may_match(low, p) & text.rlike(quick(p)), F.lit(False)) if k in P.CASED_IDIOMS else found(low, p), F.lit(k)) for k, p in P.IDIOMS.items()])


def named(lowered: Column, names: list[str]) -> Column:
    """Names found anywhere in the text, inside words too."""
    return messages(*[F.when(lowered.contains(n.lower()), F.lit(n)) for n in names])


def technique(intent: Column, emotion: Column) -> Column:
    keys = F.create_map(*[x for (i, e), t in X.TECHNIQUES.items() for x in (F.lit(f"{i}|{e}"), F.lit(t))])
    return F.coalesce(keys[F.concat_ws("|", intent, emotion)], F.lit(X.OTHER_TECHNIQUE))


#: Signals of the lower-cased text.
SIGNALS = {
    "positive": P.POSITIVE, "advice": P.ADVICE, "family": P.FAMILY, "academic": P.ACADEMIC, "validation": P.VALIDATION, "identity": P.IDENTITY,
    "marriage": P.MARRIAGE, "financial": P.FINANCIAL, "social": P.SOCIAL, "hopeless": P.HOPELESS, "guilt": P.GUILT, "love": P.LOVE,
    "anxiety": P.ANXIETY, "shame": P.SHAME, "loneliness": P.LONELINESS, "overwhelm": P.OVERWHELM, "anger": P.ANGER,
}
#: Emotions that a signal adds, in order.
ADDED = ("guilt", "love", "anxiety", "shame", "loneliness", "overwhelm", "anger")
#: Intent and stressor of the first signals that match; several signals must all match.
INTENT_RULES = (
    (("greeting",), "greeting", "none"),
    (("positive",), "share_positive_news", "none"),
    (("advice", "family"), "ask_for_advice", "family_career_expectations"),
    (("advice", "academic"), "ask_for_advice", "academic_pressure"),
    (("advice",), "ask_for_advice", "none"),
    (("validation",), "seek_validation", "none"),
    (("identity",), "express_identity_conflict", "identity_conflict"),
    (("marriage",), "express_marriage_pressure", "marriage_pressure"),
    (("financial",), "express_financial_stress", "financial_stress"),
    (("social",), "express_social_judgment", "social_judgment"),
    (("academic",), "express_academic_pressure", "academic_pressure"),
    (("family",), "express_family_pressure", "family_career_expectations"),
)


def detect(df: DataFrame, text: str = "text") -> DataFrame:
    """df with intent, primary_emotion, secondary_emotion, emotions_all, urgency_level, stressor_type, tone_mode, lang_code,
    sentiment_score, idioms_detected, stigma_flag, cbt_technique, entities_persons, entities_roles.

    The words that the patterns ask for are looked up in one pass over the text (text.word_hits); matches are made once,
    in a projection of their own; the cascades read only their booleans. Null text counts as empty.
    """
    df = df.withColumns({"_gm_raw": F.coalesce(F.col(text), F.lit(""))}).withColumns({"_gm_t": strip(F.lower("_gm_raw")), "_gm_low": strip(folded(F.col("_gm_raw")))})
    t, low, hits = F.col("_gm_t"), F.col("_gm_low"), F.col("_gm_hits")
    df = df.withColumn("_gm_hits", word_hits(low, [*SIGNALS.values(), P.STIGMA, P.POSITIVE_WORDS, P.NEGATIVE_WORDS]))
    # Greetings are anchored to the beginning: no search for their literals is cheaper than the match itself.
    begins = lambda p: F.coalesce(low.rlike(quick(p.lower())), F.lit(False))
    greeting = (begins(P.GREETING_OPENER) & (F.size(word_list(t)) <= 6)) | begins(P.GREETING_EXACT) | begins(P.GREETING_CHECK_IN)
    df = df.withColumns({f"_gm_{k}": found_words(low, hits, p) for k, p in SIGNALS.items()} | {"_gm_greeting": greeting})
    intent, stressor = F.lit("vent_frustration"), F.lit("none")
    for signals, i, s in reversed(INTENT_RULES):
        met = F.col(f"_gm_{signals[0]}")
        for more in signals[1:]:
            met = met & F.col(f"_gm_{more}")
        intent, stressor = F.when(met, i).otherwise(intent), F.when(met, s).otherwise(stressor)
    df = df.withColumns({"_gm_intent": intent, "_gm_stressor": stressor, "_gm_urgency": F.when(~F.col("_gm_greeting") & F.col("_gm_hopeless"), 2).otherwise(1)})
    base = F.create_map(*[x for k, v in X.BASE_EMOTIONS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in v]))])[F.col("_gm_intent")]
    fixed = F.col("_gm_intent").isin("greeting", "share_positive_news")
    more = [F.when(F.col(f"_gm_{e}"), F.lit(e)) for e in ADDED] + [F.when((F.col("_gm_urgency") >= 2) & (F.col("_gm_intent") == "express_academic_pressure"), F.lit("inadequacy"))]
    df = df.withColumn("_gm_emotions", F.when(fixed, base).otherwise(F.slice(F.array_union(base, messages(*more)), 1, 4)))
    tone = F.coalesce(F.create_map(*[F.lit(x) for pair in X.TONES.items() for x in pair])[F.col("_gm_intent")], F.lit(X.OTHER_TONE))
    return df.withColumns({
        "intent": F.col("_gm_intent"), "primary_emotion": F.get("_gm_emotions", F.lit(0)), "secondary_emotion": F.get("_gm_emotions", F.lit(1)), "emotions_all": F.col("_gm_emotions"),
        "urgency_level": F.col("_gm_urgency"), "stressor_type": F.col("_gm_stressor"), "tone_mode": F.when(F.col("_gm_urgency") >= 3, "crisis_calm").otherwise(tone),
        "lang_code": language_of(F.col("_gm_raw"), t), "sentiment_score": sentiment(low, hits), "idioms_detected": idioms(F.col("_gm_raw"), low), "stigma_flag": found_words(low, hits, P.STIGMA),
        "cbt_technique": technique(F.col("_gm_intent"), F.get("_gm_emotions", F.lit(0))), "entities_persons": named(t, P.PERSONS), "entities_roles": named(t, P.ROLES),
    }).drop("_gm_raw", "_gm_t", "_gm_low", "_gm_hits", "_gm_greeting", "_gm_intent", "_gm_stressor", "_gm_urgency", "_gm_emotions", *[f"_gm_{k}" for k in SIGNALS])
