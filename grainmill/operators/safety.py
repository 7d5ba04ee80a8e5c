"""Risk cascade: the first tier whose patterns match decides; everything is native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.taxonomy import HELPLINES, RISK_EMOTIONS, RISK_IDIOMS, RISK_STRESSORS
from grainmill.functions.text import folded, found

#: Tiers in the order in which they are tried.
TIERS = ((5, P.RISK_TIER_5), (4, P.RISK_TIER_4), (3, P.RISK_TIER_3), (2, P.RISK_TIER_2))
SHOWN = 80


def _first_pattern(low: Column, listed: list[str]) -> Column:
    """Source of the first pattern that matches, at most SHOWN characters; null if none."""
    return F.coalesce(*[F.when(found(low, p), F.lit(p[:SHOWN])) for p in listed])


def helpline(key: Column) -> Column:
    entry = lambda v: F.struct(*[F.lit(x).alias(n) for n, x in zip(("name", "number", "hours"), v, strict=True)])
    return F.create_map(*[x for k, v in HELPLINES.items() for x in (F.lit(k), entry(v))])[key]


def assess(df: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """df with is_crisis, risk_level, tier, matched_pattern, helpline_name, helpline_number, helpline_hours, safeguarding.

    A harmless figure of speech exits as safe before any tier; null text is safe. No match: level 1, tier safe.
    """
    t, low = F.coalesce(F.col(text), F.lit("")), F.col("_gm_low")
    df = df.withColumn("_gm_low", folded(t))
    df = df.withColumn("_gm_metaphor", reduce(or_, [found(low, p) for p in P.RISK_METAPHORS]))
    df = df.withColumns({f"_gm_p{level}": F.when(~F.col("_gm_metaphor"), _first_pattern(low, listed)) for level, listed in TIERS})
    met = [F.col(f"_gm_p{level}").isNotNull() for level, _ in TIERS]
    level = F.when(met[0], 5).when(met[1], 4).when(met[2], 3).when(met[3], 2).otherwise(1)
    key = F.when(met[0], "tier_5").when(met[1], "tier_4").when(met[2], "tier_3").when(met[3] & found(low, P.RISK_MINOR), "tier_2_minor").when(met[3], "tier_2_adult")
    df = df.withColumns({"_gm_level": level, "_gm_line": helpline(key)})
    out = {
        "is_crisis": F.col("_gm_level") > 1, "risk_level": F.col("_gm_level"),
        "tier": F.when(F.col("_gm_level") > 1, F.concat(F.lit("tier_"), F.col("_gm_level").cast("string"))).otherwise("safe"),
        "matched_pattern": F.coalesce(*[F.col(f"_gm_p{level}") for level, _ in TIERS], F.lit("")),
        "helpline_name": F.coalesce(F.col("_gm_line.name"), F.lit("")), "helpline_number": F.coalesce(F.col("_gm_line.number"), F.lit("")), "helpline_hours": F.coalesce(F.col("_gm_line.hours"), F.lit("")),
        "safeguarding": F.col("_gm_level") == 2,
    }
    return df.withColumns({f"{prefix}{k}": v for k, v in out.items()}).drop("_gm_low", "_gm_metaphor", "_gm_level", "_gm_line", *[f"_gm_p{level}" for level, _ in TIERS])


def hard_exit(level: Column) -> Column:
    """Levels that end the turn at once; 3 goes on."""
    return level.isin(2, 4, 5)


def score_helpline(key: Column, safeguarding: Column, text: Column) -> Column:
    """Helpline of a scored risk: by age when safeguarding, else by key, tier_3 by default."""
    by_age = F.when(found(folded(text), P.SCORE_MINOR), "tier_2_minor").otherwise("tier_2_adult")
    given = F.when(key.isin(*HELPLINES), key).otherwise("tier_3")
    return helpline(F.when(safeguarding, by_age).otherwise(given))


def combine(df: DataFrame, regex_level: str, scored_level: str, urgency: str) -> DataFrame:
    """df with effective_risk, risk_source, risk_action of a turn that goes on."""
    both = F.greatest(F.coalesce(F.col(regex_level), F.lit(1)), F.coalesce(F.col(scored_level), F.lit(1)))
    source = F.when(F.col(scored_level) >= 3, "llm").when(F.col(regex_level) > 1, "regex").otherwise("none")
    action = F.when(F.col("effective_risk") == 3, "crisis_calm_conversation").when(F.col(urgency) == 2, "gentle_checkin").otherwise("none")
    return df.withColumn("effective_risk", both).withColumns({"risk_source": source, "risk_action": action})


def exit_action(level: Column) -> Column:
    return F.when(level == 5, "crisis_overlay").when(level == 4, "urgent_prompt").otherwise("safeguarding")


#: Replies at a hard exit, by case; {name} and {number} are filled in. A deployment passes its own wording.
EXIT_REPLIES = {
    "minor": "What you describe is serious and you have a right to help. Please call {name} now: {number}.",
    "safeguarding": "The situation you describe is not safe and you deserve support. Please talk to {name}: {number}.",
    "immediate": "You are not alone. Please call {name} now: {number}.",
    "direct": "What you feel is very heavy and you need not carry it alone. Please talk to {name}: {number}.",
}


def exit_reply(level: Column, name: Column, number: Column, safeguarding: Column, replies: dict[str, str] = EXIT_REPLIES) -> Column:
    name = F.when(F.coalesce(name, F.lit("")) == "", HELPLINES["tier_4"][0]).otherwise(name)
    number = F.when(F.coalesce(number, F.lit("")) == "", HELPLINES["tier_4"][1]).otherwise(number)
    case = F.when(safeguarding & (name == HELPLINES["tier_2_minor"][0]), replies["minor"]).when(safeguarding, replies["safeguarding"]).when(level == 5, replies["immediate"]).otherwise(replies["direct"])
    return F.replace(F.replace(case, F.lit("{name}"), name), F.lit("{number}"), number)


def risk_phrases(kb: DataFrame, most: int = 12) -> DataFrame:
    """tier, phrases: the first `most` crisis phrases of each tier of a knowledge base."""
    return kb.select(F.explode("crisis_keywords").alias("tier", "phrases")).where(F.col("tier").isin("tier_3", "tier_4", "tier_5")).select("tier", F.slice("phrases", 1, most).alias("phrases"))


def risk_prompt(kb: DataFrame, template: str, most: int = 12) -> DataFrame:
    """kb with risk_prompt: the template of a risk scorer with {phrases}, {stressors}, {high_risk} and {idioms} filled in from the document.

    phrases: the first `most` of each scored tier; stressors: those that call for safeguarding, as `id: label`; high_risk:
    those linked with an emotion that does; idioms: those that carry shame, with their translation. Empty parts say so.
    """
    none = F.array().cast("array<string>")
    keyword = lambda t: F.coalesce(F.slice(F.col("crisis_keywords")[t], 1, most), none)
    phrases = F.flatten(F.array(*[F.when(F.size(keyword(t)) > 0, F.concat(F.array(F.lit(f"  {t}:")), F.transform(keyword(t), lambda p: F.concat(F.lit("    - "), p)))).otherwise(none) for t in ("tier_3", "tier_4", "tier_5")]))
    named = lambda e: F.concat(F.lit("  - "), e["key"], F.lit(": "), F.coalesce(e["value"]["label"], e["key"]))
    some = lambda keep: F.transform(F.filter(F.map_entries("stressor_taxonomy"), keep), named)
    idioms = F.transform(F.filter(F.map_entries("cultural_idioms"), lambda e: e["key"].isin(RISK_IDIOMS)), lambda e: F.concat(F.lit("  '"), e["key"], F.lit("' ("), F.coalesce(e["value"]["translation"], F.lit("")), F.lit(")")))
    parts = {
        "phrases": (phrases, "  (no crisis phrases)"),
        "stressors": (some(lambda e: e["key"].isin(RISK_STRESSORS)), "  (none listed)"),
        "high_risk": (some(lambda e: F.arrays_overlap(F.coalesce(e["value"]["linked_emotions"], none), F.array(*[F.lit(x) for x in RISK_EMOTIONS]))), "  (none listed)"),
        "idioms": (idioms, "  (none)"),
    }
    text = F.lit(template)
    for name, (lines, empty) in parts.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(F.when(F.size(lines) > 0, F.array_join(F.array_sort(lines) if name != "phrases" else lines, "\n")), F.lit(empty)))
    return kb.withColumn("risk_prompt", text).select("risk_prompt")
