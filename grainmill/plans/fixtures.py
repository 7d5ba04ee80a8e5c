"""Phrases and a small knowledge base that make the invented prose of test tables trigger the rules."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.taxonomy import CATEGORIES, INTENTS, RISK_EMOTIONS, RISK_IDIOMS, RISK_STRESSORS
from grainmill.operators.retrieval import KB_SCHEMA, STRESSOR

#: Classification examples, appended to documents by doc_id.
PHRASES = [
    "we walked home after lunch", "I want to die and I can't go on", "I will kill this exam tomorrow", "I am completely lost and nothing matters",
    "mujhe bahut tension hai aur nahi ho raha", "my parents are not happy and they think I fail", "here is an example of training data", "dying of laughter at this",
    "I already took pills", "everything feels hopeless and pointless", "he's hitting me and I am 15 years old", "what should I do about my exam result",
    "log kya kahenge, izzat ka sawal hai", "I got the job, so happy and excited", "arranged marriage next week, rishta fixed", "the loan and EMI are too much, I am worried",
    "I feel ashamed and lonely, meri galti", "am I overreacting to this", "coming out to a religious family", "JEE rank and NEET coaching, thak gaya",
    "doctor banu ya engineer, papa is angry", "see https://example.com/a?b=1 and www.example.org now!!!!", "Tom &amp; Ann &#39;quoted&#39; wait????", "don't need therapy, just stressed",
]
#: Texts that stand alone in conversations.
OPENERS = ["hello there", "kya haal hai", "I am fine", "sab theek", "good morning", "bahut gussa aata hai", "finally passed the exam", "please help, kya karun"]

KB = {
    "stressor_taxonomy": {
        "academic_pressure": {"label": "Academic pressure", "description": "Exams and ranks weigh on the person.", "signal_phrases": {"en": ["my exam", "my rank"], "hi-en-mix": ["padhai ka load"]}, "linked_emotions": ["anxiety", "fear"], "guardrails": ["no_comparison"], "cultural_context_notes": ["Ranks are public."], "what_not_to_say": ["just study harder"]},
        "marriage_pressure": {"label": "Marriage pressure", "description": "Family expects a match.", "signal_phrases": {"en": ["they found a match"], "bn": []}, "linked_emotions": ["conflict"], "guardrails": []},
        "financial_stress": {"description": "Money is short.", "signal_phrases": {}, "linked_emotions": [], "guardrails": ["no_advice", "no_comparison"]},
    },
    "tone_modes": {"gentle_reframe": {"description": "Softly offers another view.", "when_to_use": ["identity", "marriage"], "linguistic_markers": {"prefer": ["perhaps"], "avoid": ["must", "never"]}}},
    "guardrail_registry": {"no_comparison": "Do not compare with others.", "no_advice": "Give no financial advice."},
    "cultural_idioms": {"izzat": {"translation": "honour", "meaning": "Standing of the family.", "linked_stressors": ["marriage_pressure"]}},
    "crisis_keywords": {"tier_2": ["forced to marry"], "tier_3": ["no point"]},
}


def knowledge_base(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.from_json(F.lit(json.dumps(KB)), f"struct<{', '.join(_colon(KB_SCHEMA))}>").alias("kb")).select("kb.*")


def knowledge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge base document for each of the documents, made from its words: two stressors, a tone, a rule, an idiom, crisis keywords."""
    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    text, lang, source = (F.coalesce(c, F.lit("")) for c in ("text", "lang", "source"))
    words = F.split(text, " ")
    null, none = lambda kind: F.lit(None).cast(kind), F.array().cast("array<string>")
    own = {name: kind for name, kind in (f.split(": ", 1) for f in _fields(STRESSOR))}
    stressor = lambda **given: F.struct(*[given.get(n, null(t)).alias(n) for n, t in own.items()])
    first = stressor(
        label=F.when(i % 3 != 0, source), description=F.substring(text, 1, 60), signal_phrases=F.map_from_arrays(F.array(lang, F.lit("xx")), F.array(F.slice(words, 1, 14), none)),
        linked_emotions=F.when(i % 2 == 0, F.array(pick(RISK_EMOTIONS, i), F.lit("calm"))), guardrails=F.when(i % 5 == 0, F.array(F.concat(F.lit("g"), i), F.lit("g0"))).otherwise(none),
    )
    named = lambda letter: F.concat(F.lit(letter), i.cast("string"))
    idiom = F.struct(lang.alias("translation"), source.alias("meaning"), F.array(named("s")).alias("linked_stressors"), null("boolean").alias("risk_amplifier"), null("array<string>").alias("escalates_stressors"))
    tone = F.struct(source.alias("description"), F.array(lang).alias("when_to_use"), F.struct(F.slice(words, 1, 2).alias("prefer"), none.alias("avoid")).alias("linguistic_markers"))
    return d.select(
        F.create_map(named("s"), first, pick(RISK_STRESSORS, i), stressor(label=named("r"))).alias("stressor_taxonomy"), F.create_map(named("t"), tone).alias("tone_modes"),
        F.create_map(named("g"), F.substring(text, 1, 30)).alias("guardrail_registry"), F.create_map(pick([*RISK_IDIOMS, "other"], i), idiom).alias("cultural_idioms"),
        F.create_map(F.lit("tier_3"), F.slice(words, 1, 14), F.lit("tier_2"), F.array(F.lit("a")), F.lit("tier_4"), F.when(i % 2 == 0, F.array(source)).otherwise(none)).alias("crisis_keywords"),
        F.create_map(F.lit("version"), F.lit("1"), F.lit("doc"), i.cast("string")).alias("_meta"),
    )


def _fields(ddl: str) -> list[str]:
    from grainmill.operators.retrieval import _split_fields

    return [f.strip() for f in _split_fields(ddl)]


def _colon(ddl: str) -> list[str]:
    from grainmill.operators.retrieval import _split_fields

    return [": ".join(f.strip().split(" ", 1)) for f in _split_fields(ddl)]


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as labelled records: doc_id, text, language, intent, category, urgency."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select(
        "doc_id", F.concat(F.col("text"), F.lit(" "), pick(PHRASES, F.col("doc_id"))).alias("text"), F.when(F.col("lang") == "en", "en").otherwise("hi-en-mix").alias("language"),
        pick(INTENTS, F.col("doc_id")).alias("intent"), pick(CATEGORIES, F.floor(F.col("doc_id") / 26)).alias("category"), (F.col("doc_id") % 7).cast("int").alias("urgency"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations: conv_id, turn, role, text; every other turn is an opener alone, the rest have a phrase appended."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    at = F.col("conv_id") + F.col("turn")
    text = F.when(at % 2 == 0, pick(OPENERS, F.floor(at / 2))).otherwise(F.concat(F.col("text"), F.lit(" "), pick(PHRASES, at)))
    return c.select("conv_id", "turn", "role", text.alias("text"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, true and predicted intents and urgencies."""
    d, i = spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id")
    off = F.when(i % 5 == 0, i % 3).otherwise(0)
    return d.select("doc_id", "text", pick(INTENTS, i).alias("true_intent"), pick(INTENTS, i + off).alias("pred_intent"), (i % 5 + 1).cast("int").alias("true_urgency"), ((i * 7 + off) % 5 + 1).cast("int").alias("pred_urgency"))
