"""Tolerant parsing of model output: fenced JSON, delimited replies, key=value lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.taxonomy import SEED_EMOTIONS
from grainmill.functions.text import SPACE, anycase, strip

ITEM = "text: string, intent: string, category: string, urgency: string, language: string"
FIELD = "|".join(P.META_FIELDS)


def unfence(raw: Column) -> Column:
    """Without the marks of a fenced block at the beginnings and ends of lines."""
    opened = F.regexp_replace(strip(raw), r"(?m)^```(?:json)?\s*", "")
    return F.regexp_replace(strip(opened), r"(?m)\s*```\s*$", "")


def json_array(raw: Column, item: str = ITEM, fallback: str = r"(?s)\[.*?\]") -> Column:
    """Objects of the array that the text is, else of the first array in it; null if there is none that parses.

    The fallback ends at the first closing bracket. Values of other types than text are read as their text.
    """
    text = unfence(raw)
    schema = f"array<struct<{item}>>"
    whole, inside = F.from_json(text, schema), F.from_json(F.regexp_extract(text, fallback, 0), schema)
    return F.when(text.rlike(r"(?s)^\s*\[.*\]\s*$") & whole.isNotNull(), whole).otherwise(inside)


def records(df: DataFrame, raw: str = "raw", intent: str = "intent", category: str = "category", least: int = 5) -> DataFrame:
    """df's other columns (the asked intent and category as _asked_intent, _asked_category) and one row for each usable object: text, intent, category, urgency, language.

    Texts under `least` characters go. Urgency is clamped to 1..5; one that is no whole number becomes 2.
    """
    keep = [c for c in df.columns if c not in (raw, intent, category, "text", "urgency", "language")]
    asked = [F.col(intent).alias("_asked_intent"), F.col(category).alias("_asked_category")]
    rows = df.select(*keep, *asked, F.explode(json_array(F.col(raw))).alias("_o")).where("_o IS NOT NULL")
    number = F.expr("try_cast(try_cast(_o.urgency AS double) AS int)")
    rows = rows.select(*keep, "_asked_intent", "_asked_category", strip(F.coalesce("_o.text", F.lit(""))).alias("text"), F.coalesce("_o.intent", "_asked_intent").alias("intent"), F.coalesce("_o.category", "_asked_category").alias("category"), F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(number, F.lit(2)))).alias("urgency"), F.coalesce("_o.language", F.lit("en")).alias("language"))
    return rows.where(F.length("text") >= least)


#: Where the seed parser looks for an array when the text is none: from a bracket before an object to one behind an object.
SEED_FALLBACK = r"(?s)\[\s*\{.*?\}\s*\]"
SEED_ITEM = "text: string, language: string, script: string, intent: string, emotions: string, urgency_level: string"


def seed_records(df: DataFrame, raw: str = "raw", intent: str = "intent", language: str = "language", least: int = 10) -> DataFrame:
    """The seed set's variant of records(): text, language, script, intent, emotions, urgency_level of each usable object.

    Texts under `least` characters go; emotions are known names, four at most, given as a list or comma-joined.
    """
    keep = [c for c in df.columns if c not in (raw, intent, language, "text", "script", "emotions", "urgency_level")]
    rows = df.select(*keep, F.col(intent).alias("_gm_intent"), F.col(language).alias("_gm_language"), F.explode(json_array(F.col(raw), SEED_ITEM, SEED_FALLBACK)).alias("_gm_o")).where("_gm_o IS NOT NULL")
    given = F.regexp_replace(F.coalesce("_gm_o.emotions", F.lit("neutral")), r'[\[\]"]', "")
    known = F.filter(F.transform(F.split(given, ","), strip), lambda e: e.isin(SEED_EMOTIONS))
    emotions = F.when(F.size(known) > 0, F.array_join(F.slice(known, 1, 4), ",")).otherwise("neutral")
    level = F.coalesce(F.expr("try_cast(try_cast(_gm_o.urgency_level AS double) AS int)"), F.lit(1))
    rows = rows.select(*keep, strip(F.coalesce("_gm_o.text", F.lit(""))).alias("text"), F.coalesce("_gm_o.language", "_gm_language").alias("language"), F.coalesce("_gm_o.script", F.lit("latin_roman")).alias("script"), F.coalesce("_gm_o.intent", "_gm_intent").alias("intent"), emotions.alias("emotions"), F.least(F.lit(5), F.greatest(F.lit(1), level)).alias("urgency_level"))
    return rows.where(F.length("text") >= least)


def emotion_list(value: Column, most: int = 4) -> Column:
    """Known emotions of a comma-joined list, the first `most`, joined again; neutral if none."""
    known = F.filter(F.transform(F.split(F.lower(value), ","), strip), lambda e: e.isin(SEED_EMOTIONS))
    return F.when(F.coalesce(F.size(known), F.lit(0)) > 0, F.array_join(F.slice(known, 1, most), ",")).otherwise("neutral")


def truthy(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin("true", "1"), F.lit(False))


def risk_score(raw: Column) -> Column:
    """risk_level, tier, reason, safeguarding, helpline_key of the first JSON object in a reply; a safe default with the reason otherwise."""
    text = F.regexp_replace(F.regexp_replace(strip(raw), r"^```(?:json)?\s*", ""), r"\s*```\s*$", "")
    found = F.regexp_extract(text, r"(?s)\{.*?\}", 0)
    o = F.from_json(found, "struct<risk_level: string, tier: string, reason: string, safeguarding: string, _corrupt_record: string>", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    level = F.coalesce(o["risk_level"].try_cast("double").try_cast("int"), F.lit(1))
    problem = F.when(F.coalesce(found, F.lit("")) == "", "no_json_in_response").when(o["_corrupt_record"].isNotNull(), "json_parse_error").when(~level.between(1, 5), "invalid_risk_level")
    by_level = F.when(level == 1, "safe").otherwise(F.concat(F.lit("tier_"), level.cast("string")))
    tier = F.when(F.coalesce(o["tier"], F.lit("safe")).isin("safe", "tier_2", "tier_3", "tier_4", "tier_5"), F.coalesce(o["tier"], F.lit("safe"))).otherwise(by_level)
    # Any text but an empty one is true, as is any number but 0.
    guard = ~F.coalesce(o["safeguarding"], F.lit("false")).isin("false", "0", "0.0", "", "null", "[]", "{}")
    key = F.when(tier == "safe", "").when(tier == "tier_2", "tier_2_minor").otherwise(tier)
    ok = problem.isNull()
    return F.struct(
        F.when(ok, level).otherwise(1).alias("risk_level"), F.when(ok, tier).otherwise("safe").alias("tier"),
        F.when(ok, F.substring(F.coalesce(o["reason"], F.lit("")), 1, 100)).otherwise(problem).alias("reason"),
        F.when(ok, guard).otherwise(False).alias("safeguarding"), F.when(ok, key).otherwise("").alias("helpline_key"),
    )


def key_values(raw: Column) -> Column:
    """Field -> value of lines such as `emotion = calm`, the last of a field; other lines are passed over."""
    line = anycase(rf"^({FIELD})\s*=\s*(.+)$", "m").replace("(?iuUm)", "(?ium)")
    names, values = F.regexp_extract_all(raw, F.lit(line), F.lit(1)), F.regexp_extract_all(raw, F.lit(line), F.lit(2))
    pairs = F.arrays_zip(F.transform(names, F.lower).alias("k"), F.transform(values, strip).alias("v"))
    last = F.aggregate(pairs, F.create_map().cast("map<string,string>"), lambda m, p: F.map_concat(F.map_filter(m, lambda k, _: k != p["k"]), F.create_map(p["k"], p["v"])))
    return F.coalesce(last, F.create_map().cast("map<string,string>"))


def clean_reply(text: Column, risk: Column) -> Column:
    """A reply without section tags, an empty opener or a leading I, of at most 120 words (150 from risk 4)."""
    text = F.regexp_replace(text, r"(?i)\[(?:VALIDATION|REFLECTION|QUESTION)\]", "")
    text = strip(F.regexp_replace(text, anycase(P.HOLLOW_OPENER), ""))
    text = strip(F.regexp_replace(F.regexp_replace(text, r"^I\s+", ""), r"\n{3,}", "\n\n"))
    cap = F.when(risk >= 4, 150).otherwise(120)
    words = F.filter(F.split(text, rf"(?U){SPACE}+"), lambda w: w != "")
    return F.when(F.size(words) > cap, F.concat(F.regexp_replace(F.array_join(F.slice(words, F.lit(1), cap), " "), "[,:;]+$", ""), F.lit("..."))).otherwise(text)


def reply(df: DataFrame, raw: str = "raw", fallback: dict[str, Column] | None = None) -> DataFrame:
    """df with response, emotion, intent, stressor, urgency, risk, strategy, parse_strategy of a model's reply.

    exact: both delimiters, in order; partial: the first only; fallback: none, metadata from its first line on.
    Fields that are missing or empty come from `fallback` (columns by field), then from defaults.
    """
    defaults = {"emotion": F.lit("neutral"), "intent": F.lit("unknown"), "stressor": F.lit("none"), "urgency": F.lit(1), "risk": F.lit(1)} | (fallback or {})
    df = df.withColumn("_gm_t", strip(F.coalesce(F.col(raw), F.lit(""))))
    start = lambda p, c: F.coalesce(F.regexp_instr(c, F.lit(p)), F.lit(0))
    df = df.withColumns({"_gm_r": start(r"(?i)---RESPONSE---", F.col("_gm_t")), "_gm_m": start(r"(?i)---METADATA---", F.col("_gm_t"))})
    exact = (F.col("_gm_r") > 0) & (F.col("_gm_m") > F.col("_gm_r"))
    after = lambda c, at: F.regexp_replace(F.substr(c, at), r"^(?i)---(RESPONSE|METADATA)---\s*", "")
    df = df.withColumn("_gm_tail", F.when(F.col("_gm_r") > 0, after(F.col("_gm_t"), F.col("_gm_r"))).otherwise(F.col("_gm_t")))
    df = df.withColumn("_gm_kv", start(rf"(?im)^({FIELD})\s*=\s*(.+)$", strip(F.col("_gm_tail"))))
    head = F.regexp_replace(F.substr(F.col("_gm_t"), F.lit(1), F.col("_gm_m") - 1), r"(?is)^.*?---RESPONSE---\s*", "")
    body = F.when(exact, head).when(F.col("_gm_kv") > 0, F.substr(strip(F.col("_gm_tail")), F.lit(1), F.col("_gm_kv") - 1)).otherwise(F.col("_gm_tail"))
    meta = F.when(exact, after(F.col("_gm_t"), F.col("_gm_m"))).when(F.col("_gm_kv") > 0, F.substr(strip(F.col("_gm_tail")), F.col("_gm_kv"))).otherwise("")
    df = df.withColumns({"_gm_body": strip(body), "_gm_meta": key_values(strip(meta)), "_gm_how": F.when(exact, "exact").when(F.col("_gm_r") > 0, "partial").otherwise("fallback")})
    text = lambda f: F.coalesce(F.nullif(F.col("_gm_meta")[f], F.lit("")), defaults[f])
    number = lambda f: F.least(F.lit(5), F.greatest(F.lit(1), F.coalesce(strip(F.col("_gm_meta")[f]).try_cast("int"), defaults[f].cast("int"))))
    risk_cap = F.coalesce(F.col("_gm_meta")["risk"].try_cast("int"), defaults["risk"].cast("int"))
    strategy = F.filter(F.transform(F.split(F.coalesce(F.col("_gm_meta")["strategy"], F.lit("")), ","), strip), lambda s: s != "")
    out = df.withColumns({
        "response": clean_reply(F.col("_gm_body"), risk_cap), "emotion": text("emotion"), "intent": text("intent"), "stressor": text("stressor"),
        "urgency": number("urgency"), "risk": number("risk"), "strategy": strategy, "parse_strategy": F.col("_gm_how"),
    })
    return out.drop("_gm_t", "_gm_r", "_gm_m", "_gm_tail", "_gm_kv", "_gm_body", "_gm_meta", "_gm_how")


def stream_text(df: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """key, text: the pieces of NDJSON token streams joined up to the first that says done; lines that do not parse are passed over."""
    o = F.from_json(F.col(line), "struct<response: string, message: struct<content: string>, done: boolean>")
    rows = df.select(key, F.col(order).alias("_at"), F.coalesce(o["response"], o["message"]["content"], F.lit("")).alias("_piece"), F.coalesce(o["done"], F.lit(False)).alias("_done"))
    ends = rows.groupBy(key).agg(F.min(F.when(F.col("_done"), F.col("_at"))).alias("_end"))
    good = rows.join(ends, key).where("_end IS NULL OR _at <= _end")
    pieces = F.array_sort(F.collect_list(F.struct("_at", "_piece")))
    return good.groupBy(key).agg(F.array_join(F.transform(pieces, lambda p: p["_piece"]), "").alias("text"))
