"""The functions under SQL names: scalar ones and table functions for lateral joins. All are SQL, so Catalyst sees through them."""

from __future__ import annotations

from pyspark.sql import SparkSession

from grainmill.functions.text import NOT_WORD, SPACE, SPACES
from grainmill.operators.parse import ITEM, SEED_FALLBACK

_SPACES = "".join(f"\\u{ord(c):04X}" for c in SPACES)
_ARRAY = "array<struct<{}>>"


def _items(fallback: str, item: str) -> str:
    schema = f"'{_ARRAY.format(item)}'"
    return rf"CASE WHEN t RLIKE r'(?s)^\s*\[.*\]\s*$' AND from_json(t, {schema}) IS NOT NULL THEN from_json(t, {schema}) ELSE from_json(regexp_extract(t, r'{fallback}', 0), {schema}) END"


#: Name and signature, result, body. Later ones use earlier ones.
FUNCTIONS = [
    ("gm_strip(t STRING)", "STRING", f"btrim(t, '{_SPACES}')"),
    ("gm_squeeze(t STRING)", "STRING", f"regexp_replace(t, r'(?U){SPACE}+', ' ')"),
    ("gm_words(t STRING)", "ARRAY<STRING>", f"filter(split(gm_strip(t), r'(?U){SPACE}+'), w -> w != '')"),
    ("gm_fingerprint(t STRING)", "STRING", f"md5(gm_strip(gm_squeeze(regexp_replace(lower(t), r'(?U){NOT_WORD}', ''))))"),
    ("gm_seed_fingerprint(t STRING)", "STRING", f"md5(regexp_replace(gm_squeeze(gm_strip(lower(t))), r'(?U){NOT_WORD}', ''))"),
    ("gm_unfence(raw STRING)", "STRING", r"regexp_replace(gm_strip(regexp_replace(gm_strip(raw), r'(?m)^```(?:json)?\s*', '')), r'(?m)\s*```\s*$', '')"),
    ("gm_overlap(a ARRAY<STRING>, b ARRAY<STRING>)", "DOUBLE", "size(array_intersect(a, b)) / nullif(greatest(size(array_distinct(a)), size(array_distinct(b))), 0)"),
    (
        "gm_records(raw STRING, asked_intent STRING, asked_category STRING)",
        "TABLE (text STRING, intent STRING, category STRING, urgency INT, language STRING)",
        f"""SELECT gm_strip(coalesce(o.text, '')), coalesce(o.intent, asked_intent), coalesce(o.category, asked_category), least(5, greatest(1, coalesce(try_cast(try_cast(o.urgency AS DOUBLE) AS INT), 2))), coalesce(o.language, 'en')
          FROM (SELECT explode(items) AS o FROM (SELECT {_items(r"(?s)\[.*?\]", ITEM)} AS items FROM (SELECT gm_unfence(raw) AS t))) WHERE o IS NOT NULL AND length(gm_strip(coalesce(o.text, ''))) >= 5""",
    ),
    (
        "gm_seed_texts(raw STRING)",
        "TABLE (text STRING)",
        f"""SELECT gm_strip(coalesce(o.text, '')) FROM (SELECT explode(items) AS o FROM (SELECT {_items(SEED_FALLBACK, "text: string")} AS items FROM (SELECT gm_unfence(raw) AS t))) WHERE o IS NOT NULL AND length(gm_strip(coalesce(o.text, ''))) >= 10""",
    ),
]


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session; their names. Registering them again replaces them."""
    for signature, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    return [signature.split("(")[0] for signature, _, _ in FUNCTIONS]
