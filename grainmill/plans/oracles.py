"""DuckDB SQL with the same results as the queries, from the same patterns and tables.

DuckDB matches bytes of ASCII classes, so texts are folded first: other letters become z, other characters spaces.
"""

from __future__ import annotations

from collections.abc import Sequence

from grainmill.functions import patterns as P
from grainmill.functions import taxonomy as X
from grainmill.operators.affect import ADDED, INTENT_RULES, SIGNALS
from grainmill.operators.safety import EXIT_REPLIES, SHOWN, TIERS
from grainmill.plans.fixtures import OPENERS, PHRASES

WS = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def array(values: Sequence[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def fold(c: str) -> str:
    return rf"regexp_replace(regexp_replace({c}, '[^\p{{L}}\p{{N}}_\x00-\x7F]', ' ', 'g'), '[^\x00-\x7F]', 'z', 'g')"


def has(c: str, pattern: str, case: bool = False) -> str:
    return f"regexp_matches({c}, {q(pattern if case else '(?i)' + pattern)})"


def count(c: str, pattern: str, case: bool = False) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern if case else '(?i)' + pattern)}))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def pick(values: Sequence[str], at: str) -> str:
    return f"({array(values)})[(({at}) % {len(values)} + 1)::INT]"


RECORDS = f"""SELECT doc_id, text || ' ' || {pick(PHRASES, "doc_id")} AS text, CASE WHEN lang = 'en' THEN 'en' ELSE 'hi-en-mix' END AS language,
  {pick(X.INTENTS, "doc_id")} AS intent, {pick(X.CATEGORIES, "doc_id // 26")} AS category, (doc_id % 7)::INT AS urgency FROM documents"""
TURNS = f"""SELECT conv_id, turn, role, CASE WHEN (conv_id + turn) % 2 = 0 THEN {pick(OPENERS, "(conv_id + turn) // 2")} ELSE text || ' ' || {pick(PHRASES, "conv_id + turn")} END AS text FROM conversations"""
PREDICTIONS = f"""SELECT doc_id, text, {pick(X.INTENTS, "doc_id")} AS true_intent,
  {pick(X.INTENTS, "doc_id + CASE WHEN doc_id % 5 = 0 THEN doc_id % 3 ELSE 0 END")} AS pred_intent, (doc_id % 5 + 1)::INT AS true_urgency,
  ((doc_id * 7 + CASE WHEN doc_id % 5 = 0 THEN doc_id % 3 ELSE 0 END) % 5 + 1)::INT AS pred_urgency FROM documents"""


def scrub(c: str) -> str:
    steps = [
        (r"[\x{200b}\x{200c}\x{200d}\x{feff}\x{00ad}]", ""),
        ("&[a-z]+;|&#[0-9]+;", " "),
        (r"https?://[^\s\x{85}\p{Z}]+|www\.[^\s\x{85}\p{Z}]+", "[link]"),
        (r"([?!.,]){3,}", r"\1\1"),
        (r"[ \t]{2,}", " "),
        (r"\n{3,}", "\n\n"),
    ]
    c = f"nfc_normalize({c})"
    for pattern, new in steps:
        c = f"regexp_replace({c}, {q(pattern)}, {q(new)}, 'g')"
    return strip(c)


CLEANED = rf"""
a AS (SELECT *, text AS original, {scrub("text")} AS s, {has(fold("text"), P.META_LANGUAGE)} AS meta FROM r),
b AS (SELECT *, CASE WHEN meta THEN 'meta_language_detected' WHEN length(s) < 8 THEN 'too_short' END AS reason,
  CASE WHEN length(s) > 1200 THEN regexp_replace(substring(s, 1, 1200), '{WS}+$', '') ELSE s END AS short FROM a),
c AS (SELECT *, {fold("short")} AS f FROM b),
d AS (SELECT *, {count("f", P.CLEAN_HINDI)} AS hindi, {count("f", P.CLEAN_ENGLISH, True)} AS english FROM c),
cleaned AS (SELECT doc_id, intent, category, urgency, reason, language AS given, CASE WHEN reason IS NULL THEN short ELSE original END AS text,
  CASE WHEN reason IS NULL AND language = 'en' AND hindi >= 3 THEN 'hi-en-mix' WHEN reason IS NULL AND language = 'hi-en-mix' AND hindi = 0 AND english >= 3 THEN 'en' ELSE language END AS language FROM d)
"""


def fingerprint(c: str) -> str:
    return f"md5({strip(rf'''regexp_replace(regexp_replace(lower({c}), '[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g'), '{WS}+', ' ', 'g')''')})"


def seed_fingerprint(c: str) -> str:
    return rf"md5(regexp_replace(regexp_replace({strip(f'lower({c})')}, '{WS}+', ' ', 'g'), '[^\p{{L}}\p{{N}}_\s\x1c-\x1f\x{{85}}\p{{Z}}]', '', 'g'))"


def category_of(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(i)} THEN {q(k)}" for i, k in X.INTENT_CATEGORY.items()) + " END"


def validated(source: str) -> str:
    """Common table expressions on `source` (doc_id, text, intent, category, urgency, language); the last is named v5."""
    return rf"""
v0 AS (SELECT doc_id, {strip("text")} AS text, urgency, intent AS i, category AS c, language AS l FROM {source}),
v1 AS (SELECT *, {fold("text")} AS f, greatest(1, least(5, urgency)) AS u1, CASE WHEN list_contains({array(X.INTENTS)}, i) THEN i ELSE 'casual_chat' END AS i1,
  CASE WHEN list_contains({array(X.LANGUAGES)}, l) THEN l ELSE 'en' END AS l1 FROM v0),
v2 AS (SELECT *, CASE WHEN list_contains({array(X.CATEGORIES)}, c) THEN c ELSE {category_of("i1")} END AS c1,
  {has("f", P.LABEL_METAPHOR)} AS metaphor, {has("f", P.LABEL_CRISIS)} AS risk, {has("f", P.LABEL_DISTRESS)} AS low FROM v1),
v3 AS (SELECT *, risk AND NOT metaphor AS promote, metaphor AND c1 = 'crisis' AS demote, i1 IN ('self_harm_intent', 'suicidal_thoughts') AS own FROM v2),
v4 AS (SELECT *, CASE WHEN promote THEN 'crisis' WHEN demote THEN 'life_stressor' ELSE c1 END AS c2, CASE WHEN promote AND NOT own THEN 'suicidal_thoughts' ELSE i1 END AS i2,
  CASE WHEN promote THEN 5 WHEN demote THEN least(u1, 2) ELSE u1 END AS u2 FROM v3),
v4b AS (SELECT *, CASE c2 WHEN 'crisis' THEN greatest(u2, 4) WHEN 'high_distress' THEN greatest(u2, 3) WHEN 'neutral' THEN 1 ELSE u2 END AS u3, {category_of("i2")} AS want FROM v4),
v4c AS (SELECT *, u3 >= 4 AND c2 NOT IN ('crisis', 'high_distress') AND low AS raised FROM v4b),
v4d AS (SELECT *, CASE WHEN raised THEN 'high_distress' ELSE c2 END AS c4 FROM v4c),
v5 AS (SELECT *, c4 <> want AND NOT (risk AND want <> 'crisis') AS align, concat_ws('|',
  CASE WHEN i <> i1 THEN 'intent_invalid:''' || i || '''' END,
  CASE WHEN c <> c1 THEN 'category_fixed_from_intent:''' || c || '''→''' || c1 || '''' END,
  CASE WHEN l <> l1 THEN 'language_defaulted:''' || l || '''→en' END,
  CASE WHEN promote AND c1 <> 'crisis' THEN 'category_crisis_promoted:''' || c1 || '''→crisis' END,
  CASE WHEN promote AND NOT own THEN 'intent_crisis_promoted:''' || i1 || '''→suicidal_thoughts' END,
  CASE WHEN promote AND u1 < 5 THEN 'urgency_crisis_promoted:' || u1 || '→5' END,
  CASE WHEN demote AND NOT promote THEN 'category_metaphor_demoted:crisis→life_stressor' END,
  CASE WHEN demote AND NOT promote AND u1 > 2 THEN 'urgency_metaphor_capped:' || u1 || '→2' END,
  CASE WHEN c2 = 'crisis' AND u2 < 4 THEN 'urgency_crisis_floor:' || u2 || '→4' END,
  CASE WHEN c2 = 'high_distress' AND u2 < 3 THEN 'urgency_distress_floor:' || u2 || '→3' END,
  CASE WHEN c2 = 'neutral' AND u2 > 1 THEN 'urgency_neutral_cap:' || u2 || '→1' END,
  CASE WHEN raised THEN 'category_high_urgency_escalated:''' || c2 || '''→high_distress' END,
  CASE WHEN c4 <> want AND NOT (risk AND want <> 'crisis') THEN 'category_intent_aligned:''' || c4 || '''→''' || want || '''' END) AS said FROM v4d)
"""


ODD = f"""SELECT doc_id, text, CASE WHEN doc_id % 13 = 0 THEN 'odd' ELSE intent END AS intent, CASE WHEN doc_id % 17 = 0 THEN 'odd' ELSE category END AS category, urgency,
  CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE language END AS language FROM ({RECORDS})"""
CURATED = rf"""r AS ({RECORDS}), {CLEANED},
e AS (SELECT *, {fingerprint("text")} AS fp FROM cleaned WHERE reason IS NULL),
m AS (SELECT *, doc_id > min(doc_id) OVER (PARTITION BY fp) AS copy FROM e),
k AS (SELECT * FROM m WHERE NOT copy), {validated("k")}"""


def assessed(source: str) -> str:
    """Common table expressions on `source` with a text; the last is named risk."""
    first = lambda listed: "CASE " + " ".join(f"WHEN {has('f', p)} THEN {q(p[:SHOWN])}" for p in listed) + " END"
    line = lambda n: "CASE line " + " ".join(f"WHEN {q(k)} THEN {q(v[n])}" for k, v in X.HELPLINES.items()) + " ELSE '' END"
    tiers = ", ".join(f"CASE WHEN NOT metaphor THEN {first(listed)} END AS p{level}" for level, listed in TIERS)
    return rf"""
s0 AS (SELECT *, {fold("text")} AS f FROM {source}),
s1 AS (SELECT *, {has("f", "|".join(f"(?:{p})" for p in P.RISK_METAPHORS))} AS metaphor FROM s0),
s2 AS (SELECT *, {tiers} FROM s1),
s3 AS (SELECT *, CASE WHEN p5 IS NOT NULL THEN 5 WHEN p4 IS NOT NULL THEN 4 WHEN p3 IS NOT NULL THEN 3 WHEN p2 IS NOT NULL THEN 2 ELSE 1 END::INT AS risk_level FROM s2),
s4 AS (SELECT *, CASE WHEN risk_level > 2 THEN 'tier_' || risk_level WHEN risk_level = 2 AND {has("f", P.RISK_MINOR)} THEN 'tier_2_minor' WHEN risk_level = 2 THEN 'tier_2_adult' END AS line FROM s3),
risk AS (SELECT *, risk_level > 1 AS is_crisis, CASE WHEN risk_level > 1 THEN 'tier_' || risk_level ELSE 'safe' END AS tier, coalesce(p5, p4, p3, p2, '') AS matched_pattern,
  {line(0)} AS helpline_name, {line(1)} AS helpline_number, risk_level = 2 AS safeguarding, risk_level IN (2, 4, 5) AS hard_exit FROM s4)
"""


def detected(source: str) -> str:
    """Common table expressions on `source` with a text; the last is named felt."""
    words = f"list_filter(regexp_split_to_array(t, '{WS}+'), lambda w: w <> '')"
    signals = ", ".join(f"{has('f', p)} AS x_{k}" for k, p in SIGNALS.items())
    rule = lambda n: "CASE " + " ".join("WHEN " + " AND ".join(f"x_{s}" for s in r[0]) + f" THEN {q(r[n])}" for r in INTENT_RULES) + (" ELSE 'vent_frustration' END" if n == 1 else " ELSE 'none' END")
    base = "CASE intent " + " ".join(f"WHEN {q(k)} THEN {array(v)}" for k, v in X.BASE_EMOTIONS.items()) + " END"
    added = ", ".join(f"CASE WHEN x_{e} THEN {q(e)} END" for e in ADDED) + ", CASE WHEN urgency_level >= 2 AND intent = 'express_academic_pressure' THEN 'inadequacy' END"
    tech = "CASE intent || '|' || emotions_all[1] " + " ".join(f"WHEN {q(f'{i}|{e}')} THEN {q(t)}" for (i, e), t in X.TECHNIQUES.items()) + f" ELSE {q(X.OTHER_TECHNIQUE)} END"
    idiom = ", ".join(f"CASE WHEN {has('g', p, k in P.CASED_IDIOMS)} THEN {q(k)} END" for k, p in P.IDIOMS.items())
    names = lambda listed: ", ".join(f"CASE WHEN contains(t, {q(n.lower())}) THEN {q(n)} END" for n in listed)
    tone = "CASE intent " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in X.TONES.items()) + f" ELSE {q(X.OTHER_TONE)} END"
    mixed = array(P.MIXED_WORDS)
    return rf"""
t0 AS (SELECT *, {strip("lower(text)")} AS t, {fold("text")} AS g FROM {source}),
t1 AS (SELECT *, {fold("t")} AS f, {words} AS ws FROM t0),
t2 AS (SELECT *, {signals}, ({has("f", P.GREETING_OPENER)} AND len(ws) <= 6) OR {has("f", P.GREETING_EXACT)} OR {has("f", P.GREETING_CHECK_IN)} AS x_greeting FROM t1),
t3 AS (SELECT *, {rule(1)} AS intent, {rule(2)} AS stressor_type, CASE WHEN NOT x_greeting AND x_hopeless THEN 2 ELSE 1 END::INT AS urgency_level FROM t2),
t4 AS (SELECT *, {base} AS base, [{added}] AS more FROM t3),
t5 AS (SELECT *, CASE WHEN intent IN ('greeting', 'share_positive_news') THEN base ELSE list_concat(base, list_filter(more, lambda x: x IS NOT NULL AND NOT list_contains(base, x)))[1:4] END AS emotions_all FROM t4),
felt AS (SELECT *, emotions_all[1] AS primary_emotion, coalesce(emotions_all[2], '') AS secondary_emotion, {tone} AS tone_mode, {tech} AS cbt_technique,
  round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({count("f", P.POSITIVE_WORDS)} - {count("f", P.NEGATIVE_WORDS)}) * 0.2::DOUBLE)), 2) AS sentiment_score,
  CASE WHEN regexp_matches(text, '[\x{{0900}}-\x{{097F}}]') THEN 'hi' WHEN regexp_matches(text, '[\x{{0980}}-\x{{09FF}}]') THEN 'bn' WHEN len(list_intersect(list_distinct(ws), {mixed})) >= 2 THEN 'hi-en-mix' ELSE 'en' END AS lang_code,
  {has("g", P.STIGMA)} AS stigma_flag, concat_ws('|', {idiom}) AS idioms, concat_ws('|', {names(P.PERSONS)}) AS persons, concat_ws('|', {names(P.ROLES)}) AS roles FROM t5)
"""


FELT = f"u AS ({TURNS}), {detected('u')}"
FELT_RISK = f"{FELT}, w AS (SELECT * EXCLUDE (t, g, f, ws) FROM felt), {assessed('w')}"
INDEX = "i AS (SELECT vec_id AS chunk_id, embedding, CASE WHEN label % 3 <> 0 THEN 's' || (label % 3) END AS st FROM embeddings), a AS (SELECT vec_id AS query_id, embedding AS e, CASE vec_id % 400 WHEN 0 THEN 's1' WHEN 100 THEN 'none' END AS wanted FROM embeddings WHERE vec_id % 100 = 0)"
SCORES = f"""{INDEX}, p AS (SELECT query_id, chunk_id, st, wanted, list_dot_product(e::DOUBLE[], embedding::DOUBLE[]) AS score FROM a, i),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS near FROM p)"""
FILTERED = f"{SCORES}, g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY near)::INT AS rank FROM n WHERE near <= 9 AND (wanted IS NULL OR wanted = 'none' OR st IS NULL OR st = wanted))"
COUNTS = f"""p AS ({PREDICTIONS}), l AS (SELECT unnest({array(X.INTENTS)}) AS label, unnest(range(26)) AS idx),
s AS (SELECT label, idx, (SELECT count(*) FROM p WHERE true_intent = label) AS support, (SELECT count(*) FROM p WHERE pred_intent = label) AS predicted, (SELECT count(*) FROM p WHERE true_intent = label AND pred_intent = label) AS tp FROM l),
m AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0 END AS pr, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS re FROM s),
f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f1 FROM m)"""
GAPS = f"t AS (SELECT unnest({array(list(X.TARGETS))}) AS label, unnest([{', '.join(map(str, X.TARGETS.values()))}]) AS target), c AS (SELECT intent, count(*) AS n FROM ({RECORDS}) GROUP BY 1), g AS (SELECT label, coalesce(n, 0) AS n, target, target - coalesce(n, 0) AS gap FROM t LEFT JOIN c ON intent = label)"
SEED_ROWS = f"{FELT}, z AS (SELECT conv_id, turn, text, g, urgency_level AS x, conv_id * 1000 + turn AS row_, intent FROM felt)"
REASON = f"""CASE WHEN length(text) < 10 THEN 'too_short' WHEN length(text) > 1500 THEN 'too_long' WHEN {has("g", P.SEED_TEMPLATED)} THEN 'templated_text' WHEN {has("g", P.SEED_UNSAFE)} THEN 'unsafe_crisis_content'
  WHEN {has("g", P.SEED_METAPHOR)} AND row_ % 5 + 1 >= 3 THEN 'metaphor_crisis_mismatch' WHEN row_ % 19 = 0 OR NOT list_contains({array(X.SEED_INTENTS)}, intent) THEN 'invalid_intent' ELSE '' END"""
EPOCHS = "e AS (SELECT user_id AS run, event_id AS epoch, round(1 - 1 / (1 + event_id % 12)::DOUBLE, 4) AS score, event_id * 0.1::DOUBLE AS a FROM events)"


NEAR = f"""w AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array({strip("lower(coalesce(text, ''))")}, '{WS}+'), lambda x: x <> '')) AS ws FROM documents),
x AS MATERIALIZED (SELECT doc_id, len(ws) AS n, unnest(ws) AS word FROM w),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.word = b.word AND a.doc_id < b.doc_id AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL HAVING count(*)::DOUBLE / greatest(any_value(a.n), any_value(b.n)) >= 0.85),
o AS MATERIALIZED (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
q AS MATERIALIZED (SELECT o.k, o.doc_id, coalesce(list(p.a ORDER BY p.a) FILTER (p.a IS NOT NULL), []) AS before FROM o LEFT JOIN p ON p.b = o.doc_id GROUP BY ALL)"""
MODE = f"CASE WHEN risk_level >= 4 THEN 'crisis' WHEN list_contains({array(X.SOCIAL_INTENTS)}, intent) THEN 'social' WHEN u >= 4 THEN 'high_distress' WHEN list_contains({array(X.TENDER_EMOTIONS)}, primary_emotion) THEN 'emotional' WHEN intent = 'greeting' THEN 'greeting' ELSE 'normal' END"


def letters(c: str) -> str:
    """A unit vector of how often each letter occurs."""
    return f"(list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda l: (length({c}) - length(replace(lower({c}), l, '')))::DOUBLE))"


def said() -> str:
    """Common table expressions of all turns of the persons; the last is named turns_, with all that a turn gives."""
    reply = "CASE WHEN safeguarding AND helpline_name = 'CHILDLINE' THEN {minor} WHEN safeguarding THEN {safeguarding} WHEN risk_level = 5 THEN {immediate} ELSE {direct} END".format(**{k: q(v) for k, v in EXIT_REPLIES.items()})
    chunks = ", ".join(f"({i + 1}, {q(t)}, {f'{q(s)}' if p == 1 else 'NULL'})" for i, (p, s, t, _, _) in enumerate(sorted(CHUNKS, key=lambda c: (c[0], c[1], c[4], c[2]))))
    cosine = "list_dot_product(v, e) / sqrt(list_dot_product(v, v) * list_dot_product(e, e))"
    return f"""{FELT_RISK}, x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS k, CASE WHEN risk_level = 3 THEN 3 ELSE urgency_level END::INT AS u,
      coalesce(nullif(regexp_split_to_array({strip("text")}, '{WS}+')[1], ''), 'nothing') AS word FROM risk WHERE role = 'user'),
    i_ AS MATERIALIZED (SELECT chunk_id, st, {letters("text")} AS e FROM (VALUES {chunks}) v(chunk_id, text, st)),
    a_ AS MATERIALIZED (SELECT conv_id, k, stressor_type AS wanted, {letters("lower(q)")} AS v FROM (SELECT conv_id, k, stressor_type, stressor_type || ' ' || primary_emotion || ' ' || substring(text, 1, 200) AS q FROM x WHERE NOT hard_exit)),
    n_ AS (SELECT conv_id, k, wanted, st, row_number() OVER (PARTITION BY conv_id, k ORDER BY {cosine} DESC, chunk_id) AS near FROM a_, i_),
    c_ AS (SELECT conv_id, k, least(3, count(*) FILTER (wanted = 'none' OR st IS NULL OR st = wanted))::INT AS rag_chunks FROM n_ WHERE near <= 9 GROUP BY ALL),
    y AS (SELECT x.*, {MODE} AS mode, first_value(word) OVER (PARTITION BY conv_id ORDER BY k ROWS 3 PRECEDING) AS oldest, least(6, 2 * (k - 1)) + 1 AS given FROM x),
    turns_ AS (SELECT y.*, CASE WHEN hard_exit THEN replace(replace({reply}, '{{name}}', helpline_name), '{{number}}', helpline_number) ELSE 'The mode is ' || mode || ' today, ' || word || ' after ' || oldest || ' in ' || given END AS response,
      CASE WHEN NOT hard_exit THEN primary_emotion WHEN safeguarding THEN 'fear' ELSE 'grief' END AS emotion, coalesce(rag_chunks, 0)::INT AS rag_chunks FROM y LEFT JOIN c_ USING (conv_id, k))"""


#: What the knowledge base documents are made from.
KNOWLEDGE = f"""k AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split(coalesce(text, ''), ' ') AS words, CASE WHEN doc_id % 3 <> 0 THEN coalesce(source, '') ELSE 's' || doc_id END AS label,
  {pick(X.RISK_STRESSORS, "doc_id")} AS risk, {pick(X.RISK_EMOTIONS, "doc_id")} AS emotion, {pick([*X.RISK_IDIOMS, "other"], "doc_id")} AS idiom FROM documents)"""
#: Chunks of the test document, written out.
CHUNKS = [(1,'academic_pressure','Academic pressure: Exams and ranks weigh on the person.','stressor_taxonomy','description'),
(1,'academic_pressure','Common emotions in academic_pressure: anxiety, fear','emotion_map','emotions'),
(1,'academic_pressure','Guardrails for academic_pressure: no_comparison','guardrails','guardrails'),
(1,'academic_pressure','Signal phrases (en) for academic_pressure: my exam; my rank','signal_phrases','signal_phrases'),
(1,'academic_pressure','Signal phrases (hi-en-mix) for academic_pressure: padhai ka load','signal_phrases','signal_phrases'),
(1,'financial_stress','financial_stress: Money is short.','stressor_taxonomy','description'),
(1,'financial_stress','Guardrails for financial_stress: no_advice; no_comparison','guardrails','guardrails'),
(1,'marriage_pressure','Marriage pressure: Family expects a match.','stressor_taxonomy','description'),
(1,'marriage_pressure','Common emotions in marriage_pressure: conflict','emotion_map','emotions'),
(1,'marriage_pressure','Signal phrases (en) for marriage_pressure: they found a match','signal_phrases','signal_phrases'),
(2,'gentle_reframe','Tone gentle_reframe: Softly offers another view.. When: identity, marriage. Prefer: perhaps. Avoid: must; never.','tone_modes','tone_mode'),
(3,'no_advice',"Guardrail 'no_advice': Give no financial advice.",'guardrail_registry','guardrail'),
(3,'no_comparison',"Guardrail 'no_comparison': Do not compare with others.",'guardrail_registry','guardrail'),
(4,'izzat',"South Asian idiom 'izzat' (honour): Standing of the family. Linked to: marriage_pressure.",'cultural_idioms','idiom')]

#: Conversations with their signals, at twice their turns.
TALK = f"u AS (SELECT conv_id, turn, role, text FROM conversations), {detected('u')}, v AS (SELECT conv_id, turn * 2 AS turn, role, text, primary_emotion, stressor_type FROM felt)"


def state_of(together: str) -> str:
    """A table x: the state behind each row of v, where rows of a conversation are one session if they agree on `together`."""
    return f"""x AS (SELECT *, row_number() OVER w AS turn_count, list(primary_emotion) OVER (PARTITION BY conv_id, ({together}) ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l,
      last_value(stressor_type IGNORE NULLS) OVER (PARTITION BY conv_id, ({together}) ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_stressor FROM v WINDOW w AS (PARTITION BY conv_id, ({together}) ORDER BY turn))"""


#: Greedy choice in order, as a fold: rows that a kept earlier one is near to go.
GREEDY = """v AS MATERIALIZED (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
p AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) AS s FROM v x JOIN v y ON x.vec_id < y.vec_id WHERE list_dot_product(x.e, y.e) >= 0.35),
o AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
q AS MATERIALIZED (SELECT o.k, o.vec_id, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS before FROM o LEFT JOIN p ON p.b = o.vec_id GROUP BY ALL),
f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS kept, NULL::BIGINT AS id, false AS gone
  UNION ALL SELECT q.k, CASE WHEN list_has_any(f.kept, q.before) THEN f.kept ELSE list_append(f.kept, q.vec_id) END, q.vec_id, list_has_any(f.kept, q.before) FROM f JOIN q ON q.k = f.k + 1)"""


def oracle_sql() -> dict[str, str]:
    reply = "CASE WHEN safeguarding AND helpline_name = 'CHILDLINE' THEN {minor} WHEN safeguarding THEN {safeguarding} WHEN risk_level = 5 THEN {immediate} ELSE {direct} END".format(**{k: q(v) for k, v in EXIT_REPLIES.items()})
    score_line = f"CASE WHEN doc_id % 3 = 0 THEN (CASE WHEN {has('f', P.SCORE_MINOR)} THEN 'CHILDLINE' ELSE 'iCall' END) ELSE 'iCall' END"
    every = {
        "curated_by_language": f"WITH {CURATED} SELECT language, CASE WHEN copy THEN 'exact_duplicate' ELSE 'kept' END AS outcome, count(*) AS n FROM m GROUP BY ALL",
        "clean_documents": f"WITH r AS ({RECORDS}), {CLEANED} SELECT doc_id, text, language, coalesce(reason, '') AS drop_reason, language <> given AS language_corrected FROM cleaned",
        "clean_drop_reasons": f"WITH r AS ({RECORDS}), {CLEANED} SELECT coalesce(reason, '') AS drop_reason, count(*) AS n FROM cleaned GROUP BY 1",
        "clean_language_fix": f"WITH r AS ({RECORDS}), {CLEANED} SELECT language, language <> given AS corrected, count(*) AS n FROM cleaned WHERE reason IS NULL GROUP BY ALL",
        "clean_pages_entities": f"SELECT page_id, md5({scrub("coalesce(html, '')")}) AS scrubbed_md5 FROM pages",
        "fingerprint_documents": f"SELECT doc_id, {fingerprint('text')} AS fp FROM documents",
        "dedup_seed_fingerprint": f"SELECT doc_id, {seed_fingerprint('text')} AS fp FROM documents",
        "dedup_fingerprint_set": f"SELECT DISTINCT {fingerprint('text')} AS fp FROM documents",
        "dedup_sha256": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
        "dedup_exact": f"SELECT doc_id FROM documents QUALIFY doc_id = min(doc_id) OVER (PARTITION BY {fingerprint('text')})",
        "dedup_removed": f"SELECT doc_id, 'exact_duplicate' AS reason FROM documents QUALIFY doc_id > min(doc_id) OVER (PARTITION BY {fingerprint('text')})",
        "dedup_cross_batch": f"WITH d AS (SELECT doc_id, {fingerprint('text')} AS fp FROM documents), o AS (SELECT fp FROM d WHERE doc_id % 3 = 0 UNION SELECT {fingerprint('text')} FROM benchmark) SELECT doc_id, fp NOT IN (SELECT fp FROM o) AS kept FROM d WHERE doc_id % 3 <> 0",
        "dedup_counters": f"SELECT count(*) AS total, count(*) - count(DISTINCT {fingerprint('text')}) AS exact_removed FROM documents",
        "semantic_pairs": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, min(vec_id) OVER (PARTITION BY embedding) AS first FROM embeddings),
          p AS (SELECT x.vec_id AS a, y.vec_id AS b, list_dot_product(x.e, y.e) AS s FROM v x JOIN v y ON x.vec_id < y.vec_id AND x.first = x.vec_id AND y.first IN (x.vec_id, y.vec_id)) SELECT a, b, round(s, 6) AS sim FROM p WHERE s >= 0.35""",
        "semantic_dedup": f"WITH RECURSIVE {GREEDY}, best AS (SELECT p.b, round(max(p.s), 4) AS sim FROM p JOIN f ON f.id = p.a AND NOT f.gone GROUP BY 1) SELECT f.id AS vec_id, CASE WHEN gone THEN 'semantic_duplicate' END AS reason, CASE WHEN gone THEN sim END AS sim FROM f LEFT JOIN best ON best.b = f.id WHERE f.id IS NOT NULL",
        "near_dup_overlap": f"""WITH RECURSIVE {NEAR}, f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS held, NULL::BIGINT AS id, NULL::BIGINT AS near_of
            UNION ALL SELECT q.k, CASE WHEN list_has_any(f.held, q.before) THEN f.held ELSE list_append(f.held, q.doc_id)[-200:] END, q.doc_id, list_min(list_intersect(f.held, q.before)) FROM f JOIN q ON q.k = f.k + 1)
          SELECT id AS "order", near_of FROM f WHERE id IS NOT NULL""",
        "validate_records": f"WITH o AS ({ODD}), {validated('o')} SELECT doc_id, i2 AS intent, CASE WHEN align THEN want ELSE c4 END AS category, u3 AS urgency, l1 AS language FROM v5",
        "validate_corrections": f"WITH o AS ({ODD}), {validated('o')} SELECT doc_id, said AS corrections FROM v5",
        "validate_missing_fields": "SELECT doc_id, 'filled_default:category' || CASE WHEN doc_id % 3 = 0 THEN '|filled_default:urgency' ELSE '' END AS filled, 'missing_fields:category' || CASE WHEN doc_id % 3 = 0 THEN ',urgency' ELSE '' END AS reason FROM documents",
        "parse_seed_records": f"SELECT doc_id, md5(text) AS text, CASE WHEN doc_id % 2 = 0 THEN 'seek_validation' ELSE 'unclear' END AS intent, CASE WHEN doc_id % 3 = 0 THEN 'guilt,anger,fear,hope' ELSE 'neutral' END AS emotions, greatest(1, least(5, doc_id % 9))::INT AS urgency_level, 'en' AS language, 'latin_roman' AS script FROM ({RECORDS}) WHERE doc_id % 4 < 2",
        "session_profile_choice": "SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN 'call ' || turn WHEN conv_id % 2 = 0 THEN 'session ' || conv_id ELSE 'default' END AS profile FROM conversations",
        "io_jsonl": f"SELECT doc_id, md5(text) AS text_md5, intent, urgency, true AS numbered, (SELECT count(*) FROM documents WHERE doc_id % 50 = 0) AS malformed FROM ({RECORDS})",
        "io_seed_csv": f"WITH {SEED_ROWS} SELECT row_::VARCHAR AS id, md5(text) AS text_md5, intent, (row_ % 5 + 1)::VARCHAR AS urgency_level, '' AS split FROM z",
        "io_index": "SELECT vec_id AS chunk_id, 'chunk ' || vec_id AS text, len(embedding)::INT AS width, 0::INT AS missing FROM embeddings",
        "io_document": "SELECT doc_id, '2' AS before, CASE WHEN doc_id % 3 <> 0 THEN '3' END AS now, CASE WHEN doc_id % 3 <> 0 THEN true END AS same FROM documents",
        "io_json_fields": f"""WITH r AS ({RECORDS}), o AS (SELECT doc_id, doc_id % 5 = 0 AS li, doc_id % 5 = 1 AS ni, doc_id % 7 = 0 AS lc, doc_id % 11 AS u, CASE WHEN doc_id % 5 = 0 THEN 'casual_chat' WHEN doc_id % 5 = 1 THEN 'None' ELSE intent END AS intent,
            CASE doc_id % 7 WHEN 0 THEN 'neutral' WHEN 1 THEN '7' ELSE category END AS category, CASE doc_id % 11 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE urgency END::INT AS urgency, 'en' AS language, md5(text) AS text FROM r WHERE doc_id % 13 > 1), {validated('o')}
          SELECT doc_id, li AS lacks_intent, ni AS null_intent, CASE u WHEN 0 THEN '-' WHEN 1 THEN 'ARRAY<BIGINT>' WHEN 2 THEN 'STRING' WHEN 3 THEN 'VOID' ELSE 'BIGINT' END AS kind, i2 AS intent, CASE WHEN align THEN want ELSE c4 END AS category, u3 AS urgency,
            array_to_string((list_concat(CASE WHEN lc THEN ['filled_default:category'] ELSE [] END, CASE WHEN li THEN ['filled_default:intent'] ELSE [] END, CASE WHEN u = 0 THEN ['filled_default:urgency'] ELSE [] END, CASE WHEN u IN (1, 3) THEN ['urgency_coerced_to_int'] ELSE [] END, CASE WHEN said = '' THEN [] ELSE string_split(said, '|') END))[1:3], '|') AS corrections,
            CASE WHEN lc OR li OR u = 0 THEN 'missing_fields:' || concat_ws(',', CASE WHEN lc THEN 'category' END, CASE WHEN li THEN 'intent' END, CASE WHEN u = 0 THEN 'urgency' END) ELSE '' END AS reason,
            (SELECT count(*) FROM documents WHERE doc_id % 13 < 2) AS malformed FROM v5 JOIN (SELECT doc_id, li, ni, lc, u FROM o) USING (doc_id)""",
        "curate_two_batches": f"""WITH r AS (SELECT * FROM ({RECORDS}) WHERE doc_id % 4 > 0), {CLEANED}, e AS (SELECT DISTINCT {fingerprint("text")} AS fp FROM cleaned WHERE reason IS NULL) SELECT fp, 1::BIGINT AS n FROM e""",
        "distribution_all": f"""WITH r AS ({RECORDS}), c AS (SELECT 'category' AS "column", category AS value FROM r UNION ALL SELECT 'intent', intent FROM r UNION ALL SELECT 'language', language FROM r)
          SELECT *, round(100 * n / sum(n) OVER (PARTITION BY "column"), 1) AS percent FROM (SELECT "column", value, count(*) AS n FROM c GROUP BY ALL)""",
        "io_turn_log": f"""WITH {said()} SELECT conv_id::VARCHAR AS session_id, count(*) AS turns, count(*) FILTER (hard_exit) AS crisis_exits, round(avg(rag_chunks), 1) AS avg_chunks,
          md5(string_agg(concat_ws('|', '2024-01-01T00:00:' || lpad(k::VARCHAR, 2, '0'), text, response, emotion, rag_chunks), chr(10) ORDER BY k)) AS log_md5 FROM turns_ GROUP BY 1""",
        "validate_split_counts": f"WITH o AS ({ODD}), {validated('o')} SELECT CASE WHEN text = '' THEN 'dropped' WHEN said <> '' THEN 'corrected' ELSE 'clean' END AS outcome, count(*) AS n FROM v5 GROUP BY 1",
        "pipeline_stats": f"""WITH {CURATED} SELECT (SELECT count(*) FROM cleaned) AS raw_loaded, (SELECT count(*) FROM e) AS after_clean, (SELECT count(*) FROM cleaned WHERE reason IS NOT NULL) AS clean_dropped,
          (SELECT count(*) FROM k) AS after_dedup, (SELECT count(*) FROM m WHERE copy) AS dedup_exact, 0::BIGINT AS dedup_semantic, count(*) FILTER (text <> '') AS after_validate,
          count(*) FILTER (text <> '' AND said <> '') AS validate_corrected, count(*) FILTER (text = '') AS validate_dropped, count(*) FILTER (text <> '') AS final_written FROM v5""",
        "pipeline_final": f"WITH {CURATED} SELECT doc_id, i2 AS intent, CASE WHEN align THEN want ELSE c4 END AS category, u3 AS urgency, l1 AS language FROM v5 WHERE text <> ''",
        "distribution_category": f"SELECT category AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM ({RECORDS}) GROUP BY 1",
        "distribution_intent_top10": f"SELECT intent AS value, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 1) AS percent FROM ({RECORDS}) GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
        "gap_report": f"WITH {GAPS} SELECT label, n, target, gap FROM g WHERE gap > 0",
        "seed_gap_report": f"WITH {FELT}, t1_ AS (SELECT unnest({array(X.SEED_INTENTS)}) AS label, unnest([{', '.join(map(str, X.SEED_TARGETS.values()))}]) AS target), c_ AS (SELECT intent, count(*) AS n FROM felt GROUP BY 1), g_ AS (SELECT label, coalesce(n, 0) AS n, target, target - coalesce(n, 0) AS gap FROM t1_ LEFT JOIN c_ ON intent = label), h AS (SELECT *, CASE WHEN label = 'crisis_signal' THEN least(gap, 50) ELSE gap END AS this_run FROM g_ WHERE gap > 0) SELECT *, least(this_run, 20) AS this_call FROM h",
        "generation_calls": f"WITH {GAPS}, x AS (SELECT label, gap, unnest(range((gap + 9) // 10))::INT AS call FROM g WHERE gap > 0) SELECT label, gap, call, least(10, gap - call * 10) AS ask FROM x",
        "generation_prompts": f"""WITH {GAPS}, x AS (SELECT label, gap, unnest(range((gap + 9) // 10))::INT AS call FROM g WHERE gap > 0),
          d AS (SELECT * FROM (VALUES {', '.join(f"({q(a)}, {q(b)}, {c}, {d}, {q(e)})" for a, b, c, d, e, _ in X.INTENT_TABLE)}) t(label, category, low, high, language)),
          y AS (SELECT label, call, least(10, gap - call * 10) || '|' || label || '|' || category || '|' || low || '|' || high || '|' || language || '|' || CASE WHEN category = 'crisis' THEN 'no methods' ELSE '' END AS prompt FROM x JOIN d USING (label)) SELECT *, substr(md5(prompt), 1, 8) AS prompt_hash FROM y""",
        "quality_check_reasons": f"WITH {SEED_ROWS} SELECT conv_id, turn, {REASON} AS reason FROM z",
        "quality_check_all": f"""WITH RECURSIVE {SEED_ROWS}, j AS MATERIALIZED (SELECT row_, text, {REASON.replace("row_ % 19 = 0 OR ", "")} AS own FROM z),
          y AS MATERIALIZED (SELECT row_number() OVER (ORDER BY row_) AS k, {seed_fingerprint("text")} AS fp, list_distinct(list_filter(regexp_split_to_array({strip("lower(text)")}, '{WS}+'), lambda x: x <> '')) AS ws FROM j WHERE own = ''),
          x AS MATERIALIZED (SELECT k, len(ws) AS n, unnest(ws) AS word FROM y),
          p AS MATERIALIZED (SELECT a.k AS a, b.k AS b FROM x a JOIN x b ON a.word = b.word AND a.k < b.k AND least(a.n, b.n) >= 0.85 * greatest(a.n, b.n) GROUP BY ALL HAVING count(*)::DOUBLE / greatest(any_value(a.n), any_value(b.n)) >= 0.85),
          q AS MATERIALIZED (SELECT y.k, y.fp, coalesce(list(p.a) FILTER (p.a IS NOT NULL), []) AS before FROM y LEFT JOIN p ON p.b = y.k GROUP BY ALL),
          f AS (SELECT 0::BIGINT AS k, []::BIGINT[] AS held, []::VARCHAR[] AS seen, NULL::VARCHAR AS r
            UNION ALL SELECT q.k, CASE WHEN list_contains(f.seen, q.fp) OR list_has_any(f.held, q.before) THEN f.held ELSE list_append(f.held, q.k)[-200:] END,
              CASE WHEN list_contains(f.seen, q.fp) OR list_has_any(f.held, q.before) THEN f.seen ELSE list_append(f.seen, q.fp) END,
              CASE WHEN list_contains(f.seen, q.fp) THEN 'exact_duplicate' WHEN list_has_any(f.held, q.before) THEN 'near_duplicate' END FROM f JOIN q ON q.k = f.k + 1)
          SELECT r AS rejection_reason, count(*) AS n FROM (SELECT r FROM f UNION ALL SELECT own FROM j WHERE own <> '') WHERE r IS NOT NULL GROUP BY 1""",
        "assign_ids": "SELECT doc_id, 'seed_train_' || CASE WHEN k < 10000 THEN lpad(k::VARCHAR, 4, '0') ELSE k::VARCHAR END AS id FROM (SELECT doc_id, 41 + row_number() OVER (ORDER BY doc_id) AS k FROM documents)",
        "safety_risk": f"WITH r AS ({RECORDS}), {assessed('r')} SELECT doc_id, is_crisis, risk_level, tier, helpline_name, helpline_number, safeguarding, hard_exit FROM risk",
        "safety_matched_pattern": f"WITH r AS ({RECORDS}), {assessed('r')} SELECT doc_id, matched_pattern FROM risk",
        "safety_tier_counts": f"WITH u AS ({TURNS}), {assessed('u')} SELECT tier, count(*) AS n FROM risk GROUP BY 1",
        "safety_combined": f"WITH r AS ({RECORDS}), {assessed('r')}, x AS (SELECT *, (doc_id % 5 + 1)::INT AS scored FROM risk) SELECT doc_id, greatest(risk_level, scored)::INT AS effective_risk, CASE WHEN scored >= 3 THEN 'llm' WHEN risk_level > 1 THEN 'regex' ELSE 'none' END AS risk_source, CASE WHEN greatest(risk_level, scored) = 3 THEN 'crisis_calm_conversation' WHEN urgency = 2 THEN 'gentle_checkin' ELSE 'none' END AS risk_action, {score_line} AS score_helpline FROM x",
        "safety_exit_reply": f"WITH r AS ({RECORDS}), {assessed('r')} SELECT doc_id, CASE risk_level WHEN 5 THEN 'crisis_overlay' WHEN 4 THEN 'urgent_prompt' ELSE 'safeguarding' END AS action, replace(replace({reply}, '{{name}}', helpline_name), '{{number}}', helpline_number) AS reply FROM risk WHERE hard_exit",
        "emotion_intent": f"WITH {FELT} SELECT conv_id, turn, intent, stressor_type, urgency_level, tone_mode, cbt_technique, array_to_string(emotions_all, '|') AS emotions, primary_emotion, secondary_emotion FROM felt",
        "emotion_documents": f"WITH u AS (SELECT doc_id, text FROM ({RECORDS})), {detected('u')} SELECT intent, primary_emotion, count(*) AS n FROM felt GROUP BY ALL",
        "emotion_sentiment": f"WITH {FELT} SELECT conv_id, turn, sentiment_score FROM felt",
        "emotion_lang": f"WITH {FELT} SELECT conv_id, turn, lang_code, stigma_flag FROM felt",
        "emotion_entities": f"WITH {FELT} SELECT conv_id, turn, persons, roles FROM felt",
        "emotion_idioms": f"WITH {FELT} SELECT conv_id, turn, idioms FROM felt",
        "cbt_lookup": f"WITH {FELT} SELECT intent, primary_emotion, cbt_technique, count(*) AS n FROM felt GROUP BY ALL",
        "retrieve_topk": f"WITH {SCORES} SELECT query_id, near AS rank, chunk_id, round(score, 6) AS score FROM n WHERE near <= 5",
        "retrieve_topk_filtered": f"WITH {FILTERED} SELECT query_id, rank, chunk_id, coalesce(st, '') AS stressor_type FROM g WHERE rank <= 3",
        "retrieve_context": f"WITH {FILTERED} SELECT query_id, string_agg(rank || '. [src' || (chunk_id % 4) || '] chunk ' || chunk_id, chr(10) ORDER BY rank) AS context FROM g WHERE rank <= 3 GROUP BY 1",
        "retrieve_query_text": f"WITH {FELT} SELECT conv_id, turn, md5(stressor_type || ' ' || primary_emotion || ' ' || substring(text, 1, 200)) AS query_md5 FROM felt",
        "vectors_normalised": "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE 1.0 END::DOUBLE AS square FROM embeddings",
        "turn_flow": f"""WITH {said()} SELECT conv_id, k, response, emotion, CASE WHEN hard_exit THEN 'crisis_signal' ELSE intent END AS intent, CASE WHEN hard_exit THEN 'none' ELSE stressor_type END AS stressor,
          CASE WHEN hard_exit THEN risk_level ELSE u END AS urgency, risk_level AS risk, CASE WHEN hard_exit THEN CASE risk_level WHEN 5 THEN 'crisis_overlay' WHEN 4 THEN 'urgent_prompt' ELSE 'safeguarding' END WHEN risk_level = 3 THEN 'crisis_calm_conversation' WHEN u = 2 THEN 'gentle_checkin' ELSE 'none' END AS risk_action,
          CASE WHEN risk_level > 1 THEN 'regex' ELSE 'none' END AS risk_source, hard_exit AS crisis_exit, CASE WHEN hard_exit THEN '' ELSE 'listen|ask' END AS strategies, CASE WHEN hard_exit THEN '' ELSE 'exact' END AS parse_strategy, rag_chunks FROM turns_""",
        "turn_state": f"""WITH {said()}, z AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) AS back FROM turns_)
          SELECT conv_id, count(*) AS turn_count, (2 * least(3, count(*)))::INT AS n_history, md5(string_agg('user:' || text || chr(10) || 'assistant:' || response, chr(10) ORDER BY k) FILTER (back <= 3)) AS history_md5,
            coalesce(array_to_string((list(primary_emotion ORDER BY k) FILTER (NOT hard_exit))[-4:], '|'), '') AS arc, count(*) FILTER (NOT hard_exit) AS arc_length, coalesce(last(stressor_type ORDER BY k) FILTER (NOT hard_exit), '') AS last_stressor FROM z GROUP BY 1""",
        "prompt_texts": f"""WITH {FELT_RISK}, h AS (SELECT *, urgency_level AS u, list(primary_emotion) OVER w AS felt_, list((CASE WHEN role = 'user' THEN '  User: ' ELSE '  Assistant: ' END) || substring(text, 1, 120)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS talk FROM risk WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
          m AS (SELECT *, {MODE} AS mode FROM h)
          SELECT conv_id, turn, CASE WHEN risk_level >= 4 THEN 150 ELSE 120 END AS word_cap, md5('Preamble.' || chr(10) || '### Language' || chr(10) || lang_code || chr(10) || '### Signals' || chr(10)
            || '- emotion: ' || primary_emotion || chr(10) || '- intent: ' || intent || chr(10) || '- stressor: ' || stressor_type || chr(10) || '- urgency: ' || urgency_level || chr(10) || '- risk: ' || risk_level || chr(10)
            || CASE WHEN risk_level >= 4 THEN chr(10) || '### Crisis, risk ' || risk_level || ' of 5' || chr(10) || 'Name the pain, say that it is real, ask whether the person is safe, mention ' || helpline_name || ' (' || helpline_number || '), stay in the conversation.' || chr(10) ELSE '' END
            || CASE WHEN stressor_type = 'academic_pressure' THEN chr(10) || '### Culture' || chr(10) || '- Ranks are public.' || chr(10) ELSE '' END
            || CASE stressor_type WHEN 'academic_pressure' THEN chr(10) || '### Guardrails' || chr(10) || '- Never say: "just study harder"' || chr(10) || '- Do not compare with others.' || chr(10)
                 WHEN 'financial_stress' THEN chr(10) || '### Guardrails' || chr(10) || '- Give no financial advice.' || chr(10) || '- Do not compare with others.' || chr(10) ELSE '' END
            || chr(10) || '### Technique' || chr(10) || cbt_technique || chr(10)
            || CASE WHEN list_contains(string_split(idioms, '|'), 'izzat') THEN chr(10) || '### Idioms' || chr(10) || '- ''izzat'' (honour) — Standing of the family.' || chr(10) ELSE '' END
            || CASE WHEN len(felt_) >= 3 THEN chr(10) || '### Pattern' || chr(10) || 'Recent arc: ' || array_to_string(felt_[-4:], ' → ') || chr(10) ELSE '' END
            || chr(10) || '### Context' || chr(10) || '  1. ' || substring(text, 1, 200) || chr(10)
            || CASE WHEN len(talk) > 0 THEN chr(10) || '### Recent turns' || chr(10) || array_to_string(talk, chr(10)) || chr(10) ELSE '' END
            || CASE WHEN conv_id % 2 = 0 THEN chr(10) || '### Profile' || chr(10) || '  session ' || conv_id || chr(10) ELSE '' END
            || chr(10) || '### Mode' || chr(10) || CASE mode WHEN 'normal' THEN 'Answer plainly.' ELSE mode END || chr(10) || '### Length' || chr(10) || 'At most ' || CASE WHEN risk_level >= 4 THEN 150 ELSE 120 END || ' words' || chr(10)
            || CASE WHEN risk_level = 3 THEN chr(10) || '### Support' || chr(10) || 'If the moment allows, mention ' || helpline_name || ' ' || helpline_number || ' as someone who listens; the conversation goes on.' || chr(10) ELSE '' END
            || chr(10) || '### Output' || chr(10) || '---RESPONSE---' || chr(10) || '---METADATA---' || chr(10)) AS prompt_md5 FROM m""",
        "risk_prompt": f"""WITH {KNOWLEDGE} SELECT '  tier_3:' || chr(10) || array_to_string(list_transform(words[1:12], lambda w: '    - ' || w), chr(10)) || CASE WHEN doc_id % 2 = 0 THEN chr(10) || '  tier_4:' || chr(10) || '    - ' || source ELSE '' END
          || '#  - ' || risk || ': r' || doc_id || '#' || CASE WHEN doc_id % 2 = 0 THEN '  - s' || doc_id || ': ' || label ELSE '  (none listed)' END || '#' || CASE WHEN idiom <> 'other' THEN '  ' || chr(39) || idiom || chr(39) || ' (' || lang || ')' ELSE '  (none)' END AS risk_prompt FROM k""",
        "kb_chunks": f"""WITH {KNOWLEDGE}, c AS (
          SELECT 1 AS part, 's' || doc_id AS id, label || ': ' || substring(text, 1, 60) AS text, 'stressor_taxonomy' AS source, 'description' AS chunk_type FROM k
          UNION ALL SELECT 1, risk, 'r' || doc_id || ': ', 'stressor_taxonomy', 'description' FROM k
          UNION ALL SELECT 1, 's' || doc_id, 'Signal phrases (' || lang || ') for s' || doc_id || ': ' || array_to_string(words[1:12], '; '), 'signal_phrases', 'signal_phrases' FROM k
          UNION ALL SELECT 1, 's' || doc_id, 'Common emotions in s' || doc_id || ': ' || emotion || ', calm', 'emotion_map', 'emotions' FROM k WHERE doc_id % 2 = 0
          UNION ALL SELECT 1, 's' || doc_id, 'Guardrails for s' || doc_id || ': g' || doc_id || '; g0', 'guardrails', 'guardrails' FROM k WHERE doc_id % 5 = 0
          UNION ALL SELECT 2, 't' || doc_id, 'Tone t' || doc_id || ': ' || source || '. When: ' || lang || '. Prefer: ' || array_to_string(words[1:2], '; ') || '. Avoid: .', 'tone_modes', 'tone_mode' FROM k
          UNION ALL SELECT 3, 'g' || doc_id, 'Guardrail ' || chr(39) || 'g' || doc_id || chr(39) || ': ' || substring(text, 1, 30), 'guardrail_registry', 'guardrail' FROM k
          UNION ALL SELECT 4, idiom, 'South Asian idiom ' || chr(39) || idiom || chr(39) || ' (' || lang || '): ' || source || ' Linked to: s' || doc_id || '.', 'cultural_idioms', 'idiom' FROM k)
          SELECT part::INT AS part, id, text, source, CASE WHEN part = 1 THEN id END AS stressor_type, chunk_type, CASE WHEN part = 3 THEN id END AS guardrail_id FROM c""",
        "kb_enriched": f"""WITH {KNOWLEDGE} SELECT doc_id::VARCHAR AS doc, array_to_string(list_sort(['s' || doc_id, risk]), ',') AS ids, CASE WHEN doc_id % 4 = 0 THEN 'new ' || doc_id ELSE '' END AS notes, 'a,locked in' AS tier_2, len(words[1:14])::INT AS tier_3,
          CASE WHEN idiom = 'ghar_ki_izzat' THEN true END AS amplifies, CASE WHEN idiom = 'ghar_ki_izzat' THEN 'identity_conflict' END AS escalates, CASE WHEN idiom = 'ghar_ki_izzat' THEN source END AS meaning, 'by age' AS safeguarding_context, '2' AS version FROM k""",
        "kb_risk_phrases": f"WITH {KNOWLEDGE} SELECT 'tier_3' AS tier, array_to_string(words[1:12], ',') AS phrases FROM k UNION ALL SELECT 'tier_4', CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END FROM k",
        "session_turns": "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS turn_count FROM conversations",
        "session_history_window": "WITH h AS (SELECT conv_id, turn, list(role || ':' || substring(coalesce(text, ''), 1, 120)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS h FROM conversations) SELECT conv_id, turn, coalesce(len(h), 0)::INT AS n_history, md5(coalesce(array_to_string(h, chr(10)), '')) AS history_md5 FROM h",
        "session_emotion_arc": f"""WITH {FELT_RISK}, x AS (SELECT conv_id, turn, coalesce(list(primary_emotion) FILTER (NOT hard_exit) OVER (PARTITION BY conv_id ORDER BY turn), []) AS l FROM risk)
          SELECT conv_id, turn, len(l) AS arc_length, CASE WHEN len(l) >= 3 THEN array_to_string(l[-4:], ' → ') ELSE '' END AS arc FROM x""",
        "session_last_stressor": f"WITH {FELT} SELECT conv_id, turn, coalesce(last_value(nullif(stressor_type, 'none') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS last_stressor FROM felt",
        "session_profile": f"WITH {FELT}, x AS (SELECT conv_id, primary_emotion AS e, min(turn) AS at_ FROM felt WHERE primary_emotion <> 'neutral' GROUP BY ALL) SELECT conv_id, array_to_string(list(e ORDER BY at_), '|') AS stressors FROM x GROUP BY 1",
        "session_summary": f"WITH {FELT_RISK} SELECT conv_id, count(*) AS turns, count(*) FILTER (hard_exit) AS crisis_exits, round(avg(turn % 4), 1) AS avg_chunks FROM risk GROUP BY 1",
        "session_intent_counts": f"WITH {FELT} SELECT intent, count(*) AS n FROM felt GROUP BY 1",
        "prompt_modes": f"WITH {FELT_RISK} SELECT CASE WHEN risk_level >= 4 THEN 'crisis' WHEN list_contains({array(X.SOCIAL_INTENTS)}, intent) THEN 'social' WHEN urgency_level >= 4 THEN 'high_distress' WHEN list_contains({array(X.TENDER_EMOTIONS)}, primary_emotion) THEN 'emotional' WHEN intent = 'greeting' THEN 'greeting' ELSE 'normal' END AS mode, CASE WHEN risk_level >= 4 THEN 150 ELSE 120 END AS word_cap, count(*) AS n FROM risk GROUP BY ALL",
        "parse_events_props": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
        "parse_records": f"SELECT doc_id, md5({strip("replace(text, ']', ')')")}) AS text_md5, CASE WHEN doc_id % 2 = 0 THEN intent ELSE 'casual_chat' END AS intent, 'neutral' AS category, greatest(1, least(5, doc_id % 9))::INT AS urgency, 'en' AS language FROM ({RECORDS}) WHERE doc_id % 3 < 2 AND length({strip('text')}) >= 5",
        "parse_metadata_kv": f"""WITH x AS (SELECT doc_id, doc_id % 3 < 2 AS meta, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE greatest(1, least(5, doc_id % 6)) END AS risk, 2 + doc_id % 200 AS words, CASE WHEN doc_id % 3 < 2 AND doc_id % 5 <> 0 AND doc_id % 6 >= 4 THEN 150 ELSE 120 END AS cap FROM documents)
          SELECT doc_id, CASE WHEN NOT meta THEN 'neutral' WHEN doc_id % 4 = 0 THEN 'hope' ELSE 'fear' END AS emotion, 'unknown' AS intent, CASE WHEN meta THEN greatest(1, least(5, doc_id % 8)) ELSE 1 END::INT AS urgency,
          CASE WHEN meta THEN risk ELSE 1 END::INT AS risk, CASE WHEN meta THEN 'a|b|c' ELSE '' END AS strategies, ['exact', 'partial', 'fallback'][(doc_id % 3 + 1)::INT] AS parse_strategy, CASE WHEN words > cap THEN 'hear this ' || trim(repeat('word ', (cap - 2)::BIGINT)) || '...' ELSE trim('hear this ' || repeat('word ', (words - 2)::BIGINT)) END AS response FROM x""",
        "parse_risk_scores": """WITH x AS (SELECT doc_id, (doc_id % 8)::INT AS l, doc_id % 10 = 0 AS none, CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 8 = 1 THEN 'safe' ELSE 'tier_' || doc_id % 8 END ELSE 'tier_2' END AS t FROM documents),
          y AS (SELECT *, NOT none AND l BETWEEN 1 AND 5 AS ok FROM x)
          SELECT doc_id, CASE WHEN ok THEN l ELSE 1 END AS risk_level, CASE WHEN ok THEN t ELSE 'safe' END AS tier, CASE WHEN none THEN 'no_json_in_response' WHEN NOT ok THEN 'invalid_risk_level' ELSE 'because' END AS reason,
          ok AND doc_id % 2 = 0 AS safeguarding, CASE WHEN NOT ok OR t = 'safe' THEN '' WHEN t = 'tier_2' THEN 'tier_2_minor' ELSE t END AS helpline_key FROM y""",
        "parse_emotion_lists": "SELECT doc_id, ['guilt,anger,fear,hope', 'neutral', 'shame'][(doc_id % 3 + 1)::INT] AS emotions, doc_id % 2 = 0 AS mixed FROM documents",
        "parse_token_stream": "WITH e AS (SELECT user_id, event_id, substr(event_type, 1, 1) AS p, event_id % 97 = 0 AND event_id % 13 <> 0 AS done FROM events), d AS (SELECT user_id, min(event_id) FILTER (done) AS stop FROM e GROUP BY 1) SELECT e.user_id, coalesce(string_agg(p, '' ORDER BY event_id) FILTER (event_id % 13 <> 0), '') AS text FROM e JOIN d ON e.user_id = d.user_id WHERE stop IS NULL OR event_id <= stop GROUP BY 1",
        "class_weights": f"WITH r AS (SELECT intent FROM ({RECORDS})), l AS (SELECT unnest({array(X.INTENTS)}) AS label), c AS (SELECT label, greatest(1, (SELECT count(*) FROM r WHERE intent = label)) AS n FROM l) SELECT label, n, round((SELECT count(*) FROM r) / (26.0 * n), 6)::DOUBLE AS weight FROM c",
        "label_index": f"SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 25 ELSE list_position({array(X.INTENTS)}, intent) - 1 END::INT AS intent_idx, (list_position({array(X.CATEGORIES)}, category) - 1)::INT AS category_idx FROM ({RECORDS})",
        "ordinal_encode": "SELECT doc_id, array_to_string(list_transform([1, 2, 3, 4], lambda k: (doc_id % 5 + 1 > k)::INT), ',') AS bits, (doc_id % 5 + 1)::INT AS level FROM documents",
        "best_labels": "WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS l FROM embeddings), m AS (SELECT *, list_max(l) AS top FROM v) SELECT vec_id, 'label_' || (list_position(l, top) - 1) AS label, round(1 / list_sum(list_transform(l, lambda x: exp(x - top))), 4) AS confidence FROM m",
        "accuracy": f"SELECT round(avg((true_intent = pred_intent)::INT), 4) AS accuracy FROM ({PREDICTIONS})",
        "macro_f1": f"WITH {COUNTS} SELECT round(avg(f1), 4) AS macro_f1 FROM f",
        "per_class_f1": f"WITH {COUNTS} SELECT idx::INT AS idx, label, round(pr, 3)::DOUBLE AS precision, round(re, 3)::DOUBLE AS recall, round(f1, 3)::DOUBLE AS f1, support FROM f",
        "confusion_matrix": "SELECT quality AS label, count(*) FILTER (toxic = 0) AS pred_0, count(*) FILTER (toxic = 1) AS pred_1 FROM labels GROUP BY 1",
        "urgency_mae": f"SELECT round(avg(abs(true_urgency - pred_urgency)), 4) AS mae, round(avg((abs(true_urgency - pred_urgency) <= 1)::INT), 4) AS within_one FROM ({PREDICTIONS})",
        "urgency_missed": f"SELECT round(avg((pred_urgency < 4)::INT), 4) AS false_negative_rate FROM ({PREDICTIONS}) WHERE true_urgency >= 4",
        "error_pairs": f'SELECT true_intent AS "true", pred_intent AS pred, count(*) AS n, arg_min(text, doc_id) AS example FROM ({PREDICTIONS}) WHERE true_intent <> pred_intent GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 10',
        "urgency_distribution": f"WITH p AS ({PREDICTIONS}) SELECT k::INT AS level, (SELECT count(*) FROM p WHERE true_urgency = k) AS n_true, (SELECT count(*) FROM p WHERE pred_urgency = k) AS n_pred FROM (SELECT unnest([1, 2, 3, 4, 5]) AS k)",
        "train_val_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) <= greatest(1, (count(*) OVER ()) // 10) THEN 'val' ELSE 'train' END AS split FROM documents",
        "stratified_split": "WITH x AS (SELECT doc_id, row_number() OVER (PARTITION BY quality ORDER BY md5('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels) SELECT doc_id, CASE WHEN k <= floor(n * 0.8::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.9::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM x",
        "evaluation_sample": "SELECT doc_id, quality FROM labels ORDER BY md5('42:' || doc_id), doc_id LIMIT 50",
        "early_stopping": f"""WITH {EPOCHS}, b AS (SELECT run, epoch, score, max(score) OVER o AS best, max(score) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e WINDOW o AS (PARTITION BY run ORDER BY epoch)),
          c AS (SELECT *, before IS NULL OR score > before AS improved FROM b), d AS (SELECT *, epoch - max(CASE WHEN improved THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS stale FROM c)
          SELECT run, epoch, best AS best_so_far, improved, stale, bool_or(stale >= 3) OVER (PARTITION BY run ORDER BY epoch) AS stopped FROM d""",
        "joint_loss": f"WITH {EPOCHS} SELECT epoch, round(score + a * 0.7::DOUBLE + 0.25, 6) AS loss, floor(epoch * 7 * 0.1::DOUBLE)::INT AS warmup FROM e",
        "events_tumbling": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "events_session": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, k",
        "stream_tumbling": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "stream_session_state": f"""WITH u AS (SELECT conv_id, turn, role, text FROM conversations), {detected('u')}, x AS (SELECT conv_id, turn, row_number() OVER w AS turn_count, list(primary_emotion) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS l,
            last_value(stressor_type IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_stressor FROM felt WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
          SELECT conv_id, turn, turn_count, CASE WHEN turn_count >= 3 THEN array_to_string(l, ' → ') END AS arc, last_stressor FROM x""",
        "stream_turns": f"""WITH {TALK}, {state_of("true")} SELECT conv_id, turn, turn_count, turn_count AS arc_length, CASE WHEN turn_count >= 3 THEN array_to_string(l, ' → ') END AS arc, last_stressor FROM x""",
        "session_reset": f"""WITH {TALK}, {state_of("conv_id % 3 <> 0 OR turn < 3")} SELECT conv_id, turn, turn_count, turn_count AS arc_length, CASE WHEN turn_count >= 3 THEN array_to_string(l, ' → ') END AS arc, last_stressor FROM x""",
        "session_get": f"""WITH {TALK}, {state_of("true")}, z AS (SELECT conv_id, md5(string_agg(role || ':' || text, chr(10) ORDER BY turn) FILTER (back <= 6)) AS history_md5, least(6, count(*))::INT AS n_history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM x) GROUP BY 1)
          SELECT conv_id, turn_count, n_history, history_md5, array_to_string(l, '|') AS arc, turn_count AS arc_length, last_stressor FROM x JOIN z USING (conv_id) QUALIFY turn = max(turn) OVER (PARTITION BY conv_id)""",
        "stream_curated": f"WITH r AS (SELECT doc_id, text, 'en' AS language, 'casual_chat' AS intent, 'neutral' AS category, 1 AS urgency FROM documents), {CLEANED} SELECT DISTINCT {fingerprint('text')} AS _fingerprint FROM cleaned WHERE reason IS NULL",
        "retention_30d": "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-11' GROUP BY 1",
        "user_last_event": "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1",
    }
    words = f"list_filter(regexp_split_to_array({strip("text")}, '{WS}+'), lambda w: w <> '')"
    every |= {
        "stream_tokens": every["parse_token_stream"], "sql_records": every["parse_records"],
        "sql_fingerprints": f"""WITH w AS (SELECT *, {words} AS ws, {words.replace("text", "lower(text)")} AS lw FROM documents)
          SELECT doc_id, {fingerprint("text")} AS fp, {seed_fingerprint("text")} AS seed_fp, len(ws)::INT AS n_words, round(len(list_intersect(list_distinct(lw), ['the', 'of', 'and', 'der', 'la']))::DOUBLE / greatest(len(list_distinct(lw)), 5), 6) AS overlap FROM w""",
    }
    return every
