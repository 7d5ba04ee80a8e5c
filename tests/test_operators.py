"""Fixture cases of single operators, and folds against plain Python loops."""

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.functions.text import composed, fingerprint, seed_fingerprint
from grainmill.operators import affect, cleaning, dedup, labels, metrics, parse, reports, retrieval, safety, sessions
from grainmill.plans import curation, fixtures
from grainmill.sources import files, models
from tests.conftest import DATA


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


CLEAN = [
    ("see https://example.com/x for details", "en", None, "see [link] for details", "en"),
    ("hello" + chr(0x200B) + "world again", "en", None, "helloworld again", "en"),
    ("too   many    spaces here", "en", None, "too many spaces here", "en"),
    ("Here is an example of a sample message", "en", "meta_language_detected", "Here is an example of a sample message", "en"),
    ("hi", "en", "too_short", "hi", "en"),
    ("WHY!!!!! is this happening????", "en", None, "WHY!! is this happening??", "en"),
    ("mujhe nahi pata kya karna hai", "en", None, "mujhe nahi pata kya karna hai", "hi-en-mix"),
    ("I think the exam is not my problem", "hi-en-mix", None, "I think the exam is not my problem", "en"),
    ("something a?!.b here", "en", None, "something a..b here", "en"),
    ("\n\t padded text here " + chr(0xA0), "en", None, "padded text here", "en"),
    ("&#x41; stays, &amp; goes", "en", None, "&#x41; stays, goes", "en"),
    ("1234567", "en", "too_short", "1234567", "en"),
    ("12345678", "en", None, "12345678", "en"),
    (None, None, "too_short", "", "en"),
]


def test_clean_cases(spark):
    df = rows(spark, [(i, t, lang) for i, (t, lang, *_) in enumerate(CLEAN)], "i int, text string, language string")
    got = {r["i"]: r for r in cleaning.clean(df).collect()}
    for i, (_, _, reason, text, lang) in enumerate(CLEAN):
        assert (got[i]["_drop_reason"], got[i]["text"], got[i]["language"]) == (reason, text, lang), i


def test_clean_limits(spark):
    df = rows(spark, [(0, "word " * 400, "en"), (1, "x" * 1200, "en"), (2, "😀" * 1201, "en")], "i int, text string, language string")
    got = {r["i"]: r["text"] for r in cleaning.clean(df).collect()}
    assert len(got[0]) <= 1200 and not got[0].endswith(" ") and len(got[1]) == 1200 and len(got[2]) == 1200


def test_composed(spark):
    df = rows(spark, [("é",), ("plain",), ("Å",), (None,), ("가",)], "t string")
    assert [r[0] for r in df.select(composed(F.col("t"))).collect()] == ["é", "plain", "Å", None, "가"]


def test_fingerprints(spark):
    df = rows(spark, [("Hello, World!", "hello world"), ("a - b", "a b"), ("मुझे", "मझ")], "a string, b string")
    got = df.select(fingerprint(F.col("a")) == fingerprint(F.col("b")), seed_fingerprint(F.col("a")) == seed_fingerprint(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (True, True)]


def test_exact_keeps_first(spark):
    df = dedup.with_fingerprint(rows(spark, [(3, "same"), (1, "Same!"), (2, "other")], "i int, text string"))
    kept, gone = dedup.exact(df, "i")
    assert sorted(r["i"] for r in kept.collect()) == [1, 2] and [r["i"] for r in gone.collect()] == [3]


def greedy(vectors, least):
    kept, out = [], {}
    for k, v in vectors:
        best = max((float(np.dot(v, w)) for _, w in kept), default=-2)
        if best >= least:
            out[k] = round(best, 4)
        else:
            kept.append((k, v))
    return out


@pytest.mark.parametrize("least", [0.3, 0.45])
def test_semantic_equals_greedy(spark, least):
    df = spark.read.parquet(f"{DATA}/embeddings.parquet")
    vectors = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in df.orderBy("vec_id").collect()]
    got = {r["vec_id"]: r["_sim_score"] for r in dedup.semantic(df, least).where("_dedup_reason IS NOT NULL").collect()}
    assert got == pytest.approx(greedy(vectors, least), abs=1.1e-4) and set(got) == set(greedy(vectors, least))


def test_semantic_chain(spark):
    a, b, c = [1.0, 0.0], [0.8, 0.6], [0.28, 0.96]
    df = rows(spark, [(1, a), (2, b), (3, c)], "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in dedup.semantic(df, 0.79).where("_dedup_reason IS NULL").orderBy("vec_id").collect()] == [1, 3]


def test_overlap_window(spark):
    texts = ["a b c d e f g h", "a b c d e f g x", "q r s", "a b c d e f g h i", "q r s t u v"]
    df = rows(spark, list(enumerate(texts)), "i long, text string")
    near = {r["order"]: r["near_of"] for r in dedup.overlap_window(df, "i").collect()}
    assert near == {0: None, 1: 0, 2: None, 3: 0, 4: None}


@pytest.mark.parametrize("part", [256, 2])
def test_minhash_pairs_of_distinct_sets(spark, part, monkeypatch):
    monkeypatch.setattr(dedup, "PART", part)
    words = [f"w{k}" for k in range(200)]
    texts = [" ".join([*words, f"end{i}"]) for i in range(5)]
    # 5 distinct near copies, two of them again in other order and case, one text apart, one empty.
    data = [*enumerate(texts), (10, " ".join(reversed(texts[1].split()))), (11, texts[1].upper()), (12, "quite other words"), (13, "")]
    got = {(r["a"], r["b"]): r["jaccard"] for r in dedup.minhash(rows(spark, data, "i long, text string"), "i").collect()}
    want = {(a, b): 200 / 202 for a in range(5) for b in range(a + 1, 5)} | {(1, 10): 1.0, (1, 11): 1.0}
    assert got == want


def test_overlap_query_is_one_fold(spark):
    from grainmill.plans.queries import ALL

    held, want, across = [], {}, 0
    for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect():
        words = set((r["text"] or "").lower().split())
        near = next((h for h in held[-200:] if words and h[1] and len(words & h[1]) / max(len(words), len(h[1])) >= 0.85), None)
        want[r["doc_id"]] = near and near[0]
        across += near is not None and near[2] != r["source"]
        if near is None:
            held.append((r["doc_id"], words, r["source"]))
    assert across
    assert {r["order"]: r["near_of"] for r in ALL["near_dup_overlap"](spark, DATA).collect()} == want


VALID = [
    (("I want to die", "anxiety_panic", "emotional", "3", "en"), ("suicidal_thoughts", "crisis", 5)),
    (("I will kill this exam", "academic_pressure", "crisis", "4", "en"), ("academic_pressure", "life_stressor", 2)),
    (("plain words", "suicidal_thoughts", "neutral", "3", "en"), ("suicidal_thoughts", "crisis", 1)),
    (("dying of laughter", "suicidal_thoughts", "crisis", "4", "en"), ("suicidal_thoughts", "crisis", 2)),
    (("plain words", "hopelessness", "high_distress", "1", "en"), ("hopelessness", "high_distress", 3)),
    (("plain words", "self_harm_intent", "crisis", "2", "en"), ("self_harm_intent", "crisis", 4)),
    (("plain words", "odd", "neutral", "3", "en"), ("casual_chat", "neutral", 1)),
    (("plain words", "academic_pressure", "life_stressor", "abc", "en"), ("academic_pressure", "life_stressor", 2)),
    (("plain words", "academic_pressure", "life_stressor", " 3 ", "xx"), ("academic_pressure", "life_stressor", 3)),
]


def test_validate_cases(spark):
    df = rows(spark, [(i, *given) for i, (given, _) in enumerate(VALID)], "i int, text string, intent string, category string, urgency string, language string")
    got = {r["i"]: (r["intent"], r["category"], r["urgency"]) for r in labels.validate(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(VALID)}


def test_validate_drops_and_defaults(spark):
    df = rows(spark, [("  ", "greeting", "neutral"), ("fine", "greeting", "neutral")], "text string, intent string, category string")
    done = {r["text"]: r for r in labels.validate(df).collect()}
    assert done[""]["_drop_reason"] == "empty_text" and done["fine"]["_corrections"] == ["filled_default:urgency"] and done["fine"]["urgency"] == 1
    assert labels.validate(df, strict=True).where("_drop_reason = 'missing_fields:urgency'").count() == 2
    clean, corrected, dropped = labels.split_validated(df.withColumn("urgency", F.lit(1)))
    assert (clean.count(), corrected.count(), dropped.count()) == (1, 0, 1)


def test_curate_counts(spark):
    out = curation.curate(fixtures.records(spark, DATA), "doc_id")
    s = out.stats.first()
    assert s["after_clean"] + s["clean_dropped"] == s["raw_loaded"] and s["after_validate"] == s["after_dedup"] - s["validate_dropped"]
    assert not [c for c in out.final.columns if c.startswith("_")] and out.final.count() == s["final_written"]


def test_run_appends_once(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    lines = [json.dumps({"text": "I feel worried about tomorrow", "intent": "anxiety_panic", "category": "emotional", "urgency": 2, "language": "en"}), "", "{broken"]
    (raw / "a.jsonl").write_text("\n".join(lines))
    first = curation.run(spark, str(raw), str(tmp_path / "out"))
    assert first.stats.first()["final_written"] == 1
    assert curation.run(spark, str(raw), str(tmp_path / "out")).stats.first()["final_written"] == 0
    assert spark.read.json(str(tmp_path / "out/final")).count() == 1


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "x")
    files.write_jsonl(rows(spark, [("ä", 1)], "text string, urgency int"), path)
    files.write_jsonl(rows(spark, [("b", None)], "text string, urgency int"), path, append=True)
    good, bad = files.read_jsonl(spark, path, "text string, urgency int", "*.json")
    assert sorted(r["text"] for r in good.collect()) == ["b", "ä"] and bad.count() == 0
    assert files.read_jsonl(spark, str(tmp_path / "none"))[0].count() == 0
    assert files.read_index(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        files.training_records(spark, str(tmp_path / "none"))


def test_seed_csv(spark, tmp_path):
    path = str(tmp_path / "csv")
    files.append_seed_csv(rows(spark, [("s_1", 'say "hi", you', 1)], "id string, text string, extra int"), path)
    got = files.read_seed_csv(spark, path).first()
    assert (got["id"], got["text"], got["split"]) == ("s_1", 'say "hi", you', None)


SAFE = [
    ("this is killing it at work", 1, "safe", ""), ("I already took pills", 5, "tier_5", "Vandrevala Foundation"), ("I want to die", 4, "tier_4", "iCall"),
    ("life is meaningless", 3, "tier_3", "iCall"), ("they will kill me", 2, "tier_2", "iCall"), ("he's hitting me, I am 15 years old", 2, "tier_2", "CHILDLINE"), (None, 1, "safe", ""),
]


def test_safety(spark):
    df = rows(spark, [(i, t) for i, (t, *_) in enumerate(SAFE)], "i int, text string")
    got = {r["i"]: (r["risk_level"], r["tier"], r["helpline_name"]) for r in safety.assess(df).collect()}
    assert got == {i: tuple(want) for i, (_, *want) in enumerate(SAFE)}


def test_affect(spark):
    df = rows(spark, [(0, "hello there"), (1, "What should I do about my exam"), (2, "JEE rank, thak gaya, darr lagta hai"), (3, None)], "i int, text string")
    got = {r["i"]: r for r in affect.detect(df).collect()}
    assert got[0]["intent"] == "greeting" and got[1]["intent"] == "ask_for_advice" and got[1]["stressor_type"] == "academic_pressure"
    assert got[2]["emotions_all"] == ["anxiety", "fear", "inadequacy"] and got[2]["urgency_level"] == 2 and got[2]["idioms_detected"] == ["JEE"]
    assert got[3]["intent"] == "vent_frustration" and got[3]["lang_code"] == "en"


def test_parse_records(spark):
    raws = ['[{"text": "long enough", "urgency": 99}]', '```json\n[{"text": "long enough"}]\n```', '[{"text": "hi"}]', "none", 'x [{"text": "inside"}] y']
    df = rows(spark, [(i, r, "greeting", "neutral") for i, r in enumerate(raws)], "i int, raw string, intent string, category string")
    got = {r["i"]: (r["text"], r["urgency"], r["intent"]) for r in parse.records(df).collect()}
    assert got == {0: ("long enough", 5, "greeting"), 1: ("long enough", 2, "greeting"), 4: ("inside", 2, "greeting")}


def test_reply(spark):
    raws = ["---RESPONSE---\nSure! Well then\n---METADATA---\nemotion=calm\nrisk=9\nstrategy=a, b", "---RESPONSE--- I am here\nurgency = 4", "just words", None, "word " * 130]
    got = parse.reply(rows(spark, [(i, r) for i, r in enumerate(raws)], "i int, raw string")).orderBy("i").collect()
    assert (got[0]["response"], got[0]["emotion"], got[0]["risk"], got[0]["strategy"], got[0]["parse_strategy"]) == ("Well then", "calm", 5, ["a", "b"], "exact")
    assert (got[1]["response"], got[1]["urgency"], got[1]["parse_strategy"]) == ("am here", 4, "partial")
    assert (got[2]["response"], got[2]["parse_strategy"], got[3]["response"]) == ("just words", "fallback", "")
    assert got[4]["response"].endswith("word...") and len(got[4]["response"].split()) == 120


def test_risk_score(spark):
    raws = ['{"risk_level": 4, "tier": "odd", "reason": "x", "safeguarding": "false"}', "no", '{"risk_level": 9}', '{"risk_level": 2, "tier": "tier_2", "safeguarding": true}']
    got = rows(spark, [(i, r) for i, r in enumerate(raws)], "i int, raw string").select("i", parse.risk_score(F.col("raw")).alias("r")).orderBy("i").select("r.*").collect()
    assert (got[0]["risk_level"], got[0]["tier"]) == (4, "tier_4") and got[1]["reason"] == "no_json_in_response" and got[2]["reason"] == "invalid_risk_level"
    assert got[3]["safeguarding"] and got[3]["helpline_key"] == "tier_2_minor"


def test_chunks(spark):
    got = [r["text"] for r in retrieval.chunks(fixtures.knowledge_base(spark)).orderBy("part", "id", "chunk_type").collect()]
    assert len(got) == 14 and "financial_stress: Money is short." in got and not [t for t in got if "(bn)" in t]


def test_topk_behind_filter(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    empty = e.limit(0).select(F.col("vec_id").alias("chunk_id"), "embedding", F.lit("x").alias("stressor_type"))
    assert retrieval.top_k(empty, e.where("vec_id < 2").select(F.col("vec_id").alias("query_id"), "embedding")).count() == 0


def test_sessions(spark):
    df = rows(spark, [(1, i, "user", f"t{i}", e) for i, e in enumerate(["a", "b", "neutral", "c", "a"])], "conv_id long, turn long, role string, text string, primary_emotion string")
    assert [r["arc"] for r in sessions.emotion_arc(df).orderBy("turn").collect()] == [None, None, "a → b → neutral", "a → b → neutral → c", "b → neutral → c → a"]
    known = rows(spark, [(1, ["z", "a"])], "conv_id long, recurring_stressors array<string>")
    assert sessions.profiles(df, known).first()["recurring_stressors"] == ["z", "a", "b", "c"]
    assert [len(r["history"]) for r in sessions.history(df, last=2).orderBy("turn").collect()] == [0, 1, 2, 2, 2]


def test_metrics(spark):
    one = rows(spark, [(1,), (3,), (5,)], "u int")
    assert [r[0] for r in one.select(metrics.ordinal(F.col("u"))).collect()] == [[0, 0, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1]]
    df = rows(spark, [("x", "x"), ("x", "y"), ("y", "y")], "t string, p string")
    assert metrics.macro_f1(df, "t", "p", ["x", "y", "z"]).first()[0] == 0.4444
    log = rows(spark, [(i, s) for i, s in enumerate([0.1, 0.5, 0.4, 0.4, 0.3, 0.9])], "epoch int, score double")
    assert [r["stopped"] for r in metrics.early_stopping(log).orderBy("epoch").collect()] == [False, False, False, False, True, True]


def test_quality_check(spark):
    data = [(0, "a message about my family", 1, "vent_frustration"), (1, "A message about my family!", 1, "vent_frustration"), (2, "short", 1, "unclear"), (3, "this exam, I will kill it", 4, "unclear"), (4, "a wholly different message", 1, "odd")]
    got = {r["i"]: r["rejection_reason"] for r in reports.quality_check(rows(spark, data, "i long, text string, urgency_level int, intent string"), "i").collect()}
    assert got == {0: None, 1: "exact_duplicate", 2: "too_short", 3: "metaphor_crisis_mismatch", 4: "invalid_intent"}


def _echo():
    return lambda prompts: [p.upper() for p in prompts]


def _words():
    return models.hashed_words(8)


def test_models_plug_in(spark):
    df = rows(spark, [("a b",), (None,)], "text string")
    assert {r["raw"] for r in models.generate(df.na.fill(""), "text", _echo).collect()} == {"A B", ""}
    assert all(len(r["embedding"]) == 8 for r in models.embed(df, "text", _words).collect())


def test_copies_of_ties_and_missing_order(spark):
    df = dedup.with_fingerprint(rows(spark, [(1, "aaa bbb"), (1, "aaa bbb"), (None, "aaa bbb"), (None, "ccc"), (None, "ccc"), (7, "alone")], "i int, text string").coalesce(1))
    kept, gone = dedup.exact(df, "i")
    assert sorted((r["i"] or 0, r["text"]) for r in kept.collect()) == [(0, "ccc"), (1, "aaa bbb"), (7, "alone")] and gone.count() == 3


def test_validate_keeps_the_origin(spark):
    df = rows(spark, [("I want to die", "greeting", "neutral", 1, "en", ("m", "b"))], "text string, intent string, category string, urgency int, language string, _meta struct<model: string, batch_id: string>")
    done = labels.validate(df.withColumns({"_level": F.lit(1), "_t": F.lit("x")})).first()
    assert done["_meta"]["model"] == "m" and done["_level"] == 1 and done["_t"] == "x" and done["category"] == "crisis"
    kept = parse.reply(safety.assess(affect.detect(cleaning.clean(df.withColumns({"_given": F.lit(2), "_line": F.lit(3), "raw": F.lit("x")})))))
    assert {"_meta", "_given", "_line"} <= set(kept.columns) and kept.first()["_given"] == 2


def test_vectors_of_any_kind(spark):
    data = [(1, [1.0, 0.0], "a"), (1, [0.9, 0.1], None), (2, [0.5], "b"), (3, None, "a"), (4, [None, 1.0], "a"), (5, [float("nan"), 1.0], "a")]
    index = rows(spark, data, "chunk_id long, embedding array<float>, stressor_type string")
    asked = rows(spark, [(7, [1.0, 0.0], "none"), (8, [1.0, 0.0], "b"), (9, None, None)], "query_id long, embedding array<float>, wanted string")
    got = [(r["query_id"], r["rank"], r["chunk_id"], r["stressor_type"]) for r in retrieval.top_k(index, asked, wanted="wanted").orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 1, "a"), (7, 2, 1, None), (7, 3, 2, "b"), (8, 1, 1, None), (8, 2, 2, "b")]
    vectors = index.select(F.col("chunk_id").alias("vec_id"), "embedding")
    assert [(r["a"], r["b"]) for r in dedup.similar_pairs(vectors, 0.45).distinct().orderBy("a", "b").collect()] == [(1, 2)]
    assert dedup.semantic(vectors, 0.45).where("_dedup_reason IS NOT NULL").select("vec_id").distinct().collect()[0][0] == 2


def test_minhash_recall(spark):
    df = spark.read.parquet(f"{DATA}/documents.parquet")
    sets = {r["doc_id"]: frozenset((r["text"] or "").lower().split()) for r in df.collect()}
    first = {}
    for d in sorted(sets):
        first.setdefault(sets[d], d)
    distinct = [d for d in first.values() if sets[d]]
    near = {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if len(sets[a] & sets[b]) >= 0.85 * len(sets[a] | sets[b])}
    copies = {(first[s], d) for d, s in sets.items() if s and first[s] != d}
    got = {(r["a"], r["b"]) for r in dedup.minhash(df, "doc_id").collect()}
    assert got <= near | copies and copies <= got and len(got & near) >= 0.9 * len(near)


def test_minhash_misses_no_pair(spark, monkeypatch):
    """Sets of all sizes with as few common words as a pair may have, small ones too, and unlike ones: exactly the pairs of the loop."""
    import random

    monkeypatch.setattr(dedup, "PART", 8)
    rng, sets = random.Random(7), []
    for n in [5, 6, 7, 8, 10, 13, 17, 20, 40, 85, 100, 230, 700] * 12:
        base = rng.sample(range(3000), n)
        sets.append(base)
        for gone in {n - -(-n * 17 // 20), -(-(n * 3) // 37), 1}:
            sets.append(base[gone:])  # 17 in 20 and less
            sets.append(base[gone // 2 :] + [5000 + len(sets) * 100 + x for x in range(gone // 2)])
    data = [(i, " ".join(f"w{x}" for x in s)) for i, s in enumerate(sets)]
    first = {}
    for i, s in enumerate(sets):
        first.setdefault(frozenset(s), i)
    distinct = list(first.items())
    want = {(i, j) for x, (a, i) in enumerate(distinct) for b, j in distinct[x + 1 :] if len(a & b) / len(a | b) >= 0.85}
    want |= {(first[frozenset(s)], i) for i, s in enumerate(sets) if first[frozenset(s)] != i}
    got = [(r["a"], r["b"]) for r in dedup.minhash(rows(spark, data, "i long, text string"), "i").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 400


def test_minhash_moves_few_rows(spark):
    """Texts of common words: of 1,500 texts with hardly a pair, what meets is a small part of all pairs."""
    import random

    rng = random.Random(3)
    texts = [" ".join({f"w{int(200 * rng.random() ** 2)}" for _ in range(60)}) for _ in range(1500)]
    firsts = dedup._classes_of_size(0.85, 100)
    seen = {}
    for i, t in enumerate(texts):
        words = np.array(sorted({int.from_bytes(hashlib.md5(w.encode()).digest()[:8]) for w in t.split()}), np.uint64)
        for h in dedup._signature(words, 0.85, firsts).tolist():
            seen.setdefault(h, []).append(i)
    assert sum(len(x) * (len(x) - 1) // 2 for x in seen.values()) < 0.05 * 1500 * 1499 / 2


def test_arc_of_ended_turns(spark):
    data = [(1, i, e, x) for i, (e, x) in enumerate([("a", False), ("b", True), ("c", False), ("d", False), ("e", True), ("f", None), ("g", False)])]
    got = [(r["arc_length"], r["arc"]) for r in sessions.emotion_arc(rows(spark, data, "conv_id long, turn long, primary_emotion string, ended boolean"), ended="ended").orderBy("turn").collect()]
    assert got == [(1, None), (1, None), (2, None), (3, "a → c → d"), (3, "a → c → d"), (4, "a → c → d → f"), (5, "c → d → f → g")]


def test_run_goes_by_file_and_line(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    line = lambda text, urgency, name: json.dumps({"text": text, "intent": "anxiety_panic", "category": "emotional", "urgency": urgency, "language": "en", "_meta": {"model": name}})
    (raw / "b.jsonl").write_text("\n".join([line("I feel worried, really", 3, "b"), line("another one that is long", 9, "b")]))
    (raw / "a.jsonl").write_text("\n".join([line("first of them all here", 2, "a"), "{broken", line("I feel worried really", 2, "a")]))
    out = curation.run(spark, str(raw), str(tmp_path / "out"))
    assert [r["text"] for r in out.final.collect()] == ["first of them all here", "I feel worried really", "another one that is long"]
    assert [(r["text"], r["_meta"]["model"]) for r in out.removed.collect()] == [("I feel worried, really", "b")] and out.stats.first()["dedup_exact"] == 1


def test_ids_go_on_whatever_the_order_column(spark):
    values = [0, 1, 2, 3, 10**15, 10**15 + 1, 5, 5]
    got = [r["id"] for r in reports.assign_ids(rows(spark, [(v,) for v in values], "k long"), "k").orderBy("k", "id").collect()]
    assert got == [f"seed_train_{i:04d}" for i in range(1, 9)]


def _failing():
    calls = []

    def model(prompts):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("not yet")
        return ["late"] * len(prompts)

    return model


def _broken():
    raise OSError("no model")


def test_models_are_tried_again(spark):
    df = rows(spark, [("a",)], "text string").coalesce(1)
    assert models.generate(df, "text", _failing).first()["raw"] == "late"
    with pytest.raises(Exception, match="not yet"):
        models.generate(df, "text", _failing, retries=2).collect()
    assert models.healthy(_echo) and not models.healthy(_broken) and not models.healthy(_failing)


def _scorer():
    return lambda prompts: ['{"risk_level": 5, "tier": "tier_5", "safeguarding": false}' if "quiet words" in p else '{"risk_level": 3, "tier": "tier_3"}' for p in prompts]


def _reply():
    return lambda asked: ["---RESPONSE---\nGo on\n---METADATA---\nurgency=9" if "Vandrevala" not in c.system else "" for c in asked]


def test_turns_carry_state(spark):
    from grainmill.plans import turns

    kb = fixtures.knowledge_base(spark)
    index = models.embed(retrieval.chunks(kb).withColumn("chunk_id", F.monotonically_increasing_id()), "text", _words)
    say = lambda *t: rows(spark, list(t), "conv_id long, text string")
    first = turns.answer(say((1, "my exam result worries me"), (2, "I want to die"), (3, None)), turns.new_state(spark), kb, index, _words, _reply, {"normal": "Be plain."})
    got = {r["conv_id"]: r for r in first.results.collect()}
    assert (got[1]["response"], got[1]["urgency"], got[1]["rag_chunks"], got[1]["crisis_exit"], got[1]["parse_strategy"]) == ("Go on", 5, 3, False, "exact")
    assert (got[2]["crisis_exit"], got[2]["risk"], got[2]["risk_action"], got[2]["helpline_name"], got[2]["emotion"]) == (True, 4, "urgent_prompt", "iCall", "grief")
    second = turns.answer(say((1, "some quiet words"), (3, "hello")), first.state, kb, index, _words, _reply, {}, scorer=_scorer)
    got = {r["conv_id"]: r for r in second.results.collect()}
    assert (got[1]["risk_source"], got[1]["risk"], got[1]["helpline_name"], got[1]["crisis_exit"]) == ("llm", 5, "Vandrevala Foundation", True)
    assert (got[3]["risk"], got[3]["risk_action"], got[3]["risk_source"]) == (3, "crisis_calm_conversation", "llm")
    state = {r["conv_id"]: r for r in second.state.collect()}
    assert {c: (r["turn_count"], len(r["history"]), len(r["emotion_arc"])) for c, r in state.items()} == {1: (2, 4, 1), 2: (1, 2, 0), 3: (2, 4, 2)}
    assert turns.session_of(second.state, 2).count() == 1 and turns.session_of(turns.reset(second.state, say((2, ""))), 2).count() == 0


def test_prompt_blocks(spark):
    kb = retrieval.enrich(fixtures.knowledge_base(spark), spark.createDataFrame([], "id string")).withColumn("guardrail_registry", F.map_concat("guardrail_registry", F.create_map(F.lit("stigma_bypass_active"), F.lit("Speak of stress only."))))
    data = [(1, "academic_pressure", 4, 3, "", True), (2, "none", 1, 3, "iCall (1)", False)]
    df = rows(spark, data, "i int, stressor string, risk int, urgency int, helpline_note string, stigma_flag boolean")
    df = df.withColumns({"emotion": F.lit("fear"), "intent": F.lit("unclear"), "lang_code": F.lit("en"), "technique": F.lit("grounding"), "idioms_detected": F.array(F.lit("izzat"), F.lit("odd"))})
    got = {r["i"]: r for r in sessions.prompt(sessions.with_knowledge(df, kb), {"crisis": "Stay."}).collect()}
    one, two = got[1]["prompt"], got[2]["prompt"]
    order = ["### Signals", "### Crisis, risk 4", "iCall (9152987821)", "### Culture\n- Ranks are public.", '- Never say: "just study harder"', "- Do not compare", "### Technique", "### Stigma\nSpeak of stress only.", "'izzat' (honour) — Standing of the family.", "### Mode\nStay.", "At most 150 words", "---RESPONSE---"]
    assert [one.index(x) for x in order] == sorted(one.index(x) for x in order) and "### Support" not in one
    assert "mention iCall (1)" in two and "### Crisis" not in two and "### Stigma" not in two and "### Culture" not in two and got[2]["word_cap"] == 120
