"""Runs that fail and go on, the fingerprint store, missing fields, conversations with all their turns, state by key."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from grainmill.operators import labels, retrieval
from grainmill.plans import curation, fixtures, turns
from grainmill.sources import files, fingerprints, models, runs
from grainmill.streaming import conversations, streams


def line(text, **more):
    return json.dumps({"text": text, "intent": "anxiety_panic", "category": "emotional", "urgency": 2, "language": "en"} | more)


def batch(folder, name, texts):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(line(t) for t in texts))


def contents(root):
    """The rows of every output, as sorted lines."""
    return {name: sorted(x for f in sorted((root / name).rglob("part-*.json")) for x in f.read_text().splitlines()) for name in ("final", "corrections", "rejected", "clean_rejected", "removed", "malformed")}


FIRST, SECOND = ["I feel worried about tomorrow", "another long line here", "hi", "I feel worried about tomorrow!"], ["Another long line here", "a wholly new text here"]


@pytest.fixture(scope="module")
def unbroken(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("unbroken")
    for name, texts in (("one", FIRST), ("two", SECOND)):
        batch(root / name, "a.jsonl", texts)
        curation.run(spark, str(root / name), str(root / "out"))
    return contents(root / "out")


def test_two_batches(unbroken):
    assert sorted(json.loads(x)["text"] for x in unbroken["final"]) == ["I feel worried about tomorrow", "a wholly new text here", "another long line here"]
    assert [json.loads(x)["text"] for x in unbroken["removed"]] == ["Another long line here"]  # of the last run


STEPS = ["stage:records", "stage:marked", "stage:checked", "output:final", "output:rejected", "commit", "publish:0", "publish:2"]


@pytest.mark.parametrize("step", STEPS)
def test_a_killed_run_goes_on(spark, tmp_path, monkeypatch, unbroken, step):
    """Killed before or between any of its writes, a run called again leaves the files of one that was not."""
    kind, _, which = step.partition(":")
    for name, texts in (("one", FIRST), ("two", SECOND)):
        batch(tmp_path / name, "a.jsonl", texts)
    curation.run(spark, str(tmp_path / "one"), str(tmp_path / "out"))

    with monkeypatch.context() as m:
        if kind in ("stage", "output"):
            real = getattr(runs.Run, kind)
            m.setattr(runs.Run, kind, lambda self, df, name, *a, **k: (_ for _ in ()).throw(OSError("killed")) if name == which else real(self, df, name, *a, **k))
        elif kind == "commit":
            m.setattr(runs, "write_once", lambda spark, path, text, real=runs.write_once: (_ for _ in ()).throw(OSError("killed")) if path.endswith(".json") else real(spark, path, text))
        else:
            real = runs.Run._publish

            def some(self, manifest):
                outputs = dict(list(manifest["outputs"].items())[: int(which)])
                for name, append in outputs.items():
                    target = tmp_path / "out" / name / f"run={manifest['run']}"
                    for old in [] if append else list((tmp_path / "out" / name).glob("run=*")):
                        runs.remove(spark, str(old))
                    target.parent.mkdir(exist_ok=True, parents=True)
                    (tmp_path / "out/_runs" / manifest["run"] / "outputs" / name).rename(target)
                raise OSError("killed")

            m.setattr(runs.Run, "_publish", some)
        with pytest.raises(OSError, match="killed"):
            curation.run(spark, str(tmp_path / "two"), str(tmp_path / "out"))
    out = curation.run(spark, str(tmp_path / "two"), str(tmp_path / "out"))
    if kind == "publish":
        # It had been committed: the second call is a run of its own, which finds nothing new.
        assert out.stats.first()["final_written"] == 0
        assert contents(tmp_path / "out")["final"] == unbroken["final"] and len(runs.history(spark, str(tmp_path / "out"))) == 3
    else:
        assert contents(tmp_path / "out") == unbroken and len(runs.history(spark, str(tmp_path / "out"))) == 2


def test_stages_are_not_made_twice(spark, tmp_path, monkeypatch):
    batch(tmp_path / "raw", "a.jsonl", FIRST)
    monkeypatch.setattr(runs.Run, "commit", lambda self: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError, match="killed"):
        curation.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    times = {p: p.stat().st_mtime_ns for p in (tmp_path / "out/_runs/000001/stages").rglob("*.parquet")}
    monkeypatch.undo()
    curation.run(spark, str(tmp_path / "raw"), str(tmp_path / "out"))
    assert times and all(p.stat().st_mtime_ns == t for p, t in times.items())


def test_fingerprint_store(spark, tmp_path):
    def add(values, run):
        df = spark.createDataFrame([(v,) for v in values], "_fingerprint string")
        fingerprints.rows(df).write.partitionBy("bucket").parquet(f"{tmp_path}/fingerprints/run={run}")
        fingerprints.filter_rows(df).write.parquet(f"{tmp_path}/filter/run={run}")

    ask = lambda values, report=None: {r[0] for r in fingerprints.known(spark, str(tmp_path), spark.createDataFrame([(v,) for v in values], "_fingerprint string"), report=report).collect()}
    assert ask(["a", None]) == set()
    add([f"x{i}" for i in range(3000)], 1)
    add(["y1", "y2", None, "x5"], 2)
    report = {}
    assert ask(["x7", "y2", "z1", "z2", None], report) == {"x7", "y2"} and report["buckets"] <= 3
    assert ask([f"z{i}" for i in range(2000)], report) == set() and report["candidates"] < 100
    assert ask([f"x{i}" for i in range(2500, 3500)]) == {f"x{i}" for i in range(2500, 3000)}


def test_missing_null_and_other_types(spark, tmp_path):
    given = ['{"text": "a text of some length", "intent": null, "urgency": "4"}', '{"text": "second text here", "category": 7, "urgency": [1], "intent": "greeting"}', '{"text": null, "intent": "greeting", "category": "neutral", "urgency": 3}', "[1]", "{broken", '"text"']
    (tmp_path / "a.jsonl").write_text("\n".join(given))
    good, bad = files.read_jsonl(spark, str(tmp_path), variants=True)
    rows = files.in_order(good).orderBy("_ord").select(*[files.lacks(f).alias(f) for f in ("intent", "category", "urgency")], files.is_null("intent").alias("null"), files.kind_of("urgency").alias("kind"), "category", "urgency").collect()
    assert [tuple(r) for r in rows] == [(False, True, False, True, "STRING", None, 4), (False, False, False, False, "ARRAY<BIGINT>", "7", None), (False, False, False, False, "BIGINT", "neutral", 3)]
    assert {r["_corrupt"] for r in bad.collect()} == {"[1]", "{broken", '"text"'}
    lacks = {f: files.lacks(f) for f in (*labels.REQUIRED, "language")}
    done = labels.validate(good, missing=lacks).collect()
    by = {r["text"]: r for r in done}
    assert by["a text of some length"]["_corrections"] == ["filled_default:category", "intent_invalid:'None'", "urgency_neutral_cap:4→1"]
    assert by["second text here"]["_corrections"][:2] == ["urgency_coerced_to_int", "category_fixed_from_intent:'7'→'neutral'"]
    assert by[""]["_drop_reason"] == "empty_text"
    strict = {r["text"]: r["_drop_reason"] for r in labels.validate(good, True, lacks).collect()}
    assert strict == {"a text of some length": "missing_fields:category", "second text here": None, "": "empty_text"}


def test_turn_log_by_batch(spark, tmp_path):
    row = lambda text: spark.createDataFrame([("t", "1", text)], "timestamp string, session_id string, user string")
    assert files.read_turns(spark, f"{tmp_path}/log").count() == 0
    files.append_turns(row("a"), f"{tmp_path}/log", 0)
    files.append_turns(row("b"), f"{tmp_path}/log", 1)
    files.append_turns(row("b"), f"{tmp_path}/log", 1)
    assert sorted(r["user"] for r in files.read_turns(spark, f"{tmp_path}/log").collect()) == ["a", "b"]


# --- conversations


def _words():
    return models.letters()


def test_message_and_six_turns_reach_the_model(spark):
    kb = fixtures.knowledge_base(spark)
    index = models.embed(retrieval.chunks(kb).withColumn("chunk_id", F.monotonically_increasing_id()), "text", _words)
    state, last = turns.new_state(spark), None
    for k in range(6):
        said = spark.createDataFrame([(1, f"zebra{k} umbrella")], "conv_id long, text string")
        done = turns.answer(said, state, kb, index, _words, lambda: (lambda asked: [f"say {len(c.messages)} {c.messages[0][1].split()[0]} {c.messages[-1][1].split()[0]}" for c in asked]), {})
        state, last = done.state, done.results.first()["response"]
        oldest = "zebra0" if k < 4 else f"zebra{k - 3}"
        assert last == f"say {min(6, 2 * k) + 1} {oldest} zebra{k}"
    kept = state.first()
    assert len(kept["history"]) == 6 and len(kept["emotion_arc"]) == 4 and kept["arc_length"] == 6 and kept["turn_count"] == 6


def test_scorer_sees_four_turns(spark):
    kb = fixtures.knowledge_base(spark)
    state = spark.createDataFrame([(1, 3, [(r, f"m{i} {'x' * 300}") for i, r in enumerate(["user", "assistant"] * 3)], [], 0, None)], turns.STATE)
    held = state.withColumn("text", F.lit("now this"))

    def make():
        return lambda prompts: [json.dumps({"risk_level": 1, "reason": " ".join(w for w in p.split() if w[:1] in "mUA" and len(w) < 11)}) for p in prompts]

    assert turns._scored(held, make, kb, "T").select("_gm_score.reason").first()[0] == "User: m2 Assistant: m3 User: m4 Assistant: m5"


def test_state_by_key_over_batches(spark, tmp_path):
    """Three runs of one stream, with a reset in the second, and lookups behind each."""
    schema = "conv_id long, turn long, role string, text string, primary_emotion string, stressor_type string"
    feed = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    turn = lambda c, t, e, s=None, role="user": (c, t, role, f"text {t}", e, s)
    feed("a", [turn(1, t, f"e{t}", "s" if t == 2 else None) for t in (3, 1, 2)] + [turn(2, 1, "x")])
    out, state = conversations.run(stream(), f"{tmp_path}/q")
    got = {r["conv_id"]: r for r in conversations.session_get(spark, state).collect()}
    assert got[1]["turn_count"] == 3 and got[1]["emotion_arc"] == ["e1", "e2", "e3"] and got[1]["last_stressor"] == "s" and [m["text"] for m in got[1]["history"]] == ["text 1", "text 2", "text 3"]
    feed("b", [turn(1, t, f"e{t}") for t in range(4, 9)] + [turn(2, 2, "", role=conversations.RESET)] + [turn(3, t, "y") for t in range(9)] + [turn(3, 4, "", role=conversations.RESET)])
    out, state = conversations.run(stream(), f"{tmp_path}/q")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "conv_id long")
    got = {r["conv_id"]: r for r in conversations.session_get(spark, state, ids).collect()}
    assert set(got) == {1, 3} and [m["text"] for m in got[1]["history"]] == [f"text {t}" for t in range(3, 9)] and got[1]["turn_count"] == 8 and got[1]["last_stressor"] == "s"
    assert got[3]["turn_count"] == 4 and [m["text"] for m in got[3]["history"]] == [f"text {t}" for t in range(5, 9)]
    feed("c", [turn(2, 3, "z")])
    out, state = conversations.run(stream(), f"{tmp_path}/q")
    rows = {(r["conv_id"], r["turn"]): (r["turn_count"], r["arc"]) for r in out.collect()}
    assert rows[2, 3] == (1, None) and rows[1, 8] == (8, "e5 → e6 → e7 → e8") and (2, 2) not in rows



def test_sql_functions(spark):
    from grainmill.functions import sql
    from grainmill.functions.text import fingerprint, seed_fingerprint

    assert len(sql.register(spark)) == len(set(sql.register(spark))) == len(sql.FUNCTIONS)
    df = spark.createDataFrame([("Hello, World! a - b",), ("  मुझे x ",), ("",), (None,)], "t string")
    df.createOrReplaceTempView("gm_test")
    got = spark.sql("SELECT t, gm_fingerprint(t) AS a, gm_seed_fingerprint(t) AS b, gm_words(t) AS w FROM gm_test")
    assert got.where((got["a"] != fingerprint(F.col("t"))) | (got["b"] != seed_fingerprint(F.col("t")))).count() == 0
    assert {tuple(r["w"]) for r in got.where("t IS NOT NULL").collect()} == {("Hello,", "World!", "a", "-", "b"), ("मुझे", "x"), ()}
    rows = spark.sql("""SELECT x.* FROM VALUES ('```json\\n[{"text": "long enough", "urgency": 99}]\\n```'), ('x [{"text": "inside", "intent": "greeting"}] y'), ('none') AS v(raw), LATERAL gm_records(raw, 'casual_chat', 'neutral') x""").collect()
    assert {tuple(r) for r in rows} == {("long enough", "casual_chat", "neutral", 5, "en"), ("inside", "greeting", "neutral", 2, "en")}


def test_token_streams_over_batches(spark, tmp_path):
    from grainmill.streaming import tokens

    schema = "k long, at long, line string"
    said = lambda k, at, piece, done=False: (k, at, json.dumps({"response": piece, "done": done}))
    feed = lambda name, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    stream = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    feed("a", [said(1, 2, "b"), said(1, 1, "a"), said(2, 1, "x"), said(2, 2, "y", True), said(2, 3, "never"), (3, 1, "not json"), (3, 2, json.dumps({"message": {"content": "m"}}))])
    done, rest = tokens.run(stream(), "k", "at", path=f"{tmp_path}/q")
    assert [tuple(r) for r in done.collect()] == [(2, "xy")] and sorted(tuple(r) for r in rest.collect()) == [(1, "ab"), (3, "m")]
    feed("b", [said(1, 3, "c"), said(1, 4, "", True), said(2, 4, "late")])
    done, rest = tokens.run(stream(), "k", "at", path=f"{tmp_path}/q")
    assert sorted(tuple(r) for r in done.collect()) == [(1, "abc"), (2, "xy")] and [tuple(r) for r in rest.collect()] == [(3, "m")]


def test_documents_are_replaced_whole(spark, tmp_path):
    doc = lambda v: spark.createDataFrame([(v, {"a": v})], "v string, m map<string, string>")
    path = str(tmp_path / "doc")
    for v in ("1", "2"):
        files.replace_document(doc(v), path, f"{path}-old")
    held = files.read_document(spark, path, "v string, m map<string, string>", lines=True)
    files.replace_document(held.withColumn("v", F.lit("3")), path, f"{path}-old")
    read = lambda p: [tuple(r) for r in files.read_document(spark, p, "v string, m map<string, string>", lines=True).collect()]
    assert read(path) == [("3", {"a": "2"})] and read(f"{path}-old") == [("2", {"a": "2"})]


def test_a_streams_filter_stays_above_the_cascade(spark, tmp_path, capsys):
    """The plan holds each step of the cleaning a few times at most: moved below the projections, the filter would hold the first step hundreds of times."""
    raw = spark.readStream.schema("text string, language string, intent string, category string, urgency int, ts timestamp").json(str(tmp_path))
    streams.curated_stream(raw, "ts").explain()
    assert 0 < capsys.readouterr().out.count("regexp_replace(") <= 20


def test_a_batch_adds_one_file_to_a_bucket(spark, tmp_path):
    """However many tasks hold the fingerprints; each task wrote a file of its own to every bucket."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        new = spark.range(20000).select(F.md5(F.col("id").cast("string")).alias("_fingerprint"))
        fingerprints.rows(new).write.partitionBy("bucket").parquet(f"{tmp_path}/fingerprints")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list(tmp_path.glob("fingerprints/bucket=*/part-*.parquet"))) == fingerprints.BUCKETS
    assert spark.read.parquet(f"{tmp_path}/fingerprints").count() == 20000
