"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grainmill.functions import sql
from grainmill.functions.taxonomy import INTENTS
from grainmill.functions.text import fingerprint, seed_fingerprint
from grainmill.operators import affect, cleaning, dedup, labels, metrics, parse, reports, retrieval, safety
from grainmill.operators import sessions as talk
from grainmill.plans import curation, fixtures
from grainmill.plans import turns as flow
from grainmill.sources import files, models
from grainmill.sources.scratch import drop_table, shared_path, table
from grainmill.streaming import conversations, streams, tokens

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, Query] = {}
#: Cosine of the vector queries: the test vectors have no pair near the default.
NEAR = 0.35


def query(f: Query) -> Query:
    ALL[f.__name__] = f
    return f


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files; the pattern lets the table be one file or a folder."""
    return spark.readStream.schema(_read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaning.clean(fixtures.records(spark, sf_dir))


def _fingerprinted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.with_fingerprint(_read(spark, sf_dir, "documents")).select("doc_id", "_fingerprint")


def _joined(c) -> Column:
    return F.array_join(c, "|")


@query
def curated_by_language(spark, sf_dir):
    kept, _ = cleaning.split_clean(fixtures.records(spark, sf_dir))
    marked = dedup.marked_copies(dedup.with_fingerprint(kept).select("doc_id", "language", "_fingerprint"), "doc_id")
    return marked.groupBy("language", F.coalesce("_dedup_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"))


@query
def clean_documents(spark, sf_dir):
    return _cleaned(spark, sf_dir).select("doc_id", "text", "language", F.coalesce("_drop_reason", F.lit("")).alias("drop_reason"), F.col("_language_corrected").alias("language_corrected"))


@query
def clean_drop_reasons(spark, sf_dir):
    return _cleaned(spark, sf_dir).groupBy(F.coalesce("_drop_reason", F.lit("")).alias("drop_reason")).agg(F.count("*").alias("n"))


@query
def clean_language_fix(spark, sf_dir):
    return cleaning.split_clean(fixtures.records(spark, sf_dir))[0].groupBy("language", F.col("_language_corrected").alias("corrected")).agg(F.count("*").alias("n"))


@query
def clean_pages_entities(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", F.coalesce("html", F.lit("")).alias("html")).transform(cleaning.scrub, "html", "scrubbed").select("page_id", F.md5("scrubbed").alias("scrubbed_md5"))


@query
def fingerprint_documents(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", fingerprint(F.col("text")).alias("fp"))


@query
def dedup_seed_fingerprint(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", seed_fingerprint(F.col("text")).alias("fp"))


@query
def dedup_fingerprint_set(spark, sf_dir):
    return dedup.fingerprints(_read(spark, sf_dir, "documents")).withColumnRenamed("_fingerprint", "fp")


@query
def dedup_sha256(spark, sf_dir):
    return dedup.sha256(_read(spark, sf_dir, "documents")).select("doc_id", F.col("_sha256").alias("sha256"))


@query
def dedup_exact(spark, sf_dir):
    return dedup.exact(_fingerprinted(spark, sf_dir), "doc_id")[0].select("doc_id")


@query
def dedup_removed(spark, sf_dir):
    return dedup.exact(_fingerprinted(spark, sf_dir), "doc_id")[1].select("doc_id", F.col("_dedup_reason").alias("reason"))


@query
def dedup_cross_batch(spark, sf_dir):
    docs = dedup.with_fingerprint(_read(spark, sf_dir, "documents"))
    old = docs.where("doc_id % 3 = 0").unionByName(dedup.with_fingerprint(_read(spark, sf_dir, "benchmark")).select("_fingerprint"), allowMissingColumns=True)
    kept, gone = dedup.against(docs.where("doc_id % 3 <> 0"), old)
    return kept.select("doc_id", F.lit(True).alias("kept")).unionByName(gone.select("doc_id", F.lit(False).alias("kept")))


@query
def dedup_counters(spark, sf_dir):
    marked = dedup.marked_copies(_fingerprinted(spark, sf_dir), "doc_id")
    return marked.agg(F.count("*").alias("total"), F.count("_dedup_reason").alias("exact_removed"))


@query
def semantic_pairs(spark, sf_dir):
    return dedup.similar_pairs(_read(spark, sf_dir, "embeddings"), NEAR).select("a", "b", F.round("sim", 6).alias("sim"))


@query
def semantic_dedup(spark, sf_dir):
    return dedup.semantic(_read(spark, sf_dir, "embeddings"), NEAR).select("vec_id", F.col("_dedup_reason").alias("reason"), F.col("_sim_score").alias("sim"))


@query
def near_dup_overlap(spark, sf_dir):
    return dedup.overlap_window(_read(spark, sf_dir, "documents"), "doc_id").select("order", "near_of")


@query
def minhash_dedup(spark, sf_dir):
    return dedup.minhash(_read(spark, sf_dir, "documents"), "doc_id")


def _validated(spark, sf_dir):
    return labels.validate(fixtures.records(spark, sf_dir).withColumn("language", F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("language"))).withColumn("intent", F.when(F.col("doc_id") % 13 == 0, "odd").otherwise(F.col("intent"))).withColumn("category", F.when(F.col("doc_id") % 17 == 0, "odd").otherwise(F.col("category"))))


@query
def validate_records(spark, sf_dir):
    return _validated(spark, sf_dir).select("doc_id", "intent", "category", "urgency", "language")


@query
def validate_corrections(spark, sf_dir):
    return _validated(spark, sf_dir).select("doc_id", _joined("_corrections").alias("corrections"))


@query
def validate_missing_fields(spark, sf_dir):
    """Without a category column, and with urgency missing from some rows: defaults, or a reason in strict mode."""
    rows, lacks = fixtures.records(spark, sf_dir).drop("category"), {"urgency": F.col("doc_id") % 3 == 0}
    tolerant, strict = labels.validate(rows, missing=lacks), labels.validate(rows, strict=True, missing=lacks)
    filled = F.filter("_corrections", lambda c: c.startswith("filled_default"))
    return tolerant.select("doc_id", _joined(filled).alias("filled")).join(strict.select("doc_id", F.col("_drop_reason").alias("reason")), "doc_id")


@query
def validate_split_counts(spark, sf_dir):
    kind = F.when(F.col("_drop_reason").isNotNull(), "dropped").when(F.size("_corrections") > 0, "corrected").otherwise("clean")
    return _validated(spark, sf_dir).groupBy(kind.alias("outcome")).agg(F.count("*").alias("n"))


@query
def pipeline_stats(spark, sf_dir):
    return curation.curate(fixtures.records(spark, sf_dir), "doc_id").stats


@query
def pipeline_final(spark, sf_dir):
    return curation.curate(fixtures.records(spark, sf_dir), "doc_id").final.select("doc_id", "intent", "category", "urgency", "language")


@query
def distribution_category(spark, sf_dir):
    return reports.distribution(fixtures.records(spark, sf_dir), "category")


@query
def distribution_intent_top10(spark, sf_dir):
    return reports.distribution(fixtures.records(spark, sf_dir), "intent", 10)


@query
def distribution_all(spark, sf_dir):
    return reports.distributions(fixtures.records(spark, sf_dir), ["category", "intent", "language"])


@query
def gap_report(spark, sf_dir):
    return reports.gaps(fixtures.records(spark, sf_dir))


@query
def seed_gap_report(spark, sf_dir):
    return reports.seed_gaps(affect.detect(fixtures.turns(spark, sf_dir)))


@query
def generation_calls(spark, sf_dir):
    return reports.calls(reports.gaps(fixtures.records(spark, sf_dir))).select("label", "gap", "call", "ask")


@query
def generation_prompts(spark, sf_dir):
    wanted = reports.calls(reports.gaps(fixtures.records(spark, sf_dir)))
    return reports.generation_prompts(wanted, "{n}|{intent}|{category}|{low}|{high}|{language}|{note}", "no methods").select("label", "call", "prompt", "prompt_hash")


def _seed_rows(spark, sf_dir):
    seen = affect.detect(fixtures.turns(spark, sf_dir))
    return seen.withColumn("row", F.col("conv_id") * 1000 + F.col("turn")).withColumn("urgency_level", (F.col("row") % 5 + 1).cast("int"))


@query
def quality_check_reasons(spark, sf_dir):
    rows = _seed_rows(spark, sf_dir)
    reason = reports.quality_reason(F.col("text"), F.col("urgency_level"), F.when(F.col("row") % 19 != 0, F.col("intent")))
    return rows.select("conv_id", "turn", F.coalesce(reason, F.lit("")).alias("reason"))


@query
def quality_check_all(spark, sf_dir):
    return reports.reasons(reports.quality_check(_seed_rows(spark, sf_dir), "row"))


@query
def assign_ids(spark, sf_dir):
    old = spark.createDataFrame([("seed_train_0041",), ("seed_train_x",), ("seed_val_0100",)], "id string")
    return reports.assign_ids(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", old).select("doc_id", "id")


@query
def safety_risk(spark, sf_dir):
    out = safety.assess(fixtures.records(spark, sf_dir))
    return out.select("doc_id", "is_crisis", "risk_level", "tier", "helpline_name", "helpline_number", "safeguarding", safety.hard_exit(F.col("risk_level")).alias("hard_exit"))


@query
def safety_matched_pattern(spark, sf_dir):
    return safety.assess(fixtures.records(spark, sf_dir)).select("doc_id", "matched_pattern")


@query
def safety_tier_counts(spark, sf_dir):
    return safety.assess(fixtures.turns(spark, sf_dir)).groupBy("tier").agg(F.count("*").alias("n"))


@query
def safety_combined(spark, sf_dir):
    rows = safety.assess(fixtures.records(spark, sf_dir)).withColumn("scored", (F.col("doc_id") % 5 + 1).cast("int"))
    line = safety.score_helpline(F.when(F.col("doc_id") % 2 == 0, "tier_4"), F.col("doc_id") % 3 == 0, F.col("text"))
    return safety.combine(rows, "risk_level", "scored", "urgency").select("doc_id", "effective_risk", "risk_source", "risk_action", line["name"].alias("score_helpline"))


@query
def safety_exit_reply(spark, sf_dir):
    out = table(safety.assess(fixtures.records(spark, sf_dir)).drop("text"), "assessed").where(safety.hard_exit(F.col("risk_level")))
    return out.select("doc_id", safety.exit_action(F.col("risk_level")).alias("action"), safety.exit_reply(F.col("risk_level"), F.col("helpline_name"), F.col("helpline_number"), F.col("safeguarding")).alias("reply"))


def _felt(spark, sf_dir):
    return affect.detect(fixtures.turns(spark, sf_dir))


@query
def emotion_intent(spark, sf_dir):
    return _felt(spark, sf_dir).select("conv_id", "turn", "intent", "stressor_type", "urgency_level", "tone_mode", "cbt_technique", _joined("emotions_all").alias("emotions"), "primary_emotion", F.coalesce("secondary_emotion", F.lit("")).alias("secondary_emotion"))


@query
def emotion_documents(spark, sf_dir):
    return affect.detect(fixtures.records(spark, sf_dir).drop("intent")).groupBy("intent", "primary_emotion").agg(F.count("*").alias("n"))


@query
def emotion_sentiment(spark, sf_dir):
    return _felt(spark, sf_dir).select("conv_id", "turn", "sentiment_score")


@query
def emotion_lang(spark, sf_dir):
    return _felt(spark, sf_dir).select("conv_id", "turn", "lang_code", "stigma_flag")


@query
def emotion_entities(spark, sf_dir):
    return _felt(spark, sf_dir).select("conv_id", "turn", _joined("entities_persons").alias("persons"), _joined("entities_roles").alias("roles"))


@query
def emotion_idioms(spark, sf_dir):
    return _felt(spark, sf_dir).select("conv_id", "turn", _joined("idioms_detected").alias("idioms"))


@query
def cbt_lookup(spark, sf_dir):
    return _felt(spark, sf_dir).groupBy("intent", "primary_emotion", "cbt_technique").agg(F.count("*").alias("n"))


def _index(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings")
    stressor = F.when(F.col("label") % 3 != 0, F.concat(F.lit("s"), (F.col("label") % 3).cast("string")))
    index = e.select(F.col("vec_id").alias("chunk_id"), "embedding", stressor.alias("stressor_type"))
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", F.when(F.col("vec_id") % 400 == 0, "s1").when(F.col("vec_id") % 400 == 100, "none").alias("wanted"))
    return index, asked


@query
def retrieve_topk(spark, sf_dir):
    index, asked = _index(spark, sf_dir)
    return retrieval.top_k(index, asked, k=5).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query
def retrieve_topk_filtered(spark, sf_dir):
    index, asked = _index(spark, sf_dir)
    return retrieval.top_k(index, asked, wanted="wanted").select("query_id", "rank", "chunk_id", F.coalesce("stressor_type", F.lit("")).alias("stressor_type"))


@query
def retrieve_context(spark, sf_dir):
    index, asked = _index(spark, sf_dir)
    found = retrieval.top_k(index, asked, wanted="wanted").withColumns({"source": F.concat(F.lit("src"), (F.col("chunk_id") % 4).cast("string")), "text": F.concat(F.lit("chunk "), F.col("chunk_id").cast("string"))})
    return retrieval.context(found)


@query
def retrieve_query_text(spark, sf_dir):
    f = _felt(spark, sf_dir)
    return f.select("conv_id", "turn", F.md5(retrieval.query_text(F.col("stressor_type"), F.col("primary_emotion"), F.col("text"))).alias("query_md5"))


@query
def vectors_normalised(spark, sf_dir):
    scaled = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x * (F.col("vec_id") % 5)).alias("v"))
    v = retrieval.normalised(F.col("v"))
    return scaled.select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"))


@query
def kb_chunks(spark, sf_dir):
    return retrieval.chunks(fixtures.knowledge(spark, sf_dir))


@query
def risk_prompt(spark, sf_dir):
    """A scorer's prompt from each knowledge base document."""
    return safety.risk_prompt(fixtures.knowledge(spark, sf_dir), "{phrases}#{stressors}#{high_risk}#{idioms}")


@query
def kb_enriched(spark, sf_dir):
    """Every document with notes for some stressors (and for some that are not there), keywords, idiom risk, a section and a version."""
    i = F.col("doc_id")
    fields = _read(spark, sf_dir, "documents").where("doc_id % 4 < 2").select(F.concat(F.when(i % 4 == 0, "s").otherwise("absent"), i.cast("string")).alias("id"), F.array(F.concat(F.lit("new "), i.cast("string"))).alias("cultural_context_notes"))
    risk = spark.createDataFrame([("ghar_ki_izzat", True, ["identity_conflict"]), ("not_there", True, ["x"])], "id string, risk_amplifier boolean, escalates_stressors array<string>")
    kb = retrieval.enrich(fixtures.knowledge(spark, sf_dir), fields, {"tier_2": ["a", "locked in"]}, risk, {"safeguarding_context": F.lit("by age")}, {"version": "2"})
    notes = F.array_join(F.flatten(F.map_values(F.transform_values("stressor_taxonomy", lambda _, v: F.coalesce(v["cultural_context_notes"], F.array().cast("array<string>"))))), ",")
    idiom = F.col("cultural_idioms")["ghar_ki_izzat"]
    return kb.select(
        F.col("_meta")["doc"].alias("doc"), F.array_join(F.array_sort(F.map_keys("stressor_taxonomy")), ",").alias("ids"), notes.alias("notes"), F.array_join(F.col("crisis_keywords")["tier_2"], ",").alias("tier_2"), F.size(F.col("crisis_keywords")["tier_3"]).alias("tier_3"),
        idiom["risk_amplifier"].alias("amplifies"), F.array_join(idiom["escalates_stressors"], ",").alias("escalates"), idiom["meaning"].alias("meaning"), "safeguarding_context", F.col("_meta")["version"].alias("version"),
    )


@query
def kb_risk_phrases(spark, sf_dir):
    return safety.risk_phrases(fixtures.knowledge(spark, sf_dir)).select("tier", F.array_join("phrases", ",").alias("phrases"))


@query
def session_turns(spark, sf_dir):
    return talk.numbered(_read(spark, sf_dir, "conversations")).select("conv_id", "turn", "turn_count")


@query
def session_history_window(spark, sf_dir):
    h = talk.history(_read(spark, sf_dir, "conversations"), last=talk.SHOWN, chars=talk.SHOWN_CHARS)
    return h.select("conv_id", "turn", F.size("history").alias("n_history"), F.md5(F.array_join(F.transform("history", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")).alias("history_md5"))


@query
def session_emotion_arc(spark, sf_dir):
    risk = safety.assess(_felt(spark, sf_dir)).withColumn("ended", safety.hard_exit(F.col("risk_level")))
    return talk.emotion_arc(risk, ended="ended").select("conv_id", "turn", "arc_length", F.coalesce("arc", F.lit("")).alias("arc"))


@query
def session_last_stressor(spark, sf_dir):
    f = _felt(spark, sf_dir).withColumn("stressor_type", F.nullif("stressor_type", F.lit("none")))
    return talk.last_stressor(f).select("conv_id", "turn", F.coalesce("last_stressor", F.lit("")).alias("last_stressor"))


@query
def session_profile(spark, sf_dir):
    return talk.profiles(_felt(spark, sf_dir)).select("conv_id", _joined("recurring_stressors").alias("stressors"))


def _log(spark, sf_dir):
    risk = safety.assess(_felt(spark, sf_dir))
    return risk.select("conv_id", "intent", safety.hard_exit(F.col("risk_level")).alias("crisis_exit"), (F.col("turn") % 4).cast("int").alias("rag_chunks"))


@query
def session_profile_choice(spark, sf_dir):
    """The profile that a turn uses: the call's, else the session's, else the default."""
    call, session = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("call "), F.col("turn"))), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("session "), F.col("conv_id")))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", talk.resolved(call, session, F.lit("default")).alias("profile"))


@query
def session_summary(spark, sf_dir):
    return talk.summary(_log(spark, sf_dir), "conv_id")


@query
def session_intent_counts(spark, sf_dir):
    return talk.intent_counts(_log(spark, sf_dir))


@query
def prompt_modes(spark, sf_dir):
    f = safety.assess(_felt(spark, sf_dir)).select("conv_id", "turn", "intent", F.col("stressor_type").alias("stressor"), F.col("urgency_level").alias("urgency"), F.col("risk_level").alias("risk"), F.col("primary_emotion").alias("emotion"), "lang_code", F.col("cbt_technique").alias("technique"))
    return talk.prompt(f, {"normal": "Answer plainly."}).groupBy("mode", "word_cap").agg(F.count("*").alias("n"))


@query
def prompt_texts(spark, sf_dir):
    """The whole prompt of every turn, with all of its blocks, from the turn's signals, its session and the knowledge base."""
    f = talk.history(talk.emotion_arc(safety.assess(_felt(spark, sf_dir))))
    f = f.select(
        "conv_id", "turn", "intent", F.col("stressor_type").alias("stressor"), F.col("urgency_level").alias("urgency"), F.col("risk_level").alias("risk"), F.col("primary_emotion").alias("emotion"), "lang_code",
        F.col("cbt_technique").alias("technique"), "idioms_detected", "stigma_flag", "arc", "history", F.array("text").alias("chunks"), "helpline_name", "helpline_number",
        F.when(F.col("risk_level") == 3, F.concat_ws(" ", "helpline_name", "helpline_number")).alias("helpline_note"), F.when(F.col("conv_id") % 2 == 0, F.array(F.concat(F.lit("session "), "conv_id"))).alias("profile"),
    )
    out = talk.prompt(talk.with_knowledge(f, fixtures.knowledge_base(spark)), {"normal": "Answer plainly."}, "Preamble.")
    return out.select("conv_id", "turn", "word_cap", F.md5("prompt").alias("prompt_md5"))


def _encoder():
    return models.letters()


def _speaker():
    """A stand-in for a model: says which mode the prompt asks for, the message's first word, that of the oldest message given and their number, so that replies depend on all of them."""

    def reply(c: models.Conversation) -> str:
        first = lambda text: (text.split() or ["nothing"])[0]
        mode = c.system.rsplit("### Mode", 1)[1].split()[0]
        return f"---RESPONSE---\nThe mode is {mode} today, {first(c.messages[-1][1])} after {first(c.messages[0][1])} in {len(c.messages)}\n---METADATA---\nstrategy=listen, ask"

    return lambda asked: [reply(c) for c in asked]


def _said(spark, sf_dir):
    """What the persons of the conversations say: conv_id, k (1, 2, 3 ...), text."""
    return fixtures.turns(spark, sf_dir).where("role = 'user'").select("conv_id", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("k"), "text")


def _flow(spark, sf_dir, scorer=None):
    """All turns of the persons, one after the other, all conversations side by side: results of each turn, and the last state."""
    chunks = retrieval.chunks(fixtures.knowledge_base(spark)).withColumn("chunk_id", F.row_number().over(Window.orderBy("part", "id", "chunk_type", "text")).cast("long"))
    index = table(models.embed(chunks, "text", _encoder), "chunks")
    said, state, results = table(_said(spark, sf_dir), "said"), flow.new_state(spark), []
    for k in range(1, (said.agg(F.max("k")).first()[0] or 0) + 1):
        done = flow.answer(said.where(F.col("k") == k), state, fixtures.knowledge_base(spark), index, _encoder, _speaker, {}, scorer=scorer)
        if k > 1:
            drop_table(state)
        state = done.state
        results.append(done.results.withColumn("k", F.lit(k)))
    return reduce(DataFrame.unionByName, results), state, said


@query
def io_jsonl(spark, sf_dir):
    """Records written twice as JSON lines, the second time appended, with lines that do not parse between; read again with their order."""
    path, r = shared_path(spark, "jsonl"), fixtures.records(spark, sf_dir)
    files.write_jsonl(r.where("doc_id % 2 = 0"), path)
    files.write_jsonl(r.where("doc_id % 2 = 1"), path, append=True)
    r.where("doc_id % 50 = 0").select(F.concat(F.lit("{broken "), "doc_id")).write.mode("append").text(path)
    schema = "doc_id long, text string, language string, intent string, category string, urgency int"
    good, bad = files.read_jsonl(spark, path, schema, "part-*")
    rows = files.in_order(good)
    return rows.select("doc_id", F.md5("text").alias("text_md5"), "intent", "urgency").crossJoin(F.broadcast(rows.agg((F.countDistinct("_ord") == F.max("_ord") + 1).alias("numbered")).crossJoin(bad.agg(F.count("*").alias("malformed")))))


@query
def io_seed_csv(spark, sf_dir):
    path, r = shared_path(spark, "csv"), _seed_rows(spark, sf_dir).select(F.col("row").cast("string").alias("id"), "text", "intent", "urgency_level", F.lit(1).alias("extra"))
    files.append_seed_csv(r.where("urgency_level <= 2"), path)
    files.append_seed_csv(r.where("urgency_level > 2"), path)
    return files.read_seed_csv(spark, path).select("id", F.md5("text").alias("text_md5"), "intent", "urgency_level", F.coalesce("split", F.lit("")).alias("split"))


@query
def io_index(spark, sf_dir):
    path, e = shared_path(spark, "index"), _read(spark, sf_dir, "embeddings")
    files.write_index(e.select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("chunk "), "vec_id").alias("text"), "embedding"), path)
    files.write_chunks(files.read_index(spark, path), f"{path}-chunks")
    return files.read_index(spark, path).join(spark.read.schema("chunk_id long, text string").json(f"{path}-chunks"), ["chunk_id", "text"]).select("chunk_id", "text", F.size("embedding").alias("width"), F.lit(files.read_index(spark, f"{path}-none").count()).alias("missing"))


@query
def io_document(spark, sf_dir):
    """Documents replaced twice, the second time by a part of them as they were read: the backup holds those before."""
    path, kb = shared_path(spark, "document"), fixtures.knowledge(spark, sf_dir)
    none = spark.createDataFrame([], "id string")
    for version in ("1", "2"):
        files.replace_document(retrieval.enrich(kb, none, meta={"version": version}), path, f"{path}-backup")
    some = files.read_document(spark, path, retrieval.KB_SCHEMA, lines=True).where(F.col("_meta")["doc"].cast("long") % 3 != 0)
    files.replace_document(retrieval.enrich(some, none, meta={"version": "3"}), path, f"{path}-backup")
    now, old = (files.read_document(spark, p, retrieval.KB_SCHEMA, lines=True).select(F.col("_meta")["doc"].cast("long").alias("doc_id"), F.col("_meta")["version"].alias("version"), F.md5(F.array_join(F.array_sort(F.transform(F.map_entries("stressor_taxonomy"), lambda e: F.concat_ws(":", e["key"], e["value"]["label"], e["value"]["description"]))), "|")).alias("md5")) for p in (path, f"{path}-backup"))
    old = old.select("doc_id", F.col("version").alias("before"), F.col("md5").alias("old_md5"))
    return old.join(now, "doc_id", "left").select("doc_id", "before", F.col("version").alias("now"), (F.col("md5") == F.col("old_md5")).alias("same"))


@query
def io_json_fields(spark, sf_dir):
    """JSON lines with missing, null and wrong-typed fields, read once and validated, tolerantly and strictly; lines that are no objects apart."""
    path, r, i = shared_path(spark, "fields"), fixtures.records(spark, sf_dir), F.col("doc_id")
    field = lambda name, value: F.concat(F.lit(f', "{name}": '), value)
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    line = F.concat(
        F.lit('{"doc_id": '), i.cast("string"), F.lit(', "text": "'), F.md5("text"), F.lit('"'), F.when(i % 5 == 0, "").when(i % 5 == 1, field("intent", F.lit("null"))).otherwise(field("intent", quoted(F.col("intent")))),
        F.when(i % 7 == 0, "").when(i % 7 == 1, field("category", F.lit("7"))).otherwise(field("category", quoted(F.col("category")))),
        F.when(i % 11 == 0, "").when(i % 11 == 1, field("urgency", F.lit("[1]"))).when(i % 11 == 2, field("urgency", F.lit('"4"'))).when(i % 11 == 3, field("urgency", F.lit("null"))).otherwise(field("urgency", F.col("urgency").cast("string"))),
        F.lit("}"),
    )
    r.select(F.when(i % 13 == 0, "[1, 2]").when(i % 13 == 1, F.concat(F.lit("{broken "), i.cast("string"))).otherwise(line)).write.text(path)
    good, bad = files.read_jsonl(spark, path, "doc_id long, text string, intent string, category string, urgency int, language string", "part-*", variants=True)
    lacks = {f: files.lacks(f) for f in (*labels.REQUIRED, "language")}
    given = good.withColumns({"lacks_intent": files.lacks("intent"), "null_intent": files.is_null("intent"), "kind": F.coalesce(files.kind_of("urgency"), F.lit("-"))})
    tolerant = labels.validate(given, missing=lacks).select("doc_id", "lacks_intent", "null_intent", "kind", "intent", "category", "urgency", _joined(F.slice("_corrections", 1, 3)).alias("corrections"))
    strict = labels.validate(given, True, lacks).select("doc_id", F.coalesce("_drop_reason", F.lit("")).alias("reason"))
    return tolerant.join(strict, "doc_id").crossJoin(F.broadcast(bad.agg(F.count("*").alias("malformed"))))


@query
def curate_two_batches(spark, sf_dir):
    """The whole flow over files, twice: the second batch holds copies of the first, which its store of fingerprints knows."""
    raw, out, r = shared_path(spark, "raw"), shared_path(spark, "curated"), fixtures.records(spark, sf_dir).where("doc_id % 4 > 0")
    for name, rows in (("one", r.where("doc_id % 4 < 3")), ("two", r.where("doc_id % 4 > 1"))):
        rows.select(F.to_json(F.struct("text", "language", "intent", "category", "urgency")).alias("value")).write.option("compression", "none").text(f"{raw}/{name}")
        curation.run(spark, f"{raw}/{name}", out, glob="part-*")
    final = files.read_jsonl(spark, f"{out}/final", files.RAW_SCHEMA, "part-*")[0]
    return dedup.with_fingerprint(final).groupBy("_fingerprint").agg(F.count("*").alias("n")).select(F.col("_fingerprint").alias("fp"), "n")


@query
def io_turn_log(spark, sf_dir):
    """The log of all turns, appended turn by turn and read again."""
    path = shared_path(spark, "turns")
    results, _, said = _flow(spark, sf_dir)
    for k in [r[0] for r in said.select("k").distinct().orderBy("k").collect()]:  # one row for each turn of the longest conversation
        files.append_turns(flow.log_rows(results.where(F.col("k") == k), said.where(F.col("k") == k), f"2024-01-01T00:00:{k:02d}"), path, k)
    log = files.read_turns(spark, path)
    return talk.summary(log, "session_id").join(log.groupBy("session_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "timestamp", "user", "response", "emotion", "rag_chunks"))), "\n")).alias("log_md5")), "session_id")


@query
def turn_flow(spark, sf_dir):
    results, _, _ = _flow(spark, sf_dir)
    return results.select("conv_id", "k", "response", "emotion", "intent", "stressor", "urgency", "risk", "risk_action", "risk_source", "crisis_exit", _joined("strategy").alias("strategies"), "parse_strategy", "rag_chunks")


@query
def turn_state(spark, sf_dir):
    _, state, _ = _flow(spark, sf_dir)
    said = F.md5(F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n"))
    return state.select("conv_id", "turn_count", F.size("history").alias("n_history"), said.alias("history_md5"), _joined("emotion_arc").alias("arc"), "arc_length", F.coalesce("last_stressor", F.lit("")).alias("last_stressor"))


@query
def parse_events_props(spark, sf_dir):
    return _read(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query
def parse_records(spark, sf_dir):
    r = fixtures.records(spark, sf_dir)
    item = F.to_json(F.struct(F.replace("text", F.lit("]"), F.lit(")")).alias("text"), F.when(F.col("doc_id") % 2 == 0, F.col("intent")).alias("intent"), (F.col("doc_id") % 9).alias("urgency")))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Sure: ["), item, F.lit("] done"))).otherwise("no array here")
    out = parse.records(r.select("doc_id", raw.alias("raw"), F.lit("casual_chat").alias("intent"), F.lit("neutral").alias("category")))
    return out.select("doc_id", F.md5("text").alias("text_md5"), "intent", "category", "urgency", "language")


@query
def parse_seed_records(spark, sf_dir):
    r = fixtures.records(spark, sf_dir)
    i = F.col("doc_id")
    item = F.to_json(F.struct(F.md5("text").alias("text"), F.when(i % 2 == 0, F.lit("seek_validation")).alias("intent"), F.when(i % 3 == 0, "guilt,odd, anger,fear,hope,love").otherwise("odd").alias("emotions"), (i % 9).alias("urgency_level")))
    raw = F.when(i % 4 == 0, F.concat(F.lit("```json\n["), item, F.lit("]\n```"))).when(i % 4 == 1, F.concat(F.lit("note [1]: [ "), item, F.lit(" ] done"))).when(i % 4 == 2, '[{"text": "too short"}]').otherwise("no array")
    return parse.seed_records(r.select("doc_id", raw.alias("raw"), F.lit("unclear").alias("intent"), F.lit("en").alias("language"))).select("doc_id", "text", "intent", "emotions", "urgency_level", "language", "script")


def _raw_reply():
    i = F.col("doc_id")
    meta = F.concat(F.lit("emotion = "), F.when(i % 4 == 0, "calm").otherwise("fear"), F.lit("\nurgency="), (i % 8).cast("string"), F.lit("\nRISK= "), F.when(i % 5 == 0, "high").otherwise((i % 6).cast("string")), F.lit("\nstrategy=a, b ,,c\nemotion="), F.when(i % 4 == 0, "hope").otherwise("fear"))
    body = F.concat(F.lit("Sure! [VALIDATION] I hear this "), F.repeat(F.lit("word "), (i % 200).cast("int")))
    return F.when(i % 3 == 0, F.concat(F.lit("---RESPONSE---\n"), body, F.lit("\n---METADATA---\n"), meta)).when(i % 3 == 1, F.concat(F.lit("x ---response--- "), body, F.lit("\n"), meta)).otherwise(body)


@query
def parse_metadata_kv(spark, sf_dir):
    out = parse.reply(_read(spark, sf_dir, "documents").select("doc_id", _raw_reply().alias("raw")))
    return out.select("doc_id", "emotion", "intent", "urgency", "risk", _joined("strategy").alias("strategies"), "parse_strategy", "response")


@query
def parse_risk_scores(spark, sf_dir):
    i = F.col("doc_id")
    raw = F.concat(F.lit('Here: {"risk_level": '), (i % 8).cast("string"), F.lit(', "tier": "'), F.when(i % 3 == 0, "odd").otherwise("tier_2"), F.lit('", "safeguarding": '), F.when(i % 2 == 0, "true").otherwise("false"), F.lit(', "reason": "because"}'))
    raw = F.when(i % 10 == 0, "nothing").otherwise(raw)
    return _read(spark, sf_dir, "documents").select("doc_id", parse.risk_score(raw).alias("r")).select("doc_id", "r.*")


@query
def parse_emotion_lists(spark, sf_dir):
    i = F.col("doc_id")
    given = F.when(i % 3 == 0, "guilt, Anger,odd ,fear,hope,love").when(i % 3 == 1, "odd").otherwise("shame")
    return _read(spark, sf_dir, "documents").select("doc_id", parse.emotion_list(given).alias("emotions"), parse.truthy(F.when(i % 2 == 0, "True").otherwise("no")).alias("mixed"))


def _token_lines(e):
    line = F.when(F.col("event_id") % 13 == 0, "not json").otherwise(F.concat(F.lit('{"response": "'), F.substring("event_type", 1, 1), F.lit('", "done": '), F.when(F.col("event_id") % 97 == 0, "true").otherwise("false"), F.lit("}")))
    return e.select("user_id", "event_id", line.alias("line"))


@query
def parse_token_stream(spark, sf_dir):
    return parse.stream_text(_token_lines(_read(spark, sf_dir, "events")), "user_id", "event_id")


@query
def stream_tokens(spark, sf_dir):
    """The same lines as a stream: texts of the finished ones, and of those that the state holds open."""
    done, rest = tokens.run(_token_lines(_stream(spark, sf_dir, "events")), "user_id", "event_id")
    return done.unionByName(rest).select(F.col("key").alias("user_id"), "text")


@query
def sql_records(spark, sf_dir):
    """parse_records in SQL alone, by a table function in a lateral join."""
    sql.register(spark)
    fixtures.records(spark, sf_dir).createOrReplaceTempView("gm_documents")
    return spark.sql("""
        WITH i AS (SELECT doc_id, to_json(named_struct('text', replace(text, ']', ')'), 'intent', CASE WHEN doc_id % 2 = 0 THEN intent END, 'urgency', doc_id % 9)) AS item FROM gm_documents),
        r AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat('```json\\n[', item, ']\\n```') WHEN 1 THEN concat('Sure: [', item, '] done') ELSE 'no array here' END AS raw FROM i)
        SELECT r.doc_id, md5(x.text) AS text_md5, x.intent, x.category, x.urgency, x.language FROM r, LATERAL gm_records(r.raw, 'casual_chat', 'neutral') x""")


@query
def sql_fingerprints(spark, sf_dir):
    """Fingerprints, words and their overlap with the language's shortest document, in SQL alone."""
    sql.register(spark)
    _read(spark, sf_dir, "documents").createOrReplaceTempView("gm_raw_documents")
    return spark.sql("SELECT doc_id, gm_fingerprint(text) AS fp, gm_seed_fingerprint(text) AS seed_fp, size(gm_words(text)) AS n_words, round(gm_overlap(gm_words(lower(text)), array('the', 'of', 'and', 'der', 'la')), 6) AS overlap FROM gm_raw_documents")


@query
def class_weights(spark, sf_dir):
    w = metrics.class_weights(fixtures.records(spark, sf_dir))
    return w.select("label", "n", F.round("weight", 6).alias("weight"))


@query
def label_index(spark, sf_dir):
    r = fixtures.records(spark, sf_dir)
    return r.select("doc_id", metrics.intent_index(F.when(F.col("doc_id") % 9 == 0, "odd").otherwise(F.col("intent"))).alias("intent_idx"), metrics.category_index(F.col("category")).alias("category_idx"))


@query
def ordinal_encode(spark, sf_dir):
    u = (F.col("doc_id") % 5 + 1).cast("int")
    bits = metrics.ordinal(u)
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(bits, ",").alias("bits"), metrics.ordinal_level(F.transform(bits, lambda b: b.cast("double") - 0.5)).alias("level"))


@query
def best_labels(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    label, share = metrics.best_label(F.col("logits"), [f"label_{i}" for i in range(64)])
    return e.select("vec_id", label.alias("label"), share.alias("confidence"))


@query
def accuracy(spark, sf_dir):
    return metrics.accuracy(fixtures.predictions(spark, sf_dir), "true_intent", "pred_intent")


@query
def macro_f1(spark, sf_dir):
    return metrics.macro_f1(fixtures.predictions(spark, sf_dir), "true_intent", "pred_intent", INTENTS)


@query
def per_class_f1(spark, sf_dir):
    return metrics.worst_first(metrics.per_class(fixtures.predictions(spark, sf_dir), "true_intent", "pred_intent", INTENTS))


@query
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_read(spark, sf_dir, "labels"), "quality", "toxic", [0, 1]).withColumnsRenamed({"0": "pred_0", "1": "pred_1"})


@query
def urgency_mae(spark, sf_dir):
    return metrics.urgency_errors(fixtures.predictions(spark, sf_dir), "true_urgency", "pred_urgency")


@query
def urgency_missed(spark, sf_dir):
    return metrics.missed_urgent(fixtures.predictions(spark, sf_dir), "true_urgency", "pred_urgency")


@query
def error_pairs(spark, sf_dir):
    return metrics.error_pairs(fixtures.predictions(spark, sf_dir), "true_intent", "pred_intent", "text", "doc_id")


@query
def urgency_distribution(spark, sf_dir):
    return metrics.level_counts(fixtures.predictions(spark, sf_dir), "true_urgency", "pred_urgency")


@query
def train_val_split(spark, sf_dir):
    return metrics.train_val(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def stratified_split(spark, sf_dir):
    return metrics.stratified(_read(spark, sf_dir, "labels"), "doc_id", "quality", {"train": 0.8, "val": 0.1, "test": 0.1}).select("doc_id", "split")


@query
def evaluation_sample(spark, sf_dir):
    from grainmill.sources.files import evaluation_records

    return evaluation_records(_read(spark, sf_dir, "labels"), "doc_id", 50).select("doc_id", "quality")


def _epochs(spark, sf_dir):
    """The events as one log of training runs: a run for each user."""
    e = _read(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.round(1 - 1 / (1 + F.col("event_id") % 12), 4).alias("score"), (F.col("event_id") * 0.1).alias("a"))


@query
def early_stopping(spark, sf_dir):
    return metrics.early_stopping(_epochs(spark, sf_dir), run="run").select("run", "epoch", "best_so_far", "improved", "stale", "stopped")


@query
def joint_loss(spark, sf_dir):
    return _epochs(spark, sf_dir).select("epoch", F.round(metrics.joint_loss(F.col("score"), F.col("a"), F.lit(0.5)), 6).alias("loss"), metrics.warmup_steps(F.col("epoch") * 7).alias("warmup"))


@query
def events_tumbling(spark, sf_dir):
    return _read(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.unix_timestamp(F.col("window.start")).alias("start"), "event_type", "n")


@query
def events_session(spark, sf_dir):
    e = _read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    return e.select("user_id", F.unix_micros("s.start").alias("start"), "n")


@query
def retention_30d(spark, sf_dir):
    return streams.retained(_read(spark, sf_dir, "events"), days=30, now="2024-02-10 00:00:00").groupBy("event_type").agg(F.count("*").alias("n"))


@query
def stream_tumbling(spark, sf_dir):
    source = _stream(spark, sf_dir, "events")
    return streams.to_latest(streams.windowed_counts(source.withColumn("ts", F.col("ts").cast("timestamp"))), "start", "event_type").select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query
def stream_session_state(spark, sf_dir):
    source = _stream(spark, sf_dir, "conversations")
    felt = affect.detect(source).select("conv_id", "turn", "primary_emotion", "stressor_type")
    return streams.to_table(streams.session_state(felt))


def _talk_stream(spark, sf_dir):
    """Conversations as a stream with signals, and a reset behind the second row of every third; a row's place is twice its turn."""
    felt = affect.detect(_stream(spark, sf_dir, "conversations")).select("conv_id", (F.col("turn") * 2).alias("turn"), "role", "text", "primary_emotion", "stressor_type")
    ends = _stream(spark, sf_dir, "conversations").where("turn = 1 AND conv_id % 3 = 0").select("conv_id", F.lit(3).cast(felt.schema["turn"].dataType).alias("turn"), F.lit(conversations.RESET).alias("role"), F.lit("").alias("text"), F.lit("").alias("primary_emotion"), F.lit("").alias("stressor_type"))
    return felt, ends


@query
def stream_turns(spark, sf_dir):
    """The state behind every row of the conversations, kept by session in a state store."""
    return conversations.run(_talk_stream(spark, sf_dir)[0])[0]


@query
def session_get(spark, sf_dir):
    """The sessions as they stand in the state store when the stream has ended."""
    state = conversations.session_get(spark, conversations.run(_talk_stream(spark, sf_dir)[0])[1])
    said = F.md5(F.array_join(F.transform("history", lambda m: F.concat_ws(":", m["role"], m["text"])), "\n"))
    return state.select("conv_id", "turn_count", F.size("history").alias("n_history"), said.alias("history_md5"), _joined("emotion_arc").alias("arc"), "arc_length", "last_stressor")


@query
def session_reset(spark, sf_dir):
    """The same stream with reset rows in it: what follows begins anew."""
    felt, ends = _talk_stream(spark, sf_dir)
    return conversations.run(felt.unionByName(ends))[0]


@query
def stream_curated(spark, sf_dir):
    source = _stream(spark, sf_dir, "documents")
    raw = source.select("doc_id", "text", F.lit("en").alias("language"), F.lit("casual_chat").alias("intent"), F.lit("neutral").alias("category"), F.lit(1).alias("urgency"), F.timestamp_seconds(F.lit(1_700_000_000)).alias("ts"))
    return streams.to_table(streams.curated_stream(raw, "ts")).select("_fingerprint")


@query
def user_last_event(spark, sf_dir):
    return dedup.first_by(_read(spark, sf_dir, "events").withColumn("neg", -F.col("event_id")), "user_id", "neg").select("user_id", "event_id")

