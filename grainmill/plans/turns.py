"""One turn of many sessions at once: risk, signals, retrieval, prompt, generation, parsing, state."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.functions.taxonomy import HELPLINES
from grainmill.operators import affect, parse, retrieval, safety, sessions
from grainmill.sources import models
from grainmill.sources.files import empty
from grainmill.sources.scratch import drop_table, small, table

#: What a session carries from turn to turn: the last HISTORY messages, the last ARC emotions and how many there were. The rest is in the turn log.
STATE = "conv_id long, turn_count long, history array<struct<role: string, text: string>>, emotion_arc array<string>, arc_length long, last_stressor string"


class Answered(NamedTuple):
    results: DataFrame
    state: DataFrame


def new_state(spark: SparkSession) -> DataFrame:
    return empty(spark, STATE)


def session_of(state: DataFrame, conv_id: int) -> DataFrame:
    """The state of one session; no row if there is none."""
    return state.where(F.col("conv_id") == conv_id)


def reset(state: DataFrame, conv_ids: DataFrame) -> DataFrame:
    """The state without the sessions of conv_ids (conv_id): their next turn is a first one."""
    return state.join(conv_ids.select("conv_id").distinct(), "conv_id", "left_anti")


def last_of(values: Column, most: int) -> Column:
    return F.slice(values, F.greatest(F.lit(1), F.size(values) - most + 1), F.lit(most))


def _scored(df: DataFrame, scorer: Callable[[], models.Generate] | None, kb: DataFrame, template: str) -> DataFrame:
    """df with _gm_score, the parsed answer of a risk scorer to the template, the last turns that it is shown, the message and its number; safe without a scorer."""
    if scorer is None:
        return df.withColumn("_gm_score", parse.risk_score(F.lit("")))
    said = F.transform(last_of(F.col("history"), sessions.SHOWN), lambda t: F.concat(F.when(t["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring(t["text"], 1, sessions.SCORED_CHARS)))
    before = F.when(F.size("history") > 0, F.concat(F.lit("Earlier turns:\n"), F.array_join(said, "\n"), F.lit("\n\n"))).otherwise("")
    asked = df.crossJoin(small(safety.risk_prompt(kb.limit(1), template), KB_BYTES))  # one row
    asked = asked.withColumn("_gm_ask", F.concat("risk_prompt", F.lit("\n\n"), before, F.lit("Message to judge:\n"), F.col("text"), F.lit("\n\nTurn "), F.col("turn_count").cast("string"))).drop("risk_prompt")
    return models.generate(asked, "_gm_ask", scorer, "_gm_raw").withColumn("_gm_score", parse.risk_score(F.col("_gm_raw"))).drop("_gm_ask", "_gm_raw")


#: What a knowledge base document is taken to be wide at most, when it is sent along.
KB_BYTES = 1 << 20


def answer(turns: DataFrame, state: DataFrame, kb: DataFrame, index: DataFrame, embed: Callable[[], models.Embed], generate: Callable[[], models.Converse], instructions: dict[str, str], *,
           scorer: Callable[[], models.Generate] | None = None, score_template: str = "{phrases}\n{stressors}\n{idioms}", profiles: DataFrame | None = None, replies: dict[str, str] = safety.EXIT_REPLIES) -> Answered:
    """The results of one turn of each session of `turns` (conv_id, text: one row a session), and the state after it.

    Stages: the risk cascade; a scorer of risk, if there is one; signals; chunks of `index` (chunk_id, text, embedding,
    stressor_type) for the stressor; the prompt; a reply; its parts. The model gets the prompt as the system's part, the
    last six messages of the session, and the message itself; the scorer sees the last four. Levels that exit at once get a fixed reply and skip
    the rest: they add to the history but not to the emotion arc. Level 3 goes on, with urgency 3 and a helpline in the
    prompt. profiles: conv_id, profile (lines), for the prompt. A row of results has conv_id, response, emotion, intent,
    stressor, urgency, risk, risk_action, risk_source, crisis_exit, safeguarding, helpline_name, helpline_number,
    rag_chunks, strategy, parse_strategy.

    Every stage is one pass over all sessions, models are called once a task, and what a turn needs of its session is in
    the state, which does not grow from turn to turn. Sessions without new turns keep their state. `state` is written anew
    each turn; where few of many sessions speak at a time, streaming.conversations keeps it by key.
    """
    none = F.array().cast("array<string>")
    held = turns.select("conv_id", F.coalesce("text", F.lit("")).alias("text")).join(state, "conv_id", "left")
    held = held.withColumns({"turn_count": F.coalesce("turn_count", F.lit(0)) + 1, "history": F.coalesce("history", F.array().cast("array<struct<role: string, text: string>>")), "emotion_arc": F.coalesce("emotion_arc", none), "arc_length": F.coalesce("arc_length", F.lit(0))})
    risky = _scored(safety.assess(held), scorer, kb, score_template)
    at_once = safety.hard_exit(F.col("risk_level"))
    scored = ~at_once & safety.hard_exit(F.col("_gm_score.risk_level"))
    line = safety.score_helpline(F.col("_gm_score.helpline_key"), F.col("_gm_score.safeguarding"), F.col("text"))
    risky = risky.withColumns({"_gm_exit": at_once | scored, "_gm_line": line, "_gm_level": F.when(at_once, F.col("risk_level")).otherwise(F.col("_gm_score.risk_level"))})
    risky = risky_table = table(risky.withColumns({
        "_gm_name": F.when(at_once, F.col("helpline_name")).otherwise(F.col("_gm_line.name")), "_gm_number": F.when(at_once, F.col("helpline_number")).otherwise(F.col("_gm_line.number")),
        "_gm_guard": F.when(at_once, F.col("safeguarding")).otherwise(F.col("_gm_score.safeguarding")), "_gm_source": F.when(at_once, "regex").otherwise("llm"),
    }), "turn-risk")

    exits = risky.where("_gm_exit").select(
        "conv_id", "text", "turn_count", "history", "emotion_arc", "arc_length", "last_stressor",
        safety.exit_reply(F.col("_gm_level"), F.col("_gm_name"), F.col("_gm_number"), F.col("_gm_guard"), replies).alias("response"),
        F.when(F.col("_gm_guard"), "fear").otherwise("grief").alias("emotion"), F.lit("crisis_signal").alias("intent"), F.lit("none").alias("stressor"), F.col("_gm_level").alias("urgency"), F.col("_gm_level").alias("risk"),
        safety.exit_action(F.col("_gm_level")).alias("risk_action"), F.col("_gm_source").alias("risk_source"), F.lit(True).alias("crisis_exit"), F.col("_gm_guard").alias("safeguarding"),
        F.col("_gm_name").alias("helpline_name"), F.col("_gm_number").alias("helpline_number"), F.lit(0).alias("rag_chunks"), none.alias("strategy"), F.lit("").alias("parse_strategy"),
    )

    on = affect.detect(risky.where("NOT _gm_exit").withColumn("_gm_scored", F.col("_gm_score.risk_level")))
    on = safety.combine(on.withColumn("_gm_urgency", F.when(F.greatest("risk_level", "_gm_scored") == 3, 3).otherwise(F.col("urgency_level"))), "risk_level", "_gm_scored", "_gm_urgency")
    on = on.withColumns({"emotion_arc": last_of(F.concat("emotion_arc", F.array("primary_emotion")), sessions.ARC), "arc_length": F.col("arc_length") + 1, "last_stressor": F.col("stressor_type"), "_gm_query": retrieval.query_text(F.col("stressor_type"), F.col("primary_emotion"), F.col("text"))})
    on = signals = table(models.embed(on.drop("_gm_score", "_gm_line"), "_gm_query", embed, "embedding"), "turn-signals")
    near = retrieval.top_k(index, on.select(F.col("conv_id").alias("query_id"), "embedding", "stressor_type"), wanted="stressor_type")
    found = near.drop("stressor_type").join(index.select("chunk_id", F.col("text").alias("_gm_chunk")), "chunk_id").groupBy(F.col("query_id").alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_gm_chunk"))), lambda x: x["_gm_chunk"]).alias("chunks"))
    on = on.drop("embedding").join(found, "conv_id", "left")
    if profiles is not None:
        on = on.join(profiles.select("conv_id", "profile"), "conv_id", "left")
    tier_3 = HELPLINES["tier_3"]
    arc = F.when(F.col("arc_length") >= 3, F.array_join("emotion_arc", " → "))
    asked = on.select(
        "conv_id", "text", "turn_count", "history", "emotion_arc", "arc_length", "last_stressor", "lang_code", "idioms_detected", "stigma_flag", "risk_action", "risk_source", F.coalesce("chunks", none).alias("chunks"), arc.alias("arc"),
        F.col("primary_emotion").alias("emotion"), "intent", F.col("stressor_type").alias("stressor"), F.col("_gm_urgency").alias("urgency"), F.col("effective_risk").alias("risk"), F.col("cbt_technique").alias("technique"),
        F.when(F.col("effective_risk") == 3, f"{tier_3[0]} ({tier_3[1]})").otherwise("").alias("helpline_note"), *(["profile"] if profiles is not None else []),
    )
    asked = sessions.prompt(sessions.with_knowledge(asked, kb), instructions).withColumns({f"_gm_{c}": F.col(c) for c in ("emotion", "intent", "stressor", "urgency", "risk")})
    asked = asked.withColumn("_gm_messages", F.concat(last_of(F.col("history"), sessions.HISTORY), F.array(F.struct(F.lit("user").alias("role"), F.col("text").alias("text")))))
    said = models.converse(asked.drop("emotion", "intent", "stressor", "urgency", "risk"), "prompt", "_gm_messages", generate, "_gm_reply")
    said = parse.reply(said, "_gm_reply", {c: F.col(f"_gm_{c}") for c in ("emotion", "intent", "stressor", "urgency", "risk")})
    going = said.withColumns({"crisis_exit": F.lit(False), "safeguarding": F.lit(False), "helpline_name": F.lit(""), "helpline_number": F.lit(""), "rag_chunks": F.size("chunks")})

    every = table(exits.unionByName(going.select(exits.columns)), "turn")
    for t in (risky_table, signals):
        drop_table(t)
    say = lambda role, text: F.struct(F.lit(role).alias("role"), F.col(text).alias("text"))
    now = every.select("conv_id", F.col("turn_count").cast("long").alias("turn_count"), last_of(F.concat("history", F.array(say("user", "text"), say("assistant", "response"))), sessions.HISTORY).alias("history"), "emotion_arc", F.col("arc_length").cast("long").alias("arc_length"), "last_stressor")
    kept = state.join(every.select("conv_id"), "conv_id", "left_anti")
    return Answered(every.drop("text", "turn_count", "history", "emotion_arc", "arc_length", "last_stressor"), table(kept.unionByName(now), "state"))


def log_rows(results: DataFrame, turns: DataFrame, timestamp: str) -> DataFrame:
    """Rows of the turn log for the results of a turn."""
    return results.join(turns.select("conv_id", F.col("text").alias("user")), "conv_id").select(
        F.lit(timestamp).alias("timestamp"), F.col("conv_id").cast("string").alias("session_id"), "user", "response", "emotion", "intent", "stressor", "urgency", "risk", "rag_chunks", "crisis_exit", "parse_strategy"
    )
