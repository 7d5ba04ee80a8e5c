"""Conversation state as windows: running counts, histories, emotion arcs, profiles, summaries, prompts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.taxonomy import HELPLINES, SOCIAL_INTENTS, TENDER_EMOTIONS
from grainmill.sources.scratch import small

HISTORY, SHOWN, SHOWN_CHARS, SCORED_CHARS, ARC = 6, 4, 120, 250, 4


def _turns(session: str, order: str):
    return Window.partitionBy(session).orderBy(order)


def numbered(df: DataFrame, session: str = "conv_id", order: str = "turn") -> DataFrame:
    return df.withColumn("turn_count", F.row_number().over(_turns(session, order)))


def history(df: DataFrame, session: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text", last: int = HISTORY, chars: int | None = None) -> DataFrame:
    """df with history: up to `last` earlier turns of the session as (role, text), oldest first."""
    said = F.col(text) if chars is None else F.substring(text, 1, chars)
    before = _turns(session, order).rowsBetween(-last, -1)
    return df.withColumn("history", F.collect_list(F.struct(F.col(role).alias("role"), F.coalesce(said, F.lit("")).alias("text"))).over(before))


def emotion_arc(df: DataFrame, session: str = "conv_id", order: str = "turn", emotion: str = "primary_emotion", ended: str | None = None) -> DataFrame:
    """df with arc_length and arc (the last four emotions joined, null below three). Turns that `ended` at once add nothing."""
    felt = F.when(~F.coalesce(F.col(ended), F.lit(False)), F.col(emotion)) if ended else F.col(emotion)
    so_far = _turns(session, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_gm_felt", felt).withColumn("arc_length", F.count("_gm_felt").over(so_far))
    # Four rows back among the turns that add; the others take the last of those.
    added = Window.partitionBy(session, F.col("_gm_felt").isNull()).orderBy(order).rowsBetween(-(ARC - 1), 0)
    df = df.withColumn("_gm_arc", F.when(F.col("_gm_felt").isNotNull(), F.collect_list("_gm_felt").over(added)))
    recent = F.last("_gm_arc", ignorenulls=True).over(so_far)
    return df.withColumn("arc", F.when(F.col("arc_length") >= 3, F.array_join(recent, " → "))).drop("_gm_felt", "_gm_arc")


def last_stressor(df: DataFrame, session: str = "conv_id", order: str = "turn", stressor: str = "stressor_type") -> DataFrame:
    return df.withColumn("last_stressor", F.last(stressor, ignorenulls=True).over(_turns(session, order).rowsBetween(Window.unboundedPreceding, 0)))


def profiles(df: DataFrame, known: DataFrame | None = None, session: str = "conv_id", order: str = "turn", emotion: str = "primary_emotion", most: int = 10) -> DataFrame:
    """session, recurring_stressors: known ones and the session's emotions but neutral, without repeats, in order of first sight, the last `most`."""
    seen = df.where(F.col(emotion) != "neutral").groupBy(session).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, emotion))), lambda x: x[emotion]).alias("_new"))
    if known is not None:
        seen = seen.join(known.select(session, F.col("recurring_stressors").alias("_old")), session, "full")
    else:
        seen = seen.withColumn("_old", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<string>")
    both = F.array_distinct(F.concat(F.coalesce("_old", none), F.coalesce("_new", none)))
    return seen.withColumn("_all", both).select(session, F.slice("_all", F.greatest(F.lit(1), F.size("_all") - most + 1), F.lit(most)).alias("recurring_stressors"))


def resolved(call: Column, session: Column, default: Column) -> Column:
    return F.coalesce(call, session, default)


def summary(log: DataFrame, session: str | None = None) -> DataFrame:
    """Turns, crisis_exits, avg_chunks (one decimal) of a turn log, for each session or in all."""
    aggs = [F.count("*").alias("turns"), F.sum(F.col("crisis_exit").cast("int")).alias("crisis_exits"), F.round(F.avg("rag_chunks"), 1).alias("avg_chunks")]
    return log.groupBy(session).agg(*aggs) if session else log.agg(*aggs)


def intent_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("intent").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "intent")


def mode(risk: Column, intent: Column, urgency: Column, emotion: Column) -> Column:
    """The response mode: the first that applies."""
    return F.when(risk >= 4, "crisis").when(intent.isin(SOCIAL_INTENTS), "social").when(urgency >= 4, "high_distress").when(emotion.isin(TENDER_EMOTIONS), "emotional").when(intent == "greeting", "greeting").otherwise("normal")


def _block(title: str, lines: Column) -> Column:
    """A titled block of lines; empty without lines."""
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, F.concat(F.lit(f"\n### {title}\n"), F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")


#: Wording of the blocks that depend on risk and stigma; a deployment passes its own. {name}, {number}, {risk}, {note} and {rule} are filled in.
WORDING = {
    "crisis": "\n### Crisis, risk {risk} of 5\nName the pain, say that it is real, ask whether the person is safe, mention {name} ({number}), stay in the conversation.\n",
    "helpline": "\n### Support\nIf the moment allows, mention {note} as someone who listens; the conversation goes on.\n",
    "stigma": "\n### Stigma\n{rule}\n",
    "output": "\n### Output\n---RESPONSE---\n---METADATA---\n",
}


def with_knowledge(df: DataFrame, kb: DataFrame) -> DataFrame:
    """df with notes, never_say, guardrails, idiom_notes and stigma_rule of its stressor, idioms_detected and stigma_flag, from one knowledge base document.

    What the document lacks gives empty lists. The document is one row, which is sent along.
    """
    one = kb.limit(1).select(F.struct("stressor_taxonomy", "guardrail_registry", "cultural_idioms").alias("_gm_kb"))
    none = F.array().cast("array<string>")
    of = F.col("_gm_kb.stressor_taxonomy")[F.col("stressor")]
    idiom = lambda i: F.col("_gm_kb.cultural_idioms")[i]
    told = lambda i: F.concat(F.lit("'"), i, F.lit("' ("), F.coalesce(idiom(i)["translation"], F.lit("")), F.lit(") — "), F.substring(F.coalesce(idiom(i)["meaning"], F.lit("")), 1, 80))
    rules = F.filter(F.transform(F.coalesce(of["guardrails"], none), lambda g: F.col("_gm_kb.guardrail_registry")[g]), lambda g: g.isNotNull())
    return (
        df.crossJoin(small(one, 1 << 20))
        .withColumns({
            "notes": F.coalesce(of["cultural_context_notes"], none), "never_say": F.coalesce(of["what_not_to_say"], none), "guardrails": rules,
            "idiom_notes": F.transform(F.filter(F.coalesce("idioms_detected", none), lambda i: idiom(i).isNotNull()), told),
            "stigma_rule": F.when(F.col("stigma_flag"), F.col("_gm_kb.guardrail_registry")[F.lit("stigma_bypass_active")]),
        })
        .drop("_gm_kb")
    )


def prompt(df: DataFrame, instructions: dict[str, str], preamble: str = "", wording: dict[str, str] = WORDING) -> DataFrame:
    """df with mode, word_cap and prompt, assembled from optional columns that are empty arrays or null where there is nothing to say.

    Reads emotion, intent, stressor, urgency, risk, lang_code, technique, and (if there) notes, never_say, guardrails,
    idiom_notes, stigma_rule, arc, chunks, history (role, text), profile, helpline_note, helpline_name and
    helpline_number. From risk 4 on the crisis block names a helpline (a default where none is given); below, a
    helpline_note has its own. Order of blocks: signals, crisis, culture, guardrails, technique, stigma, idioms, pattern,
    context, recent turns, profile, mode, length, helpline, output. Limits: 3 notes, 3 phrases never to say, 2 guardrails of
    120 characters, chunks of 200 characters, the last 4 turns of 120. instructions: the text of each mode.
    """
    have = set(df.columns)
    items = lambda name, make, most: F.transform(F.slice(name, 1, most), make) if name in have else F.array().cast("array<string>")
    df = df.withColumn("mode", mode(F.col("risk"), F.col("intent"), F.col("urgency"), F.col("emotion")))
    cap = F.when(F.col("risk") >= 4, 150).otherwise(120)
    guard = F.concat(items("never_say", lambda p: F.concat(F.lit('- Never say: "'), p, F.lit('"')), 3), items("guardrails", lambda g: F.concat(F.lit("- "), F.substring(g, 1, 120)), 2))
    shown = F.transform("chunks", lambda c, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit(". "), F.substring(c, 1, 200))) if "chunks" in have else F.array().cast("array<string>")
    if "history" in have:
        recent = F.slice("history", F.greatest(F.lit(1), F.size("history") - SHOWN + 1), F.lit(SHOWN))
        talk = F.transform(recent, lambda t: F.concat(F.lit("  "), F.when(t["role"] == "user", "User").otherwise("Assistant"), F.lit(": "), F.substring(t["text"], 1, SHOWN_CHARS)))
    else:
        talk = F.array().cast("array<string>")
    arc = F.when(F.col("arc").isNotNull(), F.array(F.concat(F.lit("Recent arc: "), "arc"))) if "arc" in have else F.lit(None).cast("array<string>")
    signals = F.concat(*[x for f in ("emotion", "intent", "stressor", "urgency", "risk") for x in (F.lit(f"- {f}: "), F.col(f).cast("string"), F.lit("\n"))])
    own = lambda name, default: F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(default)) if name in have else F.lit(default)
    filled = lambda block, **values: reduce(lambda text, v: F.replace(text, F.lit("{" + v[0] + "}"), v[1]), values.items(), F.lit(wording[block]))
    line = HELPLINES["tier_4"]
    crisis = F.when(F.col("risk") >= 4, filled("crisis", risk=F.col("risk").cast("string"), name=own("helpline_name", line[0]), number=own("helpline_number", line[1]))).otherwise("")
    note = own("helpline_note", "")
    support = F.when((F.col("risk") < 4) & (note != ""), filled("helpline", note=note)).otherwise("")
    rule = F.coalesce(F.col("stigma_rule"), F.lit("")) if "stigma_rule" in have else F.lit("")
    stigma = F.when(rule != "", filled("stigma", rule=rule)).otherwise("")
    by_mode = F.coalesce(*[F.when(F.col("mode") == m, text) for m, text in instructions.items()], F.lit(None).cast("string"))
    parts = [
        F.lit(preamble), F.lit("\n### Language\n"), F.col("lang_code"), F.lit("\n### Signals\n"), signals, crisis, _block("Culture", items("notes", lambda n: F.concat(F.lit("- "), n), 3)),
        _block("Guardrails", guard), F.lit("\n### Technique\n"), F.col("technique"), F.lit("\n"), stigma, _block("Idioms", items("idiom_notes", lambda n: F.concat(F.lit("- "), n), 100)),
        _block("Pattern", arc), _block("Context", shown), _block("Recent turns", talk), _block("Profile", items("profile", lambda p: F.concat(F.lit("  "), p), 3)),
        F.lit("\n### Mode\n"), F.coalesce(by_mode, F.col("mode")), F.lit("\n### Length\nAt most "), cap.cast("string"), F.lit(" words\n"), support, F.lit(wording["output"]),
    ]
    return df.withColumns({"word_cap": cap, "prompt": F.concat(*parts)})
