"""Conversation state by session over a stream: counts, the last messages and emotions, reset rows, expiry, and lookup in the state store."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grainmill.operators.sessions import ARC, HISTORY
from grainmill.sources.scratch import shared_path

#: Role of a row that ends a session; the next row begins a new one.
RESET = "reset"
OUTPUT = "conv_id long, turn long, turn_count long, arc_length long, arc string, last_stressor string"
COUNTS = "turn_count long, arc_length long, last_stressor string"
SAID = "turn long, role string, text string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Conversation(StatefulProcessor):
    """The state of a session: `counts` (a value), `arc` and `said` (lists: the last ARC emotions and HISTORY messages).

    idle_ms: state is forgotten after that long without rows, by a timer that goes on with each batch of the session; entries
    also have that time to live.
    """

    def __init__(self, idle_ms: int | None = None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getValueState("counts", COUNTS, self.idle_ms)
        self.arc = handle.getListState("arc", "emotion string", self.idle_ms)
        self.said = handle.getListState("said", SAID, self.idle_ms)

    def forget(self) -> None:
        self.counts.clear()
        self.arc.clear()
        self.said.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        count, length, stressor = self.counts.get() if self.counts.exists() else (0, 0, None)
        arc = [r[0] for r in self.arc.get()] if count else []
        narrow, texts = [], pd.DataFrame([r for r in self.said.get()] if count else [], columns=["turn", "role", "text"]).assign(old=True)
        for part in rows:
            # Of the texts only the last are held; what else a batch needs of a row is narrow.
            narrow.append(part[["turn", "role", "primary_emotion", "stressor_type"]])
            texts = pd.concat([texts, part[["turn", "role", "text"]].assign(old=False)]).sort_values(["old", "turn"], ascending=[False, True], kind="stable").tail(HISTORY + 1)
        batch = pd.concat(narrow).sort_values("turn", kind="stable")
        out, last_reset = [], None
        for turn, role, emotion, its in zip(batch["turn"].tolist(), batch["role"].tolist(), batch["primary_emotion"].tolist(), batch["stressor_type"].tolist(), strict=True):
            if role == RESET:
                count, length, stressor, arc, last_reset = 0, 0, None, [], turn
                continue
            count, length, arc = count + 1, length + 1, [*arc, emotion][-ARC:]
            stressor = its if isinstance(its, str) else stressor
            out.append((turn, count, length, " → ".join(arc) if length >= 3 else None, stressor))
        if last_reset is not None:
            texts = texts[~texts["old"] & (texts["turn"] > last_reset)]
        texts = texts[texts["role"] != RESET].tail(HISTORY)
        if count:
            self.counts.update((count, length, stressor))
            self.arc.put([(e,) for e in arc])
            self.said.put([(int(t), r, x if isinstance(x, str) else "") for t, r, x in zip(texts["turn"], texts["role"], texts["text"], strict=True)])
            if self.idle_ms:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        else:
            self.forget()
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pd.DataFrame({"conv_id": np.full(len(out), key[0], np.int64), "turn": np.array(columns[0], np.int64), "turn_count": np.array(columns[1], np.int64), "arc_length": np.array(columns[2], np.int64), "arc": pd.Series(columns[3], dtype=object), "last_stressor": pd.Series(columns[4], dtype=object)})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.forget()
        return iter(())

    def close(self) -> None:
        pass


def conversation_state(turns: DataFrame, idle_ms: int | None = None) -> DataFrame:
    """For each row of the stream `turns` (conv_id, turn, role, text, primary_emotion, stressor_type), the session's state behind it.

    Rows of a batch are taken in order of turn; a session's batches must come in that order. A row of role `reset` clears the
    session and gives no row. Null texts count as empty.
    """
    rows = turns.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), "primary_emotion", "stressor_type")
    return rows.groupBy("conv_id").transformWithStateInPandas(Conversation(idle_ms), OUTPUT, "append", "ProcessingTime" if idle_ms else "None")


def keyed(out: DataFrame, path: str) -> None:
    """Runs a stream with state by key over what there is: its rows to <path>/rows, its state to <path>/state."""
    spark = out.sparkSession
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        out.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(turns: DataFrame, path: str | None = None, idle_ms: int | None = None) -> tuple[DataFrame, str]:
    """Runs the stream over what there is: (rows of conversation_state(), folder of the query's state)."""
    spark = turns.sparkSession
    path = path or shared_path(spark, "conversations")
    keyed(conversation_state(turns, idle_ms), path)
    return spark.read.schema(OUTPUT).parquet(f"{path}/rows"), f"{path}/state"


def _variable(spark: SparkSession, state: str, name: str) -> DataFrame:
    return spark.read.format("statestore").option("path", state).option("stateVarName", name).option("flattenCollectionTypes", False).load()


def session_get(spark: SparkSession, state: str, conv_ids: DataFrame | None = None) -> DataFrame:
    """The live sessions of a query's state (of conv_ids, if given), as plans.turns has them: conv_id, turn_count, history (role, text), emotion_arc, arc_length, last_stressor.

    Read through the state data source, as of the last batch; no stream needs to run.
    """
    counts = _variable(spark, state, "counts").select(F.col("key.conv_id").alias("conv_id"), "value.*")
    arc = _variable(spark, state, "arc").select(F.col("key.conv_id").alias("conv_id"), F.transform("list_value", lambda x: x["emotion"]).alias("emotion_arc"))
    said = _variable(spark, state, "said").select(F.col("key.conv_id").alias("conv_id"), F.transform("list_value", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("history"))
    if conv_ids is not None:
        counts = counts.join(conv_ids.select("conv_id").distinct(), "conv_id", "left_semi")
    return counts.join(arc, "conv_id", "left").join(said, "conv_id", "left").select("conv_id", "turn_count", "history", "emotion_arc", "arc_length", "last_stressor")
