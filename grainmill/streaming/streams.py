"""The curation flow and conversation state over Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import LongType, StructField, StructType

from grainmill.operators import cleaning, dedup, labels
from grainmill.sources.scratch import shared_path


def read_jsonl_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.json*").json(path)


def curated_stream(raw: DataFrame, event_time: str, delay: str = "1 day") -> DataFrame:
    """Clean, new and valid records: later copies are dropped while the watermark remembers the first."""
    kept = cleaning.settled(cleaning.clean(raw)).where("_drop_reason IS NULL").drop("_drop_reason")
    new = dedup.with_fingerprint(kept).withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["_fingerprint"])
    return labels.validate(new).where("_drop_reason IS NULL").drop("_drop_reason")


def windowed_counts(events: DataFrame, event_time: str = "ts", kind: str = "event_type", width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(event_time, delay).groupBy(F.window(event_time, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, event_time: str = "ts", user: str = "user_id", gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(event_time, delay).groupBy(user, F.session_window(event_time, gap).alias("s")).agg(F.count("*").alias("n")).select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def retained(events: DataFrame, event_time: str = "ts", days: int = 30, now: str | None = None) -> DataFrame:
    """Rows of the last `days` days before now (a literal time, or the current one)."""
    limit = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    return events.where(F.col(event_time) >= limit - F.make_dt_interval(F.lit(days)))


TURN_OUTPUT = "conv_id long, turn long, turn_count long, arc string, last_stressor string"
TURN_STATE = "turn_count long, arc array<string>, last_stressor string"


def session_state(turns: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Running turn count, emotion arc (last four) and last stressor of each conv_id; with timeout_ms, state goes after that long without turns.

    Reads conv_id, turn, primary_emotion, stressor_type. Turns of one batch are folded in order. A stream with a
    timeout never runs out of work and so must not be run over "what there is".
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, arc, stressor = state.get if state.exists else (0, [], None)
        arc, rows = list(arc), []
        for r in pd.concat(list(batches)).sort_values("turn").itertuples():
            count, arc, stressor = count + 1, [*arc, r.primary_emotion][-4:], r.stressor_type if r.stressor_type is not None else stressor
            rows.append((key[0], r.turn, count, " → ".join(arc) if count >= 3 else None, stressor))
        state.update((count, arc, stressor))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "turn_count", "arc", "last_stressor"])

    return turns.groupBy("conv_id").applyInPandasWithState(fold, TURN_OUTPUT, TURN_STATE, "append", "ProcessingTimeTimeout" if timeout_ms else "NoTimeout")


def to_memory(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what there is and gives the result as a table; for tests and small backfills."""
    spark = stream.sparkSession
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def to_latest(stream: DataFrame, *keys: str) -> DataFrame:
    """Runs an aggregating stream over what there is, in update mode, and gives the last state of each of its groups.

    Append mode would hold back the groups that the watermark has not passed when the source ends; here they are
    given as they stand. Each batch of the stream replaces its own folder, so one that is run again counts once.
    """
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    keep = lambda rows, batch: rows.write.mode("overwrite").parquet(f"{path}/rows/_gm_batch={batch}")
    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in stream.columns if c not in keys]
    found = spark.read.schema(StructType([*stream.schema.fields, StructField("_gm_batch", LongType())])).parquet(f"{path}/rows")
    return found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_gm_batch").alias("_gm_last")).select(*keys, "_gm_last.*").select(*stream.columns)


def to_table(stream: DataFrame) -> DataFrame:
    """Runs an append stream over what there is into a table in the shared folder, and reads it."""
    spark = stream.sparkSession
    path = shared_path(spark, "stream")
    query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
