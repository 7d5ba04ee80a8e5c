"""Token streams of models, as NDJSON lines that arrive over many batches: pieces are kept in order by stream until one says done."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from grainmill.sources.scratch import shared_path
from grainmill.streaming.conversations import keyed

OUTPUT = "key long, text string"


class Tokens(StatefulProcessor):
    """`pieces`: what a stream has given so far; `closed`: that it has said done, after which its lines are passed over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "at long, piece string")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        if self.closed.exists():
            return
        new = pd.concat(list(rows)).sort_values("at", kind="stable")
        done = new["done"].to_numpy().nonzero()[0]
        if len(done):
            new = new.iloc[: done[0] + 1]
        said = [(int(a), p) for a, p in zip(new["at"], new["piece"], strict=True) if p]
        if not len(done):
            self.pieces.appendList(said)
            return
        text = "".join(p for _, p in [*self.pieces.get(), *said])
        self.pieces.clear()
        self.closed.update((True,))
        yield pd.DataFrame({"key": [key[0]], "text": [text]})

    def close(self) -> None:
        pass


def token_texts(lines: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """key, text: the joined pieces of each stream (a long) when it says done. Lines that do not parse are passed over.

    Within a batch lines go by `order`; batches come in that order. Streams that are not done stay in the state.
    """
    o = F.from_json(F.col(line), "struct<response: string, message: struct<content: string>, done: boolean>")
    rows = lines.select(F.col(key).cast("long").alias("key"), F.col(order).cast("long").alias("at"), F.coalesce(o["response"], o["message"]["content"], F.lit("")).alias("piece"), F.coalesce(o["done"], F.lit(False)).alias("done"))
    return rows.where("done OR piece != ''").groupBy("key").transformWithStateInPandas(Tokens(), OUTPUT, "append", "None")


def run(lines: DataFrame, key: str, order: str, line: str = "line", path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(finished, open) streams, key and text, when the stream of lines has given what there is."""
    spark = lines.sparkSession
    path = path or shared_path(spark, "tokens")
    keyed(token_texts(lines, key, order, line), path)
    pieces = spark.read.format("statestore").option("path", f"{path}/state").option("stateVarName", "pieces").option("flattenCollectionTypes", False).load()
    text = F.array_join(F.transform(F.array_sort("list_value"), lambda p: p["piece"]), "")
    return spark.read.schema(OUTPUT).parquet(f"{path}/rows"), pieces.select(F.col("key.key").alias("key"), text.alias("text"))
