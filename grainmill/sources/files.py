"""Readers and writers: JSON lines, CSV, nested documents, vector tables, turn logs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.taxonomy import SEED_COLUMNS
from grainmill.sources.runs import exists, move, names, remove
from grainmill.sources.scratch import small, table

META = "struct<model: string, batch_id: string, prompt_hash: string, generated_at: string>"
RAW_SCHEMA = f"text string, intent string, category string, urgency int, language string, _meta {META}"
TURN_LOG_SCHEMA = "timestamp string, session_id string, user string, response string, emotion string, intent string, stressor string, urgency int, risk int, rag_chunks int, crisis_exit boolean, parse_strategy string"
SEED_SCHEMA = ", ".join(f"{c} string" for c in SEED_COLUMNS)
CHUNK_SCHEMA = "chunk_id long, text string, source string, stressor_type string, chunk_type string, guardrail_id string, embedding array<float>"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


#: The column that holds a line whole, as a Variant.
WHOLE = "_gm_line"


def read_jsonl(spark: SparkSession, path: str, schema: str = RAW_SCHEMA, glob: str = "*.jsonl", variants: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a file or folder of JSON lines; blank lines are neither.

    Records carry _file and _block (where their split of the file begins), from which in_order() numbers them. variants:
    they also carry the line as a Variant, in which a missing field, a null and a value of another type are told apart
    (lacks(), is_null(), kind_of()); a line that is JSON but whose values have other types than the schema is a record then,
    with nulls in their place. A missing path gives empty tables.
    """
    if not exists(spark, path):
        none = empty(spark, schema).withColumns({"_file": F.lit(""), "_block": F.lit(0).cast("long")})
        return none.withColumn(WHOLE, F.try_parse_json(F.lit(None).cast("string"))) if variants else none, empty(spark, "_corrupt string, _file string")
    full = T._parse_datatype_string(schema) if not isinstance(schema, T.StructType) else schema
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    lines = spark.read.option("pathGlobFilter", glob).text(path).select("value", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block")).where(F.trim("value") != "")
    marked = T.StructType([*full.fields, T.StructField("_corrupt", T.StringType())])
    if variants:
        held = lines.withColumn(WHOLE, F.try_parse_json("value"))
        fit = F.schema_of_variant(WHOLE).startswith("OBJECT<")
        fields = [F.try_variant_get(WHOLE, f"$['{f.name}']", _ddl(f.dataType)).alias(f.name) for f in full.fields]
        good = F.coalesce(fit, F.lit(False))
        return held.where(good).select(*fields, "_file", "_block", WHOLE), held.where(~good).select(F.col("value").alias("_corrupt"), "_file")
    parsed = lines.select(F.from_json("value", marked, options).alias("r"), "_file", "_block").select("r.*", "_file", "_block")
    return parsed.where("_corrupt IS NULL").drop("_corrupt"), parsed.where("_corrupt IS NOT NULL").select("_corrupt", "_file")


def _ddl(kind: T.DataType) -> str:
    return kind.simpleString()


def _at(field: str) -> Column:
    return F.variant_get(WHOLE, f"$['{field}']", "variant")


def lacks(field: str) -> Column:
    """Whether a line read with variants does not have the field at all."""
    return _at(field).isNull()


def is_null(field: str) -> Column:
    """Whether the line has the field, with a JSON null."""
    return F.coalesce(F.is_variant_null(_at(field)), F.lit(False))


def kind_of(field: str) -> Column:
    """The type of the field's value in the line: STRING, BIGINT, BOOLEAN, DECIMAL(..), ARRAY<..>, OBJECT<..>, VOID for a null; null if missing."""
    return F.schema_of_variant(_at(field))


def in_order(records: DataFrame, order: str = "_ord", keep: Callable[[DataFrame, str], DataFrame] = table) -> DataFrame:
    """records of read_jsonl(), written (by `keep`), with `order`: 0, 1, 2 ... by name of file, then by line.

    Splits are counted, one small row each; a record's number is the records of the splits before and its place in its own.
    """
    held = keep(records.withColumn("_gm_row", F.monotonically_increasing_id()), "records")
    splits = held.groupBy("_file", "_block").agg(F.count("*").alias("_gm_n"), F.min("_gm_row").alias("_gm_first"))
    before = F.sum("_gm_n").over(Window.partitionBy(F.lit(0)).orderBy("_file", "_block")) - F.col("_gm_n")
    starts = splits.select("_file", "_block", "_gm_first", before.alias("_gm_before"))
    return held.join(small(starts, 200), ["_file", "_block"]).withColumn(order, F.col("_gm_before") + F.col("_gm_row") - F.col("_gm_first")).drop("_gm_row", "_gm_first", "_gm_before")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """Nulls are written, other characters than ASCII as they are."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_seed_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(SEED_SCHEMA).csv(path) if exists(spark, path) else empty(spark, SEED_SCHEMA)


def append_seed_csv(df: DataFrame, path: str) -> None:
    """Only the seed columns, in their order; columns that df lacks are null."""
    own = set(df.columns)
    cols = [F.col(c).cast("string").alias(c) if c in own else F.lit(None).cast("string").alias(c) for c in SEED_COLUMNS]
    df.select(*cols).write.mode("append").option("header", True).option("escape", '"').csv(path)


def read_document(spark: SparkSession, path: str, schema: str, lines: bool = False) -> DataFrame:
    """Nested JSON documents, one each file, or one each line as replace_document() writes them."""
    return spark.read.option("multiLine", not lines).schema(schema).json(path)


def replace_document(df: DataFrame, path: str, backup: str) -> None:
    """Puts the documents of df, a line each, in place of those at path, which are moved to backup.

    The new ones are written beside first, so a failure leaves what was there; df may read from path.
    """
    spark, beside = df.sparkSession, f"{path}-{uuid.uuid4().hex}"
    df.write.json(beside)
    if exists(spark, path):
        remove(spark, backup)
        move(spark, path, backup)
    move(spark, beside, path)


def write_index(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").parquet(path)


def write_chunks(chunks: DataFrame, path: str) -> None:
    """The chunks without their vectors, as JSON lines, beside the index."""
    chunks.drop("embedding").write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The vector table; a missing one is empty."""
    return spark.read.parquet(path) if exists(spark, path) else empty(spark, CHUNK_SCHEMA)


def training_records(spark: SparkSession, path: str) -> DataFrame:
    """Records to train on; none is an error."""
    good, _ = read_jsonl(spark, path)
    if good.isEmpty():
        raise ValueError(f"no training records at {path}")
    return good


def evaluation_records(df: DataFrame, key: str, n: int | None = None, seed: int = 42) -> DataFrame:
    """All rows, or a repeatable sample of n: those that come first in a seeded hash order."""
    return df if n is None else df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def append_turns(df: DataFrame, path: str, batch: int) -> None:
    """Rows of the turn log, as JSON lines in a folder of their batch: a batch that is written again takes its own place, not another.

    In a stream: writeStream.foreachBatch(lambda df, batch: append_turns(df, path, batch)).
    """
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/batch={batch}")


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """The turn log of all batches; a missing one is empty. Folders of batches that did not end are not read."""
    if not exists(spark, f"{path}/batch=*/_SUCCESS"):
        return empty(spark, TURN_LOG_SCHEMA)
    done = [f"{path}/{n}" for n in names(spark, path) if n.startswith("batch=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return spark.read.schema(TURN_LOG_SCHEMA).json(done)
