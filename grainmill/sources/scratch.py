"""Tables between the steps of an iteration, in the folder that all executors share, and joins by their counted size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast up to so many bytes; above, the join shuffles.
BROADCAST_BYTES = 24 << 20


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a local session gets a folder of its own, as in tests; a cluster must name one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        root = f"file://{tempfile.mkdtemp(prefix='grainmill-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/grainmill/{label}-{uuid.uuid4().hex}"


def table(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Removes a table made by table() that nothing lazy depends on any more."""
    spark, files = df.sparkSession, df.inputFiles()
    if files:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rpartition("/")[0])
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def small(df: DataFrame, row_bytes: int, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if its counted rows stay within BROADCAST_BYTES, else df as it is (the join then shuffles)."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def numbered_rows(df: DataFrame) -> DataFrame:
    """df, written, with _gm_number: 1, 2, 3 ... in the order in which its partitions hold the rows."""
    return with_numbers(table(df.withColumn("_gm_row", F.monotonically_increasing_id()), "numbered"))


def with_numbers(held: DataFrame) -> DataFrame:
    """A written table with _gm_row (numbers that grow along its partitions as it was written), with _gm_number in its place."""
    part = F.shiftright("_gm_row", 33)
    counts = held.groupBy(part.alias("_gm_part")).agg(F.count("*").alias("_gm_k"), F.min("_gm_row").alias("_gm_first"))
    # One row for each partition.
    before = counts.select("_gm_part", "_gm_first", (F.sum("_gm_k").over(Window.partitionBy(F.lit(0)).orderBy("_gm_part")) - F.col("_gm_k")).alias("_gm_before"))
    joined = held.withColumn("_gm_part", part).join(small(before, 32), "_gm_part")
    return joined.withColumn("_gm_number", F.col("_gm_before") + F.col("_gm_row") - F.col("_gm_first") + 1).drop("_gm_row", "_gm_part", "_gm_first", "_gm_before")
