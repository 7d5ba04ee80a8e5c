"""A store of fingerprints: append-only, in hash buckets, with a blocked Bloom filter as a narrow table beside them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.sources.runs import exists
from grainmill.sources.scratch import small, table

#: Fixed for a store: hash buckets, and words of 64 bits of each bucket's filter. Four bits of one word stand for a fingerprint.
BUCKETS, WORDS, BITS = 256, 1 << 16, 4
FILTER = "bucket int, word int, bits long"
#: Tasks that write a batch's buckets: each bucket is one task's, so that a batch adds a file to a bucket, however many tasks hold its rows.
WRITERS = 64


def placed(fingerprints: DataFrame, key: str = "_fingerprint") -> DataFrame:
    """fingerprints with the bucket, the word of its filter and the bits there that stand for each."""
    h, g = F.xxhash64(key), F.xxhash64(F.col(key), F.lit(1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(g, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
    bits: Column = reduce(lambda a, b: a.bitwiseOR(b), [bit(i) for i in range(BITS)])
    return fingerprints.withColumns({"bucket": F.pmod(h, F.lit(BUCKETS)).cast("int"), "word": F.pmod(F.shiftright(h, 8), F.lit(WORDS)).cast("int"), "bits": bits})


def rows(new: DataFrame, key: str = "_fingerprint") -> DataFrame:
    """_fingerprint, bucket: what is to be written of a batch's fingerprints (by bucket)."""
    return placed(new.select(F.col(key).alias("_fingerprint")).where("_fingerprint IS NOT NULL").distinct()).select("_fingerprint", "bucket").repartition(WRITERS, "bucket")


def filter_rows(new: DataFrame, key: str = "_fingerprint") -> DataFrame:
    """bucket, word, bits: the filter of a batch's fingerprints; words without any are not there."""
    return placed(new.select(F.col(key).alias("_fingerprint")).where("_fingerprint IS NOT NULL")).groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def known(spark: SparkSession, store: str, batch: DataFrame, key: str = "_fingerprint", report: dict | None = None) -> DataFrame:
    """_fingerprint: those of the batch that are in the store (folders `fingerprints` and `filter` below it).

    The batch's fingerprints meet the filter, a row for each word of 64 bits; only those it may hold go on, and only the
    buckets that they lie in are read (one partition folder each, so others are not opened). report: gets the
    numbers of candidates and of buckets.
    """
    mine = placed(batch.select(F.col(key).alias("_fingerprint")).where("_fingerprint IS NOT NULL").distinct())
    marks = _read(spark, f"{store}/filter", FILTER).groupBy("bucket", "word").agg(F.bit_or("bits").alias("held"))
    may = table(mine.join(marks, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("held")) == F.col("bits")).select("_fingerprint", "bucket"), "candidates")
    buckets = [r[0] for r in may.select("bucket").distinct().orderBy("bucket").collect()]  # BUCKETS at most
    if report is not None:
        report |= {"candidates": may.count(), "buckets": len(buckets)}
    if not buckets:
        return may.select("_fingerprint")
    held = spark.read.schema("_fingerprint string, run string, bucket int").parquet(f"{store}/fingerprints").where(F.col("bucket").isin(buckets)).select("_fingerprint", "bucket")
    return held.join(small(may, 64), ["_fingerprint", "bucket"]).select("_fingerprint").distinct()
