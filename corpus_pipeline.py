"""From raw documents to packed sequences: five stages, each written as Parquet and read again by the next.

Of every stage: an empty table gives none; columns of any other name are carried along (up to packing); long texts go whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import common, jaccard_join, line_dedup, mixing, packing, quality_rules

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go: null, empty and blank texts with them. Repeated rows are judged alike and each stay or go; null ids do not matter."""
    return quality_rules.keep_good(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go; every document stays, with what is left of its text.

    Null texts stay null; repeated rows are one place and keep their lines alike; rows without an id come first, told apart by their texts.
    """
    kept = line_dedup.drop_repeated_lines(docs, counts=None)
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of 5-word shingles connect, the document with the smallest doc_id stays.

    Null, empty and blank texts link with nothing and stay; of repeated rows one stays; rows without an id come first, told apart by their texts.
    """
    return jaccard_join.keep_one(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice.

    Null and blank texts have size 0 and are taken by rank like others; a null source is a source; rows that share an id get one count.
    """
    return mixing.mix(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences. Null, empty and blank texts are the end id alone; repeated rows are packed once each."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_jaccard_join", near_duplicates_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Tokenizers and the packing rule are beyond SQL; tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; what each leaves is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/grainmill/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
