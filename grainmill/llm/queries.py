"""The queries of the training-data operators, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainmill.llm import jaccard_join, line_dedup, manifest, mixing, packing, periodic_runs, quality_model, quality_rules, suffix_dedup, token_counts, topk_search, toxicity_model, url_filters


#: The rules of op13_url_filters.
URL_RULES = [
    url_filters.Rule("allow", "com", "/"),
    url_filters.Rule("block", "example.com", "/en/"),
    url_filters.Rule("allow", "www.example.com", "/en/"),
    url_filters.Rule("block", "net", "/es/"),
    url_filters.Rule("block", "net", "/fr/"),
]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(documents(spark, sf_dir)).select("doc_id", *quality_rules.SIGNALS, "base_failed", "kept")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_model.classify(documents(spark, sf_dir), labels(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(documents(spark, sf_dir))


def op6_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_links(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(documents(spark, sf_dir))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(documents(spark, sf_dir))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return periodic_runs.digest(docs.withColumn("text", periodic_runs.planted(F.col("doc_id"), F.col("text"))))


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.digest(documents(spark, sf_dir))


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), url_filters.rule_table(spark, URL_RULES))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_model": op1_quality_model,
        "op2_mixing": op2_mixing,
        "op3_quality_rules": op3_quality_rules,
        "op4_toxicity": op4_toxicity,
        "op5_token_counts": op5_token_counts,
        "op6_jaccard_join": op6_jaccard_join,
        "op6_jaccard_links": op6_jaccard_links,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_packing": op8_packing,
        "op9_topk_search": op9_topk_search,
        "op10_line_dedup": op10_line_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_manifest": op12_manifest,
        "op13_url_filters": op13_url_filters,
    }
