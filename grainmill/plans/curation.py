"""The curation flow: clean, deduplicate, validate, write, count."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.operators import cleaning, dedup, labels
from grainmill.sources import files, fingerprints, runs
from grainmill.sources.scratch import table


class Curated(NamedTuple):
    final: DataFrame
    clean_rejected: DataFrame
    removed: DataFrame
    corrected: DataFrame
    dropped: DataFrame
    stats: DataFrame
    written: DataFrame


def public(df: DataFrame) -> DataFrame:
    """Without the columns whose names begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def curate(raw: DataFrame, order: str, existing: DataFrame | Callable[[DataFrame], DataFrame] | None = None, near: float | None = None, vector: str = "embedding", strict: bool = False, in_order: bool = False, *, missing: dict[str, Column] | None = None, keep: Callable[[DataFrame, str], DataFrame] = table) -> Curated:
    """All steps over one table of records; each step's outcome is a column of it, written at the three splits.

    existing: fingerprints (_fingerprint) of what was written before, or a function that finds those of a batch. near: a
    cosine from which later rows with similar vectors go as well. missing: as for labels.validate. keep: how the tables
    between the steps are written (df, name). final holds clean rows and corrected ones, without working columns; in_order
    sorts it by range, clean rows first, then by `order`.
    """
    cleaned = keep(cleaning.clean(raw), "cleaned")
    accepted = dedup.with_fingerprint(cleaned.where("_drop_reason IS NULL").drop("_drop_reason"))
    marked = dedup.marked_copies(accepted, order)
    if existing is not None:
        known = existing(marked.select("_fingerprint")) if callable(existing) else existing.select("_fingerprint").distinct()
        marked = marked.join(known.withColumn("_known", F.lit(True)), "_fingerprint", "left").withColumn("_dedup_reason", F.when(F.col("_known"), "exact_duplicate").otherwise(F.col("_dedup_reason"))).drop("_known")
    if near is not None:
        kept = marked.where("_dedup_reason IS NULL").drop("_dedup_reason")
        marked = marked.where("_dedup_reason IS NOT NULL").withColumn("_sim_score", F.lit(None).cast("double")).unionByName(dedup.semantic(kept, near, order, vector))
    marked = keep(marked, "marked")
    checked = keep(labels.validate(marked.where("_dedup_reason IS NULL").drop("_dedup_reason"), strict, missing), "checked")
    good = checked.where("_drop_reason IS NULL")
    stats = _stats(cleaned, marked, checked)
    final = good.orderBy(F.size("_corrections") > 0, order) if in_order else good
    return Curated(public(final), cleaned.where("_drop_reason IS NOT NULL"), marked.where("_dedup_reason IS NOT NULL"), good.where(F.size("_corrections") > 0), checked.where("_drop_reason IS NOT NULL"), stats, good.select("_fingerprint"))


def _stats(cleaned: DataFrame, marked: DataFrame, checked: DataFrame) -> DataFrame:
    """One row of the ten counters; each step is counted in one pass over what it wrote."""
    count = lambda cond, name: F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long").alias(name)
    kept, corrected = F.col("_drop_reason").isNull(), F.size("_corrections") > 0
    a = cleaned.agg(F.count("*").alias("raw_loaded"), count(kept, "after_clean"), count(~kept, "clean_dropped"))
    b = marked.agg(count(F.col("_dedup_reason").isNull(), "after_dedup"), count(F.col("_dedup_reason") == "exact_duplicate", "dedup_exact"), count(F.col("_dedup_reason") == "semantic_duplicate", "dedup_semantic"))
    c = checked.agg(count(kept, "after_validate"), count(kept & corrected, "validate_corrected"), count(~kept, "validate_dropped"), count(kept, "final_written"))
    return a.crossJoin(b).crossJoin(c)


def run(spark, raw_path: str, out_path: str, near: float | None = None, strict: bool = False, glob: str = "*.jsonl") -> Curated:
    """From a folder of JSON lines to out_path: final records are added, and rows whose fingerprints are there already are left out.

    "First" is by name of file and line, however the files are split among tasks; what is written is in that order. A
    required field that a line does not have is missing, one that is null is a null (labels.validate). Fingerprints of what
    was written are kept in a store below out_path, so no earlier text is read again. All outputs of a run appear at its
    commit, once (sources.runs): a run that failed is taken up where it stood, by calling it again.
    """
    this = runs.Run(spark, out_path, f"{runs.signature(spark, raw_path, glob)} {near} {strict}")
    records, malformed = files.read_jsonl(spark, raw_path, glob=glob, variants=True)
    # What is asked of the lines is asked at once, so that they need not be kept beside the records.
    asked = {f: f"_lacks_{f}" for f in (*labels.REQUIRED, "language")}
    records = files.in_order(records.withColumns({c: files.lacks(f) for f, c in asked.items()}).drop(files.WHOLE), keep=this.stage)
    missing = {f: F.col(c) for f, c in asked.items()}
    known = lambda batch: fingerprints.known(spark, f"{this.root}/_store", batch)
    out = curate(records, "_ord", known, near, strict=strict, in_order=True, missing=missing, keep=this.stage)
    made = [("final", out.final, True), ("corrections", out.corrected, True), ("rejected", out.dropped, True), ("clean_rejected", out.clean_rejected, False), ("removed", out.removed, False), ("malformed", malformed, False)]
    for name, df, append in made:
        this.output(df.drop(*asked.values()), name, append)
    this.output(fingerprints.rows(out.written), "_store/fingerprints", kind="parquet", by=("bucket",))
    this.output(fingerprints.filter_rows(out.written), "_store/filter", kind="parquet")
    this.commit()
    return out
