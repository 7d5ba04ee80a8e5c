"""The pipeline on the small tables: each stage on what its predecessor kept, and the end against plain Python."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from grainmill.llm import quality_rules
from tests.conftest import DATA
from tests.llm.test_operators import brute_components, brute_copies, brute_lines, check_packing


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    at = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at[-1], DATA)
        if name != "packing":
            assert out.columns == columns, name
        at.append(spark.createDataFrame(out.collect(), out.schema))
    start, good, lined, single, mixed, packed = at
    keep = {r["doc_id"] for r in quality_rules.judge(start).where("kept").collect()}
    assert {r["doc_id"] for r in good.collect()} == keep
    import hashlib

    lines = brute_lines([(r["doc_id"], r["text"]) for r in good.collect()], 3)
    assert all(hashlib.sha256(r["text"].encode()).hexdigest() == lines[r["doc_id"]][2] and r["n_chars"] == len(r["text"]) for r in lined.collect())
    groups = brute_components([(r["doc_id"], r["text"]) for r in lined.collect()])
    assert {r["doc_id"] for r in single.collect()} == {d for d, (_, c) in groups.items() if c == d}
    copies = Counter(r["doc_id"] for r in mixed.collect())
    assert copies == Counter({d: n for d, n in brute_copies([(r["doc_id"], r["source"], r["text"]) for r in single.collect()]).items() if n})
    check_packing([(r["doc_id"], r["text"]) for r in mixed.collect()], packed.collect())


def test_run(spark):
    """All of run() against the plain versions, one after the other; the rules' verdicts are held against SQL elsewhere."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, texts = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}, {}
    good = {r["doc_id"]: r for r in docs.collect() if r["doc_id"] in kept}
    brute_lines([(d, r["text"]) for d, r in good.items()], 3, texts=texts)
    single = [d for d, (_, c) in brute_components(list(texts.items())).items() if c == d]
    copies = brute_copies([(d, good[d]["source"], texts[d]) for d in single])
    out = corpus_pipeline.run(spark, DATA).collect()
    used, total = check_packing([(d, texts[d]) for d, n in copies.items() for _ in range(n)], out)
    assert used <= 1.03 * total / 2048 + 2


#: Names that the stages use themselves, and others that join, filter or group there.
CLASHING = ["_n_lines", "_n_removed", "_row", "_text", "_d", "_spans", "_h", "_c", "_w", "kept", "n_words", "size", "rank", "copies", "target", "set_id", "k"]


def test_stages_carry_columns_of_any_name(spark):
    """Each stage but the last returns the same rows with and without extra columns, and these with their values."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 150")
    extra = docs.select("*", *[(F.col("doc_id") * 1000 + i).alias(c) for i, c in enumerate(CLASHING)])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = stage(spark, docs, DATA), stage(spark, extra, DATA)
        assert wide.columns == extra.columns, name
        rows = wide.collect()
        assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in plain.collect()), name
        assert all(r[c] == r["doc_id"] * 1000 + i for r in rows for i, c in enumerate(CLASHING)), name
        docs, extra = (spark.createDataFrame(df.collect(), df.schema) for df in (plain, wide))
    packed = corpus_pipeline.STAGES[-1][1](spark, extra, DATA)
    assert packed.agg(F.sum("length")).first()[0] == corpus_pipeline.STAGES[-1][1](spark, docs, DATA).agg(F.sum("length")).first()[0]
