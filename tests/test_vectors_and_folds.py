"""The vector join by cells, and the ordered fold by ranges, against plain Python."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.operators import dedup, reports


def vectors_of(spark, matrix, keys=None):
    keys = range(len(matrix)) if keys is None else keys
    return spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in zip(keys, matrix, strict=True)], "vec_id long, embedding array<double>")


def clustered(n, clusters, width=32, spread=0.02, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(clusters, width))
    v = centres[rng.integers(0, clusters, n)] / np.sqrt(width) + rng.normal(size=(n, width)) * spread
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.mark.parametrize(("least", "cells", "block"), [(0.92, 20, 64), (0.5, 7, 16), (-0.2, 5, 1000), (0.92, 1, 8)])
def test_pairs_by_cells(spark, monkeypatch, least, cells, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    v = clustered(300, 12)
    if least < 0:
        v[::7] *= np.linspace(0.1, 3, len(v[::7]))[:, None]  # of any length
    sim = v @ v.T
    want = {(a, b) for a in range(300) for b in range(a + 1, 300) if sim[a, b] >= least}
    got = dedup.class_pairs(vectors_of(spark, v).select(F.col("vec_id").alias("a"), F.col("embedding").alias("v")), least, cells).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    assert all(abs(r["sim"] - sim[r["a"], r["b"]]) < 1e-9 for r in got)


def test_few_vectors_move_at_a_high_threshold(spark, monkeypatch):
    """Of 4,000 vectors in 200 clusters, each goes to little more than its own cell."""
    monkeypatch.setattr(dedup, "BLOCK", 64)
    moved = []
    classes = vectors_of(spark, clustered(4000, 200, spread=0.01)).select(F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    assert dedup.class_pairs(classes, 0.92, moved=moved).count() > 0
    assert moved[0] <= 4 * 4000


def test_copies_of_vectors(spark):
    """Thousands of equal vectors give a row each, not one for each pair; kept and removed rows are those of the loop over all."""
    base = clustered(40, 6, width=8, spread=0.15, seed=3)
    rng = random.Random(4)
    rows = [base[rng.randrange(40)] for _ in range(150)] + [base[0]] * 1500
    rng.shuffle(rows)
    df = vectors_of(spark, rows)
    pairs = dedup.similar_pairs(df, 0.8).collect()
    classes = len({tuple(r) for r in rows})
    assert len(pairs) <= classes * classes + len(rows)
    kept, want = [], {}
    for k, v in enumerate(rows):
        best = max((float(np.dot(v, w)) for _, w in kept), default=-2)
        if best >= 0.8:
            want[k] = round(best, 4)
        else:
            kept.append((k, v))
    got = {r["vec_id"]: r["_sim_score"] for r in dedup.semantic(df.withColumn("_dedup_reason", F.lit("old")), 0.8).where("_dedup_reason IS NOT NULL").collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1.1e-4)


def test_evenly_spread_vectors_move_a_bounded_number_of_times(spark):
    """Where cells do not tell vectors apart, a vector goes to PARTS parts at most, however many blocks there are."""
    moved = []
    v = np.random.default_rng(5).normal(size=(20000, 32))
    classes = vectors_of(spark, v / np.linalg.norm(v, axis=1, keepdims=True)).select(F.col("vec_id").alias("a"), F.col("embedding").alias("v"))
    assert dedup.class_pairs(classes, 0.6, moved=moved).count() > 0
    assert moved[0] <= dedup.PARTS * 20000


@pytest.mark.parametrize("held", [32 << 20, 100])
def test_dense_vectors_by_ranges(spark, monkeypatch, held):
    """The same rows go as in the loop, through several ranges, with few or many kept ones, and without the pairs among removed ones."""
    made = []
    pairs = dedup.class_pairs
    monkeypatch.setattr(dedup, "FIRST", 20)
    monkeypatch.setattr(dedup, "HELD_BYTES", held)
    monkeypatch.setattr(dedup, "class_pairs", lambda *a, **b: made.append((found := pairs(*a, **b)).count()) or found)
    rng = np.random.default_rng(6)
    v = rng.normal(size=(600, 6))
    v[::50] = v[7]
    v[3::40] *= 0.01
    v /= np.maximum(1, np.linalg.norm(v, axis=1, keepdims=True))
    kept, want = [], {}
    for k, x in enumerate(v):
        best = max((float(x @ v[j]) for j in kept), default=-2)
        if best >= 0.5:
            want[k] = best
        else:
            kept.append(k)
    got = {r["vec_id"]: r["_sim_score"] for r in dedup.semantic(vectors_of(spark, v), 0.5).where("_dedup_reason IS NOT NULL").collect()}
    assert set(got) == set(want) and got == pytest.approx(want, abs=1.1e-4)
    if held > 100:
        assert sum(made) < 0.2 * int((np.triu(v @ v.T, 1) >= 0.5).sum())


def fold(texts, fps=None, window=200, least=0.85):
    """(near_of, copy) of each text, by a loop; fps: values of which an accepted row makes later ones copies."""
    held, seen, out = [], set(), []
    for i, text in enumerate(texts):
        words = set(text.lower().split())
        copy = fps is not None and fps[i] in seen
        near = None if copy else next((k for k, w in held[-window:] if words and w and len(words & w) / max(len(words), len(w)) >= least), None)
        if near is None and not copy:
            held.append((i, words))
            seen.add(fps[i] if fps else None)
        out.append((near, copy))
    return out


def chatter(n, seed, forms=12):
    """Texts of which many are near to others, at all distances, so that what is accepted depends on what was accepted before."""
    rng = random.Random(seed)
    bases = [[f"b{b}w{k}" for k in range(20)] for b in range(forms)]
    texts = []
    for i in range(n):
        if rng.random() < 0.4:
            texts.append(f"alone{i} " + " ".join(f"u{i}x{k}" for k in range(rng.randint(0, 12))))
        else:
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(20)] = f"v{rng.randrange(40)}"
            texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize(("window", "block"), [(5, 7), (20, 16), (200, 50), (3, 1000)])
def test_fold_by_ranges(spark, window, block):
    texts = chatter(300, window)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    got = {r["order"]: (r["near_of"], r["copy"]) for r in dedup.overlap_window(df, "i", window=window, block=block).collect()}
    assert [got[i] for i in range(300)] == fold(texts, window=window)


def test_fold_of_copies_and_groups(spark):
    texts = chatter(240, 9, forms=5)
    fps = [t.split()[0] if i % 3 else "common" for i, t in enumerate(texts)]
    df = spark.createDataFrame([(i, t, f, f"g{i % 3 == 0}") for i, (t, f) in enumerate(zip(texts, fps, strict=True))], "i long, text string, f string, g string")
    got = {r["order"]: (r["near_of"], r["copy"]) for r in dedup.overlap_window(df, "i", window=10, block=20, copy_of="f").collect()}
    assert [got[i] for i in range(240)] == fold(texts, fps, 10)
    got = {r["order"]: (r["near_of"], r["copy"]) for r in dedup.overlap_window(df, "i", window=10, block=20, group="g").collect()}
    for g in (0, 1):
        mine = [i for i in range(240) if (i % 3 == 0) == g]
        want = fold([texts[i] for i in mine], window=10)
        assert [got[i] for i in mine] == [(None if n is None else mine[n], c) for n, c in want]
    assert dedup.overlap_window(df.limit(0), "i").count() == 0


def test_copy_of_a_near_row_is_judged_anew(spark):
    """A, a near copy B, 250 others, then B again: the last is accepted, and a further B is a copy of it."""
    a = "one two three four five six seven eight nine ten"
    b = "one two three four five six seven eight nine eleven"
    texts = [a, b, b, *[f"other{i} text number{i} for row{i}" for i in range(250)], b, b, a]
    df = spark.createDataFrame([(i, t, 1, "vent_frustration") for i, t in enumerate(texts)], "i long, text string, urgency_level int, intent string")
    got = {r["i"]: r["rejection_reason"] for r in reports.quality_check(df, "i").collect()}
    assert [got[i] for i in (0, 1, 2, 253, 254, 255)] == [None, "near_duplicate", "near_duplicate", None, "exact_duplicate", "exact_duplicate"]
    assert not [i for i in range(3, 253) if got[i]]


def test_marks_are_replaced(spark):
    df = dedup.with_fingerprint(spark.createDataFrame([(1, "a text here"), (2, "a text here"), (3, "other")], "i int, text string"))
    once = dedup.marked_copies(df, "i")
    assert sorted((r["i"], r["_dedup_reason"]) for r in dedup.marked_copies(once, "i").collect()) == [(1, None), (2, "exact_duplicate"), (3, None)]


# --- words and top-k


def test_word_rules_decide_as_patterns_do(spark):
    """Every pattern of the cascades over texts made of its own choices, parts of them, and other letters around them."""
    from grainmill.functions import patterns as P
    from grainmill.functions.text import count_words, folded, found_words, hits_folded, matches, word_hits, word_rule
    from grainmill.operators.affect import SIGNALS

    listed = {**SIGNALS, "stigma": P.STIGMA, "good": P.POSITIVE_WORDS, "bad": P.NEGATIVE_WORDS}
    assert all(word_rule(p) for p in listed.values())
    rng, bits = random.Random(8), []
    for p in listed.values():
        bits += [c.replace(r"\s+", rng.choice([" ", "  ", "\n"])).replace(".?", rng.choice(["-", "", "x"])) for c in p[4:-3].split("|")]
    edges = [" ", "-", "é", "s", "'", "_", ". ", "́", "9", " "]
    texts = ["".join(rng.choice([b, b.upper(), b.title(), b[: rng.randint(1, len(b))]]) + rng.choice(edges) for b in rng.sample(bits, rng.randint(1, 5))) for _ in range(1500)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").withColumn("low", folded(F.col("t"))).withColumn("hits", word_hits(F.col("low"), list(listed.values())))
    off = df.select("i", "t", *[(found_words(F.col("low"), F.col("hits"), p) != matches(F.col("t"), p)).alias(k) for k, p in listed.items()], *[(count_words(F.col("low"), F.col("hits"), p) != hits_folded(F.col("low"), p)).alias(f"n_{k}") for k, p in listed.items()])
    bad = off.where(" OR ".join(c for c in off.columns[2:])).collect()
    assert not bad, [(r["t"], [k for k in off.columns[2:] if r[k]]) for r in bad[:3]]
    some = df.select(*[F.sum(found_words(F.col("low"), F.col("hits"), p).cast("int")).alias(k) for k, p in listed.items()]).first()
    assert all(v > 3 for v in some)


@pytest.mark.parametrize(("queries", "part"), [(30, 1 << 17), (300, 1 << 17), (300, 40)])
def test_topk_in_blocks(spark, monkeypatch, queries, part):
    """More queries than a block, a divided index, vectors of any length, ties: as a loop finds them."""
    from grainmill.operators import retrieval

    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 64)
    monkeypatch.setattr(retrieval, "INDEX_PART", part)
    rng = np.random.default_rng(2)
    index = np.round(rng.normal(size=(120, 6)) * rng.choice([0.01, 1, 3], size=(120, 1)), 2)
    index[50:60] = index[40]
    asked = np.round(rng.normal(size=(queries, 6)), 2)
    kinds = [None if i % 4 == 0 else f"s{i % 3}" for i in range(120)]
    chunks = spark.createDataFrame([(i, [float(x) for x in v], k) for i, (v, k) in enumerate(zip(index, kinds, strict=True))], "chunk_id long, embedding array<double>, stressor_type string")
    wanted = [["none", None, "s1"][i % 3] for i in range(queries)]
    ask = spark.createDataFrame([(i, [float(x) for x in v], w) for i, (v, w) in enumerate(zip(asked, wanted, strict=True))], "query_id long, embedding array<double>, wanted string")
    got = {}
    for r in retrieval.top_k(chunks, ask, wanted="wanted").orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["chunk_id"], round(r["score"], 9)))
    for q in range(queries):
        near = sorted(range(120), key=lambda c: (-float(asked[q] @ index[c]), c))[:9]
        want = [c for c in near if wanted[q] in (None, "none") or kinds[c] in (None, wanted[q])][:3]
        assert [c for c, _ in got.get(q, [])] == want


def test_topk_reads_the_index_once(spark, monkeypatch, tmp_path):
    """5,000 queries over 50 chunks: one scan of each, in one plan, and nothing of the queries collected."""
    from grainmill.operators import retrieval

    rng = np.random.default_rng(3)
    for name, n in (("index", 50), ("asked", 5000)):
        vectors_of(spark, rng.normal(size=(n, 4))).withColumn("stressor_type", F.lit(None).cast("string")).write.parquet(f"{tmp_path}/{name}")
    index, asked = (spark.read.parquet(f"{tmp_path}/{n}") for n in ("index", "asked"))
    out = retrieval.top_k(index.withColumnRenamed("vec_id", "chunk_id"), asked.withColumnRenamed("vec_id", "query_id"))
    plan = out._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2 and plan.count("MapInArrow") == 1
    assert out.count() == 15000


def test_distributions_in_one_scan(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", None, 1), ("b", "x", 2)], "p string, q string, r int")
    got = [tuple(r) for r in reports.distributions(df, ["p", "q", "r"]).collect()]
    assert got == [("p", "a", 2, 66.7), ("p", "b", 1, 33.3), ("q", "x", 2, 66.7), ("q", "unknown", 1, 33.3), ("r", "1", 2, 66.7), ("r", "2", 1, 33.3)]
    assert reports.distributions(df, ["p", "q"])._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
