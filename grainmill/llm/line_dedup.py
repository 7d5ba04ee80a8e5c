"""Operator 10: removal of repeated runs of lines: a suffix array over line ids by distributed prefix doubling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import BROADCAST_BYTES, document_key, drop_table, small, table

#: A run counts as repeated from so many lines on, or from so many words on, if it has fewer lines.
RUN, WORDS = 3, 50


def _ranked(pairs: DataFrame, label: str, once: bool = True) -> DataFrame:
    """The places of `pairs` (_d, _i, a, b and more) whose pair another place has, with `rank` and the pair's first place (_fd, _fi).

    Pairs are sorted and numbered in that order, so that ranks sort as the runs of lines do; pairs of one place get no
    rank and leave. Repeated pairs are counted and written before anything is moved by them: the join is then a
    broadcast if they are few, else a plain join of two exchanges, in which Spark splits the partition of a very common one.
    once: whether each place is there only once.
    """
    of = pairs.groupBy("a", "b").agg(F.count("*").alias("_n"), F.min(F.struct("_d", "_i")).alias("_f")).where("_n > 1")
    # Numbers that grow along the sorted partitions: made once, since the table is written.
    ranks = table(of.select("a", "b", "_f").orderBy("a", "b").select("a", "b", F.monotonically_increasing_id().alias("rank"), F.col("_f._d").alias("_fd"), F.col("_f._i").alias("_fi")), f"{label}-ranks")
    out = pairs.join(small(ranks, 72), ["a", "b"]).drop("a", "b")
    out = table(out if once else out.dropDuplicates(["_d", "_i"]), label)
    drop_table(ranks)
    return out


def _longer(live: DataFrame, step: int, tail: DataFrame, label: str) -> DataFrame:
    """From ranks of n lines (live) and of some lines (tail): ranks of the places where both stand, the tail `step` lines on."""
    there = tail.select("_d", (F.col("_i") - step).cast("int").alias("_i"), F.col("rank").alias("b"))
    return _ranked(live.select("_d", "_i", F.col("rank").alias("a"), "w").join(there, ["_d", "_i"]), label)


def _later(ranked: DataFrame, length: int, where: str = "true") -> DataFrame:
    """_d, _at: later places of the ranks' classes, as place << 32 | length of the run."""
    return ranked.where("_d != _fd OR _i != _fi").where(where).select("_d", (F.shiftleft(F.col("_i").cast("long"), 32) + length).alias("_at"))


def repeated_runs(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """_d, _spans: for each document with lines to remove, (first line, line behind the last) of the maximal runs, in order.

    A run goes if it begins earlier in the corpus too (smaller doc_id, or further up) and has `run` lines or `words`
    words. The suffix array is made by doubling: pairs of ranks of n lines here and n lines on are sorted and ranked
    anew, for n = 1, 2, 4 ... until no rank repeats; places whose rank is unique leave at once, so only lines that
    repeat are moved. The places of one rank of n lines are an interval of the array whose common prefixes have n
    lines or more; all but its first place are later copies. Common prefixes are so known to the power of two below,
    which loses nothing: of a run of n <= l < 2n lines, l - n lines further on a later copy of n lines begins as well,
    and the two cover it. Around the thresholds lengths are exact: a run of `run` lines is the pair of the ranks of
    the power of two below it, at both its ends; below, runs are looked at line by line for their words.
    """
    lines = docs.select(document_key(docs), F.posexplode(F.split("text", "\n")).alias("_i", "_line"))
    count = F.least(F.regexp_count("_line", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(words)) if words else F.lit(0)
    # Two hashes, 128 bits, stand for a line.
    first = lines.select("_d", "_i", F.xxhash64("_line").alias("a"), F.xxhash64("_line", F.lit(1)).alias("b"), count.cast("int").alias("w"))
    # Ranks by length; repeated rows are one place.
    known = {1: _ranked(first, "lines", once=False)}
    single, found = known[1], [_later(known[1], 1, "false")]
    # Runs of fewer lines than `run`, one line longer each time, for their words.
    for n in range(1, run if words else 1):
        found.append(_later(known[n], n, f"w >= {words}"))
        if n + 1 < run:
            following = single.select("_d", (F.col("_i") - n).cast("int").alias("_i"), F.col("w").alias("_more"))
            both = known[n].join(following, ["_d", "_i"]).withColumn("w", F.least(F.col("w") + F.col("_more"), F.lit(words))).drop("_more")
            known[n + 1] = _longer(both, n, single, "lines")
    at = 1
    while True:
        live = known[at]
        if at >= run:
            found.append(_later(live, at))
        elif 2 * at > run:
            known[run] = _longer(live, run - at, live, "lines")
            found.append(_later(known[run], run))
        if 2 * at not in known:
            known[2 * at] = _longer(live, at, live, "lines")
        at *= 2
        if known[at].isEmpty():
            break
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    lists = every.groupBy("_d").agg(F.collect_list("_at").alias("_at"))

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for ats in b.column(1):
                packed = np.sort(np.asarray(ats.values))
                start, end = packed >> 32, np.maximum.accumulate((packed >> 32) + (packed & 0xFFFFFFFF))
                head = np.concatenate([[True], start[1:] > end[:-1]])
                spans.append(np.stack([start[head], end[np.concatenate([head[1:], [True]])]], 1).ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(pa.int64()))], names=["_d", "_spans"])

    out = table(lists.mapInArrow(merged, "_d long, _spans array<bigint>"), "runs")
    for t in known.values():
        drop_table(t)
    return out


def _few(spans: DataFrame) -> DataFrame:
    """spans, to be broadcast if their counted numbers are few."""
    rows, numbers = spans.agg(F.count("*"), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    return F.broadcast(spans) if rows * 64 + numbers * 16 <= BROADCAST_BYTES else spans


def drop_repeated_lines(docs: DataFrame, run: int = RUN, words: int | None = WORDS, counts: tuple[str, str] | None = ("_n_lines", "_n_removed")) -> DataFrame:
    """docs with all its columns, `text` without the later copies of repeated line runs, and the two columns of `counts` (which replace such ones; None: no such columns).

    A line is what stands between line feeds, compared exactly. Null texts stay null and empty texts empty, with no
    lines. Null doc_ids come before all others and are told apart by their texts; repeated rows (one doc_id, one text)
    are one place: neither removes the other. Documents whose lines all go stay as rows with an empty text. An empty
    table gives no rows. A long text is one row: its lines are ranked as rows, its text is cut in one piece.
    """
    own = [c for c in docs.columns if not counts or c not in counts]
    joined = docs.select(document_key(docs), F.struct(*own).alias("_row"), F.col("text").alias("_text")).join(_few(repeated_runs(docs, run, words)), "_d", "left")
    schema = joined.select("_row", "_text").withColumns({"_lines": F.lit(0).cast("long"), "_removed": F.lit(0).cast("long")}).schema

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, n_lines, removed = [], [], []
            for x, s in zip(b.column("_text"), b.column("_spans"), strict=True):
                text, spans = x.as_py(), s.as_py()
                n_lines.append(text.count("\n") + 1 if text else 0)
                removed.append(sum(spans[1::2]) - sum(spans[::2]) if spans else 0)
                if spans:
                    lines, edges = text.split("\n"), [0, *spans, n_lines[-1]]
                    text = "\n".join(line for i in range(0, len(edges), 2) for line in lines[edges[i] : edges[i + 1]])
                texts.append(text)
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(removed, pa.int64())], names=["_row", "_text", "_lines", "_removed"])

    out = joined.select("_row", "_text", "_spans").mapInArrow(run_batches, schema)
    added = [F.col("_lines").alias(counts[0]), F.col("_removed").alias(counts[1])] if counts else []
    return out.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in own], *added)


def digest(docs: DataFrame, run: int = RUN, words: int | None = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 of the kept text (null text: of the empty one)."""
    out = drop_repeated_lines(docs.select("doc_id", "text"), run, words, ("n_lines", "n_removed"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"))
