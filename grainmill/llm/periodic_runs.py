"""Operator 11: periodic runs of words, from the Lyndon arrays of two opposite orders, after Ellert and Fischer."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress
from operator import gt, lt

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.llm.common import word_array

#: A run has so many words at least, and its period so many times.
LEAST_WORDS, LEAST_PERIODS = 24, 3


def lyndon_array(words: Sequence, less=lt) -> tuple[list[int], list[int]]:
    """For each place: where the next smaller suffix begins (the end, if none), and how many words the two suffixes share.

    `less` orders the alphabet; a suffix that is a prefix of another is the smaller one. The words from a place up to its
    next smaller suffix are the longest Lyndon word there. Places whose next smaller suffix is open form a chain of
    previous smaller ones. A new place is compared along the chain: against the next of the chain, the common extension
    is the least of two known ones if they differ, and goes on from there if they are equal. What was matched last,
    words y..end equal to those d before, is used again: the comparison of two places in it was made d places before, and
    counts up to the end of the match, from where it goes on. So each word is matched anew a constant number of times.
    """
    n = len(words)
    after, shared = [n] * n, [0] * n
    before, tied = [-1] * n, [0] * n
    y = end = d = 0
    for i in range(1, n):
        j, at, mine = i - 1, 0, words[i]
        while True:
            exact = False
            if i < end and j >= y:
                a, b = j - d, i - d
                at = shared[a] if after[a] == b else tied[b] if before[b] == a else at
                exact = at < end - i
                if not exact:
                    at = end - i
            if not exact and (at or words[j] == mine):
                while i + at < n and words[j + at] == words[i + at]:
                    at += 1
                if i + at > end:
                    y, end, d = i, i + at, i - j
            if i + at < n and not less(words[i + at], words[j + at]):
                before[i], tied[i] = j, at
                break
            # The suffix at i is the next smaller one of j, and of all on the chain that share more with j than i does.
            after[j], shared[j] = i, at
            up, j = tied[j], before[j]
            while j >= 0 and up > at:
                after[j], shared[j] = i, at
                up, j = tied[j], before[j]
            if j < 0:
                break
            if up < at:
                before[i], tied[i] = j, up
                break
    return after, shared


def find_runs(words: Sequence, least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all maximal runs of `least` words and `periods` (3 or more) times their smallest period, in order.

    Every run has, in its first period, a longest Lyndon word of one of the two orders whose length is the period; the
    suffixes at its ends share more than a period then, so that the words that go on to the left are paid for.
    """
    if periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    found, known = [], set()
    for less in (lt, gt):
        after, shared = lyndon_array(words, less)
        for i, (j, right) in enumerate(zip(after, shared, strict=True)):
            period = j - i
            if right <= (periods - 2) * period or (period, j + right) in known:
                continue
            left = 0
            while left < i and words[i - left - 1] == words[j - left - 1]:
                left += 1
            length = period + left + right
            if length >= max(least, periods * period):
                known.add((period, j + right))
                found.append((i - left, length, period))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse_runs(docs: DataFrame, text: str = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """doc_id, n_words, runs array<struct<start, length, period>> in order of start and period, kept: the words outside repetitions.

    Words stand between runs of the six white-space characters and are numbered from 0. Of each run the first period
    stays and the rest goes, unless another run has removed it; the kept words are joined by one space. Null, empty and
    blank texts have no words, no runs and an empty kept text. Every row is looked at on its own, so repeated rows and
    null ids have no effect on others; an empty table gives no rows; further columns of docs do not matter. A text is
    read whole, by one task, in time and memory in proportion to its words.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            sizes, every, kept = [], [], []
            for x in b.column(1):
                words = x.as_py().split()
                found = find_runs(words, least, periods)
                if found:
                    stay = bytearray(b"\1") * len(words)
                    for start, length, period in found:
                        stay[start + period : start + length] = bytes(length - period)
                    words, n = list(compress(words, stay)), len(words)
                else:
                    n = len(words)
                sizes.append(n)
                every.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in found])
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(every, shape), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "kept"])

    rows = docs.select("doc_id", F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_bytes"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, kept string")


def planted(doc_id: Column, text: Column) -> Column:
    """The text of a tenth of all documents, by crc32 of the id, with a repetition from some word to its end; others as they are.

    With h = crc32(id), g = h // 10 and n words: if h % 10 = 0, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8). Null ids and texts without words stay as they are.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g, words = F.floor(h / 10), word_array(text)
    n = F.nullif(F.size(words).cast("long"), F.lit(0).cast("long"))
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    tail = F.slice(F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int"))), F.lit(1), (n - a).cast("int"))
    return F.when((h % 10 == 0) & n.isNotNull(), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with most periods (ties: smallest start, then period; all null without runs), digests of the runs and of the kept words."""
    runs = F.col("runs")
    more = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)), lambda top, r: F.when(more(r, top), r).otherwise(top))
    lines = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = collapse_runs(docs).withColumn("_best", best)
    return out.select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), F.col("_best.start").alias("start"), F.col("_best.length").alias("length"), F.col("_best.period").alias("period"),
        F.expr("1000 * _best.length DIV _best.period").alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"),
    )
