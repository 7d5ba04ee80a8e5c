"""Gated matching equals plain matching, for texts made from every pattern and for texts of its characters."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.text import ALIKE, folded, found, hits, hits_folded, matches, needed, openers, strip

ALL = sorted({v for k in dir(P) if k.isupper() and not k.startswith(("META_FIELDS", "MIXED", "ROLES", "PERSONS")) for v in ([*getattr(P, k).values()] if isinstance(getattr(P, k), dict) else getattr(P, k) if isinstance(getattr(P, k), list) else [getattr(P, k)] if isinstance(getattr(P, k), str) else [])})


def example(pattern: str, r: random.Random) -> str:
    """A text that the pattern matches."""

    def walk(items) -> str:
        out = ""
        for kind, value in ((str(k), v) for k, v in items):
            if kind == "LITERAL":
                c = chr(value)
                out += r.choice([c, c, c.upper(), *[k for k, v in ALIKE.items() if v == c.lower()]])
            elif kind == "SUBPATTERN":
                out += walk(value[3])
            elif kind == "BRANCH":
                out += walk(r.choice(value[1]))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                out += "".join(walk(value[2]) for _ in range(r.randint(value[0], min(value[1], value[0] + 2))))
            elif kind == "ANY":
                out += r.choice("    é-x")
            elif kind == "IN":
                op, v = value[0]
                out += {"CATEGORY_SPACE": r.choice([" ", "\t", " ", "\n"]), "CATEGORY_DIGIT": "7"}.get(str(v)) or (chr(v[0]) if str(op) == "RANGE" else chr(v))
        return out

    return walk(re._parser.parse(pattern))


def texts() -> list[str]:
    r = random.Random(5)
    made = [example(p, r) for p in ALL for _ in range(6)]
    around = [r.choice(["", "so ", "x", "é", "ends. ", "_"]) + t + r.choice(["", " now", "y", "é", "!", "_"]) for t in made]
    broken = [t[: (k := r.randrange(len(t) + 1))] + r.choice(["", " ", "z"]) + t[k + 1 :] for t in made]
    return [*made, *around, *broken, "", " ", "नमस्ते दुनिया", "İSTANBUL ſuicidal K"]


def test_gates_lose_nothing(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "i long, t string").withColumn("low", folded(F.col("t")))
    counts = [0] * len(ALL)
    for at in range(0, len(ALL), 40):
        some = ALL[at : at + 40]
        got = df.select("t", F.array(*[found(F.col("low"), p) for p in some]).alias("quick"), F.array(*[matches(F.col("t"), p) for p in some]).alias("plain")).collect()
        for row in got:
            assert row["quick"] == row["plain"], (row["t"], [p for p, a, b in zip(some, row["quick"], row["plain"], strict=True) if a != b])
            for k, x in enumerate(row["plain"]):
                counts[at + k] += x
    # Each pattern has positive and negative cases; anchored ones match fewer.
    assert all(0 < n < len(texts()) for n in counts), [p for p, n in zip(ALL, counts, strict=True) if not n]


def test_counts_equal(spark):
    df = spark.createDataFrame([(t,) for t in texts()], "t string").withColumn("low", folded(F.col("t")))
    for p in (P.CLEAN_HINDI, P.NEGATIVE_WORDS, P.POSITIVE_WORDS):
        plain = F.regexp_count("t", F.lit(f"(?iuU){p}"))
        assert df.where(plain != hits_folded(F.col("low"), p)).count() == 0
    assert df.where(F.regexp_count("t", F.lit(f"(?U){P.CLEAN_ENGLISH}")) != hits(F.col("t"), P.CLEAN_ENGLISH)).count() == 0


def test_syntax_is_read():
    assert needed(r"\bkill\s+(them|him|my\s+family)\b") == (("kill",), ("family", "him", "them"))
    assert needed(r"\b(a|b)?c\b") == () and openers(r"\b(ab|c)?(d|e)\b") == frozenset("acde") and openers(r"\w+") is None


def test_strip_is_unicode(spark):
    odd = ["  a b \n", "\x1c\x85\xa0a ", "　", "", "​a​", "﻿ x", None, "᠎a"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in odd], "t string").select(strip(F.col("t"))).collect()]
    assert got == [None if t is None else t.strip() for t in odd]
