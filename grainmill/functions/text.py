"""Text functions with one meaning everywhere: Unicode-aware matching, white space, fingerprints, normal forms."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: White space as in Python's str.strip and \s: Unicode spaces and the four separators.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
#: Neither letter, digit, underscore nor white space; marks count as such, so they are taken off.
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


#: The characters of SPACE, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000"
#: Characters that match an ASCII letter without regard to case, beyond that letter's own two forms.
ALIKE = {"ſ": "s", "ı": "i", "İ": "i", "\u212a": "k"}


def cased(pattern: str, flags: str = "") -> str:
    """A Java pattern whose classes and \\b are Unicode-aware."""
    return f"(?U{flags}){pattern}"


def anycase(pattern: str, flags: str = "") -> str:
    """The same, without regard to case."""
    return f"(?iuU{flags}){pattern}"


def matches(text: Column, pattern: str) -> Column:
    """Whether the pattern is found, without regard to case; null text: false."""
    return F.coalesce(text.rlike(anycase(pattern)), F.lit(False))


def folded(text: Column) -> Column:
    """Lower case in which an ASCII letter stands wherever a pattern without regard to case would take it."""
    for c, plain in ALIKE.items():
        text = F.replace(text, F.lit(c), F.lit(plain))
    return F.lower(text)


@lru_cache(None)
def needed(pattern: str) -> tuple[tuple[str, ...], ...]:
    """Sets of lower-case literals, from the pattern's syntax: each match of it, folded, holds one of each set.

    A literal run outside of all choices is a set of its own; a choice gives the best set of each of its branches
    together; what may be absent gives nothing.
    """
    shortest = lambda literals: min(map(len, literals))

    def walk(items) -> list[set[str]]:
        sets, run = [], ""
        for kind, value in [*((str(k), v) for k, v in items), ("END", None)]:
            if kind == "LITERAL" and value < 128:
                run += chr(value).lower()
                continue
            if run:
                sets.append({run})
                run = ""
            if kind == "SUBPATTERN":
                sets += walk(value[3])
            elif kind == "BRANCH":
                best = [max(walk(b), key=shortest, default=None) for b in value[1]]
                if all(best):
                    sets.append(set().union(*best))
            elif kind in ("MAX_REPEAT", "MIN_REPEAT") and value[0] > 0:
                sets += walk(value[2])
        return sets

    found = sorted(walk(re._parser.parse(pattern)), key=lambda x: (-shortest(x), len(x)))
    good = [x for x in found if shortest(x) >= 3] or [x for x in found if shortest(x) >= 2][:1]
    return tuple(dict.fromkeys(tuple(sorted(x)) for x in good))


@lru_cache(None)
def openers(pattern: str) -> frozenset[str] | None:
    """The characters that a match can begin with; None if the syntax does not tell."""

    def walk(items) -> tuple[set[str] | None, bool]:
        """(first characters, whether the items may be empty)."""
        chars: set[str] = set()
        for kind, value in ((str(k), v) for k, v in items):
            if kind == "AT":
                continue
            if kind == "LITERAL":
                got, empty = {chr(value)}, False
            elif kind == "IN":
                got, empty = ({chr(v) for _, v in value} if all(str(k) == "LITERAL" for k, _ in value) else None), False
            elif kind == "SUBPATTERN":
                got, empty = walk(value[3])
            elif kind == "BRANCH":
                each = [walk(b) for b in value[1]]
                got = None if any(g is None for g, _ in each) else set().union(*(g for g, _ in each))
                empty = any(e for _, e in each)
            elif kind in ("MAX_REPEAT", "MIN_REPEAT"):
                got, empty = walk(value[2])
                empty = empty or value[0] == 0
            else:
                got, empty = None, False
            if got is None:
                return None, False
            chars |= got
            if not empty:
                return chars, False
        return chars, True

    chars, empty = walk(re._parser.parse(pattern))
    plain = chars and not empty and all(c.isascii() and (c.isalnum() or c == "'") for c in chars)
    return frozenset(chars) if plain else None


def quick(pattern: str) -> str:
    """The same pattern, Unicode-aware, with a look at the next character before the costlier word boundaries."""
    chars = openers(pattern)
    return cased(f"(?=[{''.join(sorted(chars))}])(?:{pattern})" if chars else pattern)


def may_match(low: Column, pattern: str) -> Column:
    """False only where the pattern cannot match a text whose folded form is `low`: plain searches, some nanoseconds a byte."""
    gate = F.lit(True)
    for literals in needed(pattern):
        some = low.contains(literals[0])
        for x in literals[1:]:
            some = some | low.contains(x)
        gate = gate & some
    return gate


def found(low: Column, pattern: str) -> Column:
    """As matches(text, pattern), where `low` is folded(text), best in a column of its own.

    The pattern runs only on the few texts that hold its literals, and needs no case folding of its own there.
    """
    return F.coalesce(may_match(low, pattern) & low.rlike(quick(pattern.lower())), F.lit(False))


class WordRule(NamedTuple):
    r"""How a pattern of the shape \b(a|b\s+c|...)\b is decided from the words of a text.

    single: words that match by themselves; keys: for each choice of several words, one that any match holds; rest:
    choices that are no plain words, as patterns.
    """

    single: tuple[str, ...]
    keys: tuple[str, ...]
    rest: tuple[str, ...]


@lru_cache(None)
def word_rule(pattern: str) -> WordRule | None:
    """The rule of a pattern of that shape; None for others."""
    if not (pattern.startswith(r"\b(") and pattern.endswith(r")\b")):
        return None
    inner, depth, choices, at = pattern[3:-3], 0, [], 0
    for i, c in enumerate(inner):
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return None
        if c == "|" and not depth:
            choices.append(inner[at:i])
            at = i + 1
    single, keys, rest = [], [], []
    for choice in [*choices, inner[at:]]:
        words = re.split(r"\\s\+| ", choice.lower())
        if not all(re.fullmatch("[a-z0-9_]+", w) for w in words):
            rest.append(rf"\b(?:{choice})\b")
        elif len(words) == 1:
            single.append(words[0])
        else:
            keys.append(max(words, key=len))
    return WordRule(tuple(dict.fromkeys(single)), tuple(dict.fromkeys(keys)), tuple(rest))


def word_hits(low: Column, patterns: Sequence[str]) -> Column:
    """The distinct words of folded(text) that the rules of the patterns ask for: one pass over the text for all of them."""
    asked = dict.fromkeys(w for p in patterns if (rule := word_rule(p)) for w in (*rule.single, *rule.keys))
    return F.array_intersect(F.split(low, r"(?U)\W+"), F.array(*[F.lit(w) for w in asked]))


def _any_word(hits: Column, words: Sequence[str]) -> Column:
    return F.arrays_overlap(hits, F.array(*[F.lit(w) for w in words])) if words else F.lit(False)


def found_words(low: Column, hits: Column, pattern: str) -> Column:
    """As found(low, pattern), with hits = word_hits(low, ...) over this pattern too, best in a column of its own.

    A pattern of single words is decided by the hits; its longer choices are looked for only where a word of theirs is there.
    """
    rule = word_rule(pattern)
    if rule is None:
        return found(low, pattern)
    maybe = _any_word(hits, rule.keys)
    for choice in rule.rest:
        maybe = maybe | may_match(low, choice)
    longer = (maybe & low.rlike(quick(pattern.lower()))) if rule.keys or rule.rest else F.lit(False)
    return F.coalesce(_any_word(hits, rule.single) | longer, F.lit(False))


def count_words(low: Column, hits: Column, pattern: str) -> Column:
    """As hits_folded(low, pattern): how often the pattern is found; texts without a word of it are not searched."""
    rule = word_rule(pattern)
    if rule is None:
        return hits_folded(low, pattern)
    maybe = _any_word(hits, (*rule.single, *rule.keys))
    for choice in rule.rest:
        maybe = maybe | may_match(low, choice)
    return F.when(maybe, F.coalesce(F.regexp_count(low, F.lit(quick(pattern.lower()))), F.lit(0))).otherwise(0)


def any_of(patterns: Sequence[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def hits(text: Column, pattern: str) -> Column:
    """How many times the pattern is found, without overlaps and with regard to case."""
    return F.coalesce(F.regexp_count(text, F.lit(quick(pattern))), F.lit(0))


def hits_folded(low: Column, pattern: str) -> Column:
    """The same without regard to case, where `low` is folded(text); not run on texts without the pattern's literals."""
    return F.when(may_match(low, pattern), hits(low, pattern.lower())).otherwise(0)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """Runs of white space as one space."""
    return F.regexp_replace(text, rf"(?U){SPACE}+", " ")


def word_list(text: Column) -> Column:
    """Words between white space, as str.split gives them."""
    return F.filter(F.split(strip(text), rf"(?U){SPACE}+"), lambda w: w != "")


def fingerprint(text: Column) -> Column:
    """MD5 of the lower-case words without punctuation and marks, single-spaced."""
    return F.md5(strip(squeeze(F.regexp_replace(F.lower(text), rf"(?U){NOT_WORD}", ""))))


def seed_fingerprint(text: Column) -> Column:
    """The seed set's variant: spaces are squeezed before punctuation goes, so a lone dash leaves two."""
    return F.md5(F.regexp_replace(squeeze(strip(F.lower(text))), rf"(?U){NOT_WORD}", ""))


def quoted(value: Column) -> Column:
    """As Python quotes a string, for printable text."""
    one = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    plain = F.concat(F.lit("'"), F.replace(one, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(value.contains("'") & ~value.contains('"'), F.concat(F.lit('"'), one, F.lit('"'))).otherwise(F.when(value.contains("'"), plain).otherwise(F.concat(F.lit("'"), one, F.lit("'"))))


def messages(*items: Column) -> Column:
    """An array of the items that are not null, in order."""
    return F.filter(F.array(*items), lambda x: x.isNotNull())


@lru_cache(1)
def unsettled() -> str:
    """A class of all characters that composition may change: marks, vowel and final jamo, and characters that are not composed themselves."""
    alone = [c for c in range(0x80, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and unicodedata.normalize("NFC", chr(c)) != chr(c)]
    runs, start = [], None
    for i, c in enumerate(alone):
        start = c if start is None else start
        if i + 1 == len(alone) or alone[i + 1] != c + 1:
            runs.append(f"\\x{{{start:X}}}-\\x{{{c:X}}}")
            start = None
    return r"[\p{M}\x{1161}-\x{11C2}" + "".join(runs) + "]"


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def composed(text: Column) -> Column:
    """Unicode NFC. Only texts that it may change go through Python, in Arrow batches; Spark has no such function.

    Nothing below U+0300 changes or joins; the long class of what does is searched only in texts with others.
    """
    other = (F.octet_length(text) > F.length(text)) & text.rlike(r"[^\x{0}-\x{2FF}]")
    return F.coalesce(_composed(F.when(other & text.rlike(unsettled()), text)), text)
