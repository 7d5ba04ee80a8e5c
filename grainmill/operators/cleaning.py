"""Rule-based cleaning: one cascade of projections, and a reason for each row that it rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainmill.functions import patterns as P
from grainmill.functions.text import SPACE, cased, composed, folded, found, hits, hits_folded, strip
from grainmill.sources.scratch import table

MIN_LENGTH, MAX_LENGTH = 8, 1200
ZERO_WIDTH = "​‌‍﻿­"


def is_meta(low: Column) -> Column:
    """low: folded(text)."""
    return found(low, P.META_LANGUAGE)


def _where(gate: Column, text: Column, pattern: str, new: str) -> Column:
    """regexp_replace where `gate`, a plain search, says that there may be something to replace."""
    return F.when(gate, F.regexp_replace(text, pattern, new)).otherwise(text)


#: The steps of scrub() after composition, in order: each takes a text and gives a text.
STEPS = (
    lambda t: _replaced(t, ZERO_WIDTH),
    lambda t: _where(t.contains("&"), t, "&[a-z]+;|&#[0-9]+;", " "),
    lambda t: _where(t.contains("http") | t.contains("www."), t, cased(r"https?://\S+|www\.\S+"), "[link]"),
    lambda t: F.regexp_replace(t, "([?!.,]){3,}", "$1$1"),
    lambda t: _where(t.contains("  ") | t.contains("\t"), t, "[ \t]{2,}", " "),
    lambda t: strip(_where(t.contains("\n\n\n"), t, "\n{3,}", "\n\n")),
)
URL_STEP = 2


def _replaced(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def scrub(df: DataFrame, text: str, output: str, strip_urls: bool = True, compose: bool = True) -> DataFrame:
    """df with output: the text after all steps before the length limits, in order.

    Each step is a projection of its own, since it reads the step before more than once.
    """
    df = df.withColumn(output, composed(F.col(text)) if compose else F.col(text))
    for i, step in enumerate(STEPS):
        if strip_urls or i != URL_STEP:
            df = df.withColumn(output, step(F.col(output)))
    return df


def shorten(text: Column, most: int = MAX_LENGTH) -> Column:
    return F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), rf"(?U){SPACE}+\z", "")).otherwise(text)


def corrected_language(text: Column, low: Column, language: Column) -> Column:
    """English with three Hindi markers is mixed; mixed without any and with three English markers is English. low: folded(text), in a column of its own."""
    hindi, english = hits_folded(low, P.CLEAN_HINDI), hits(text, P.CLEAN_ENGLISH)
    return F.when((language == "en") & (hindi >= 3), "hi-en-mix").when((language == "hi-en-mix") & (hindi == 0) & (english >= 3), "en").otherwise(language)


def clean(df: DataFrame, text: str = "text", language: str = "language", min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, strip_urls: bool = True) -> DataFrame:
    """df with text and language replaced, and _original_text, _language_corrected, _drop_reason (null: accepted).

    Null text counts as empty, null language as English. Rejected rows keep their original text.
    """
    df = df.withColumns({"_original_text": F.coalesce(F.col(text), F.lit("")), "_gm_given": F.coalesce(F.col(language), F.lit("en"))})
    df = scrub(df.withColumn("_gm_low", folded(F.col("_original_text"))), "_original_text", "_gm_scrubbed", strip_urls)
    reason = F.when(is_meta(F.col("_gm_low")), "meta_language_detected").when(F.length("_gm_scrubbed") < min_length, "too_short")
    df = df.withColumns({"_drop_reason": reason, "_gm_scrubbed": shorten(F.col("_gm_scrubbed"), max_length)})
    df = df.withColumn("_gm_low", folded(F.col("_gm_scrubbed")))
    df = df.withColumn("_gm_fixed", F.when(F.col("_drop_reason").isNull(), corrected_language(F.col("_gm_scrubbed"), F.col("_gm_low"), F.col("_gm_given"))).otherwise(F.col("_gm_given")))
    kept = F.col("_drop_reason").isNull()
    df = df.withColumns({text: F.when(kept, F.col("_gm_scrubbed")).otherwise(F.col("_original_text")), language: F.col("_gm_fixed"), "_language_corrected": F.col("_gm_fixed") != F.col("_gm_given")})
    return df.drop("_gm_given", "_gm_low", "_gm_scrubbed", "_gm_fixed")


def settled(df: DataFrame) -> DataFrame:
    """df, each row through a generator: a filter on what follows stays above it.

    For a filter on clean()'s outcome where no table can be written between, as in a stream. Spark moves a filter below the projections that it reads,
    where the steps of the cascade are written into each other: each is read up to three times by the next, so the last has hundreds of the first.
    """
    return df.select(F.inline(F.array(F.struct(*[df[c] for c in df.columns]))))


def split_clean(df: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows: the cascade runs once, into a table in the shared folder, and both are filters on it."""
    done = table(clean(df, **options), "cleaned")
    return done.where("_drop_reason IS NULL").drop("_drop_reason"), done.where("_drop_reason IS NOT NULL")
