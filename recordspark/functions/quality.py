"""Column functions of text and scan quality: confidences, error rates, sensitivity, rectangles."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from recordspark.functions.text import squeeze

# Shapes of sensitive content under a redaction (case-insensitive).
SENSITIVE_SHAPES = (
    r"\b[A-Z][a-z]+ [A-Z][a-z]+\b",
    r"\b\d{3}[-.\s]?\d{3}[-.\s]?\d{4}\b",
    r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b",
    r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b",
    r"\b\d+\s+[A-Z][a-z]+\s+(Street|St|Avenue|Ave|Road|Rd|Drive|Dr)\b",
    r"\b(age|aged)\s*:?\s*\d{1,2}\b",
    r"\b\d{1,2}\s*(years?\s*old|y/?o)\b",
)


def sensitivity(c: Column) -> Column:
    """Score from 0 to 1 of hidden text; only the score ever leaves the engine."""
    t = F.coalesce(c, F.lit(""))
    hits = reduce(lambda a, b: a + b, (t.rlike("(?i)" + p).cast("int") for p in SENSITIVE_SHAPES))
    score = hits / len(SENSITIVE_SHAPES) + F.when(F.length(t) > 20, 0.1).otherwise(0.0) + F.when(F.length(t) > 100, 0.2).otherwise(0.0)
    return F.round(F.least(score, F.lit(1.0)), 6)


def cer(reference: Column, hypothesis: Column) -> Column:
    """Character error rate after squeezing white space."""
    r, h = squeeze(reference), squeeze(hypothesis)
    return F.levenshtein(r, h) / F.greatest(F.length(r), F.lit(1))


def edit_distance(a: list, b: list) -> int:
    """Edits between two sequences."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (x != y))
    return row[-1]


@F.pandas_udf(IntegerType())
def word_edits(reference: pd.Series, hypothesis: pd.Series) -> pd.Series:
    """Word edits between two texts; there is no built-in for word tokens."""
    return pd.Series([edit_distance((a or "").split(), (b or "").split()) for a, b in zip(reference, hypothesis)], dtype="int32")


def overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Whether two rectangles touch."""
    return ~((ax1 < bx0) | (bx1 < ax0) | (ay1 < by0) | (by1 < ay0))


def redaction_sized(width: Column, height: Column, page_width: Column, page_height: Column) -> Column:
    """Whether a rectangle is as large as redactions are: neither a dot or rule nor the whole width or a large part of the page."""
    return (width > 10) & (width < page_width * 0.95) & (height > 5) & (height < F.greatest(F.lit(100.0), page_height * 0.15))


def dark_fill(fill: Column) -> Column:
    """Whether a fill's first three colour parts are all nearly black; no fill is none."""
    return F.coalesce((F.size(fill) > 0) & (F.array_max(F.slice(fill, 1, 3)) <= 0.1), F.lit(False))


def word_figures(words: DataFrame, keys: list[str], line: list[str]) -> DataFrame:
    """Rows (keys, confidence, dense) of recognised words (keys, line, text, conf).

    Words are those with text and a confidence from 0 to 100; ``confidence`` is their mean as a share, ``dense`` the share that stands in lines of three or more.
    """
    kept = words.filter((F.trim(F.coalesce("text", F.lit(""))) != "") & (F.col("conf") >= 0))
    lines = kept.groupBy(*keys, *line).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("s"))
    return lines.groupBy(*keys).agg((F.sum("s") / F.sum("n") / 100).alias("confidence"), (F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)) / F.sum("n")).alias("dense"))


def hybrid_pages(native: Column, ocr: Column, confidences: Column, least: int = 50, adds: float = 1.25) -> Column:
    """(pages, confidence, method) of a document's native page texts, their recognised texts and confidences, page by page.

    A page of fewer than ``least`` characters takes the recognised text where that adds materially; the mean confidence is over pages with text, native ones being sure.
    """
    bare = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    pages = F.transform(
        F.arrays_zip(native.alias("n"), ocr.alias("o"), confidences.alias("c")),
        lambda p: F.struct(((bare(p["n"]) < least) & (bare(p["o"]) > 0) & ((bare(p["n"]) == 0) | (bare(p["o"]) > bare(p["n"]) * adds))).alias("taken"), p["n"].alias("n"), p["o"].alias("o"), p["c"].alias("c")),
    )
    out = F.transform(pages, lambda p: F.struct(F.when(p["taken"], p["o"]).otherwise(F.coalesce(p["n"], F.lit(""))).alias("text"), F.when(p["taken"], p["c"]).otherwise(F.lit(1.0)).alias("c"), p["taken"].alias("taken")))
    filled = F.filter(out, lambda p: bare(p["text"]) > 0)
    mean = F.when(F.size(filled) > 0, F.aggregate(filled, F.lit(0.0), lambda a, p: a + p["c"]) / F.size(filled)).otherwise(F.lit(0.0))
    used, real = F.exists(out, lambda p: p["taken"]), F.exists(native, lambda n: bare(n) >= least)
    return F.struct(F.transform(out, lambda p: p["text"]).alias("pages"), mean.alias("confidence"), F.when(used & real, "hybrid").when(used, "ocr").otherwise("native").alias("method"))


def redaction_status(issues: Column, redacted_pages: Column, pages: Column) -> Column:
    return F.when(issues > 0, "improper").when(redacted_pages > 0.5 * pages, "heavy").when(redacted_pages > 0, "clean").otherwise("none")


def clamp_probability(logprob: Column) -> Column:
    return F.least(F.greatest(F.exp(logprob), F.lit(0.0)), F.lit(1.0))


def better(new: Column, old: Column, least: float = 0.5) -> Column:
    """Whether a rerun's confidence is good enough and better."""
    return (new >= least) & (new > F.coalesce(old, F.lit(0.0)))
