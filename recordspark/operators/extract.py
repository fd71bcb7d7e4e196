"""Pluggable extractors: named entities, page text, media probes.

Heavy libraries plug in as functions from a batch of rows to a batch of spans; the
relational part around them is the same for all. Without any, a stand-in marks runs
of capitalised words, inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.functions.names import display_name, is_junk_name
from recordspark.functions.text import is_readable

RUN = r"\b[A-ZÀ-Þ][\p{L}'’\-]+(?: [A-ZÀ-Þ][\p{L}'’\-]+){1,3}"


def extract(texts: DataFrame, spans: Callable[[pd.DataFrame], pd.DataFrame], schema: str = "document_id bigint, name string, label string, start int") -> DataFrame:
    """Spans found by a plugged-in extractor, batch by batch."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            yield spans(pdf)

    return texts.mapInPandas(run, schema)


def capitalised_runs(texts: DataFrame, least_words: int = 50, most_chars: int | None = None) -> DataFrame:
    """Rows (document_id, name, n): the stand-in's names in readable texts of more than ``least_words``, junk left out; of whole texts unless ``most_chars`` is given."""
    base = texts.select("document_id", (F.col("full_text") if most_chars is None else F.substring("full_text", 1, most_chars)).alias("t"), "word_count").filter(F.col("word_count") > least_words).filter(is_readable(F.col("t")))
    found = base.select("document_id", F.explode(F.regexp_extract_all("t", F.lit(RUN), F.lit(0))).alias("raw"))
    named = found.select("document_id", display_name(F.col("raw")).alias("name")).filter(~is_junk_name(F.col("name")))
    return named.groupBy("document_id", "name").agg(F.count(F.lit(1)).alias("n"))
