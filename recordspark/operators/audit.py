"""Audits: stored objects against targets, conflicting targets, page findings, text accuracy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.config import CONFIDENCE_BANDS
from recordspark.functions.records import media_type


def compare_targets(targets: DataFrame, inventory: DataFrame) -> DataFrame:
    """Findings (key, kind, problem) of targets (key, kind, expected_size, expected_type) against inventory (key, size, content_type)."""
    held = inventory.select("key", F.col("size").alias("actual_size"), media_type(F.col("content_type")).alias("actual_type"), F.lit(True).alias("held"))
    t = targets.withColumn("expected_type", media_type(F.col("expected_type")))
    problem = (
        F.when(F.col("held").isNull(), "missing")
        .when(F.col("actual_size") == 0, "zero-byte")
        .when((F.coalesce("expected_size", F.lit(0)) != 0) & (F.col("actual_size") != F.col("expected_size")), "size-mismatch")
        .when(F.col("expected_type") != F.col("actual_type"), "type-mismatch")
    )
    return t.join(held, "key", "left").select("key", "kind", problem.alias("problem")).filter("problem is not null")


def unreferenced(targets: DataFrame, inventory: DataFrame) -> DataFrame:
    return inventory.join(targets.select("key").distinct(), "key", "left_anti")


def union_targets(*parts: DataFrame) -> DataFrame:
    """Targets of all generators (key, kind, expected_size, expected_type): the first generator's row per key, and whether rows differ."""
    every = None
    for n, p in enumerate(parts):
        p = p.select("key", "kind", "expected_size", "expected_type", F.lit(n).alias("prio"))
        every = p if every is None else every.unionByName(p)
    first = F.min(F.struct("prio", "kind", "expected_size", "expected_type"))
    differ = F.count_distinct(F.struct(F.coalesce("expected_size", F.lit(-1)), F.coalesce("expected_type", F.lit("")))) > 1
    return every.groupBy("key").agg(first.alias("f"), differ.alias("conflict")).select("key", "f.kind", "f.expected_size", "f.expected_type", "conflict")


def duplicate_keys(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def band(confidence) -> F.Column:
    """Confidence band of a value; null outside all."""
    out = None
    for name, low, high in CONFIDENCE_BANDS:
        hit = (confidence >= low) & (confidence < high)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def accuracy_by_band(scored: DataFrame) -> DataFrame:
    """Per band of (band, ref_chars, char_edits): pages and micro-averaged error rate; bands without pages stand with 0."""
    spark = scored.sparkSession
    bands = spark.createDataFrame([(b[0],) for b in CONFIDENCE_BANDS], "band string")
    got = scored.groupBy("band").agg(F.count(F.lit(1)).alias("pages"), F.sum("char_edits").alias("edits"), F.sum("ref_chars").alias("chars"))
    out = bands.join(got, "band", "left").na.fill(0, ["pages", "edits", "chars"])
    return out.select("band", "pages", "edits", "chars", F.round(F.col("edits") / F.greatest("chars", F.lit(1)), 6).alias("cer"))
