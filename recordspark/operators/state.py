"""Incremental state: insert if absent, upsert, latest row, worklists, claims, packing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.session import cut


def insert_if_absent(new: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """New rows whose key no existing row has."""
    return new.join(existing.select(*keys).distinct(), keys, "left_anti")


def latest(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The last row of every key by ``order`` (descending expressions)."""
    w = W.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def keep_newest(rows: DataFrame, keys: list[str], keep: int, *order: str, parts: int = 64) -> DataFrame:
    """Rows beyond the ``keep`` greatest of their key by the columns ``order``, that is, those to delete; equal rows count as one.

    The greatest are found per part of a key first and then among those, so that few keys with many rows are no single tasks.
    """
    marked = rows.withColumns({"_o": F.struct(*order), "_k": F.struct(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(k) for k in keys])})
    one = marked.select("_k", "_o").distinct().withColumn("_p", F.pmod(F.xxhash64("_o"), F.lit(parts)))
    first = one.withColumn("_rn", F.row_number().over(W.partitionBy("_k", "_p").orderBy(F.desc("_o")))).filter(F.col("_rn") <= keep)
    last = first.withColumn("_rn", F.row_number().over(W.partitionBy("_k").orderBy(F.desc("_o")))).filter(F.col("_rn") == keep).select("_k", F.col("_o").alias("_least"))
    return marked.join(last, "_k").filter("_o < _least").drop("_o", "_k", "_least")


def positions(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """Adds ``position``, from 1, of every row within its key by the columns ``order``, which make rows differ.

    Rows are ranged by key and order over the cluster and numbered per range, so that a key of many rows is no single task; nulls come first.
    """
    placed = cut(rows.repartitionByRange(key, *order).withColumn("_part", F.spark_partition_id()))
    sizes = placed.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    begin = sizes.select(F.col(key).alias("_k"), F.col("_part").alias("_q"), (F.sum("_n").over(W.partitionBy(key).orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = placed.withColumn("_rn", F.row_number().over(W.partitionBy(key, "_part").orderBy(*order)))
    return numbered.join(begin, (F.col("_part") == F.col("_q")) & F.col(key).eqNullSafe(F.col("_k"))).withColumn("position", F.col("_rn") + F.col("_before")).drop("_part", "_rn", "_k", "_q", "_before")


def upsert_texts(held: DataFrame, runs: DataFrame) -> DataFrame:
    """Text rows after reruns (document_id, status, full_text).

    A success replaces the text, a success without text deletes it, a failure leaves the last good text.
    """
    r = runs.select("document_id", "status", F.col("full_text").alias("new_text"))
    both = held.join(r, "document_id", "full_outer")
    good = F.coalesce(F.col("status") == "success", F.lit(False))
    blank = F.trim(F.coalesce("new_text", F.lit(""))) == ""
    kept = both.filter(~(good & blank)).withColumn("full_text", F.when(good, F.col("new_text")).otherwise(F.col("full_text")))
    return kept.filter("full_text is not null").select("document_id", "full_text")


def worklist(pending: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Pending rows that are not done."""
    return pending.join(done.select(key).distinct(), key, "left_anti")


def claim(pending: DataFrame, k: int, *order: Column) -> DataFrame:
    """The next k rows; the same rows for the same state."""
    return pending.orderBy(*order).limit(k)


def batches(rows: DataFrame, key: str, page: str, most: int = 10) -> DataFrame:
    """Rows (key, batch, first, last, pages): runs of following pages in batches of at most ``most``."""
    island = F.col(page) - F.row_number().over(W.partitionBy(key).orderBy(page))
    marked = rows.select(key, page).distinct().withColumn("island", island)
    n = F.floor((F.row_number().over(W.partitionBy(key, "island").orderBy(page)) - 1) / most)
    return marked.withColumn("n", n).groupBy(key, "island", "n").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.count(F.lit(1)).alias("pages")).select(key, "first", "last", "pages")


def packs(rows: DataFrame, group: str, order: str, size: Column, budget: int) -> DataFrame:
    """Rows with the pack their running size falls into, per group; ranges of rows are summed apart and added up."""
    placed = cut(rows.withColumn("_size", size).repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    sums = placed.groupBy(group, "_part").agg(F.sum("_size").alias("_s"))
    begin = sums.select(F.col(group).alias("_k"), F.col("_part").alias("_q"), (F.sum("_s").over(W.partitionBy(group).orderBy("_part")) - F.col("_s")).alias("_before"))
    running = F.sum("_size").over(W.partitionBy(group, "_part").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    summed = placed.withColumn("_run", running).join(begin, (F.col("_part") == F.col("_q")) & F.col(group).eqNullSafe(F.col("_k")))
    return summed.withColumn("pack", F.floor((F.col("_run") + F.col("_before") - F.col("_size")) / budget).cast("int")).drop("_size", "_part", "_run", "_k", "_q", "_before")
