"""Structured Streaming forms of the archive's incremental work."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from recordspark.operators.fts import BUCKETS, build_postings


def file_stream(spark: SparkSession, path: str, schema: StructType, per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def drain(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Process all there is, resume where the last run ended, stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sync_index(path: str) -> Callable[[DataFrame, int], None]:
    """A batch function that puts changed texts into a log of postings, newest batch last.

    A batch is a partition of its own and is overwritten when it is run again, so a retried batch does not count twice. Readers take, per document, the postings of its greatest batch: see ``current_postings``.
    """

    def each(batch: DataFrame, number: int) -> None:
        p = build_postings(batch).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
        p.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
        batch.select("document_id").distinct().write.mode("overwrite").parquet(f"{path}/seen/batch={number}")

    return each


def current_postings(spark: SparkSession, path: str) -> DataFrame:
    newest = spark.read.parquet(f"{path}/seen").groupBy("document_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/postings").join(newest, ["document_id", "batch"], "left_semi").select("term", "document_id", "pos")


def latest_status(logs: DataFrame) -> DataFrame:
    """Streaming latest status per document (complete or update mode)."""
    return logs.groupBy("document_id").agg(F.max_by(F.struct("status", "action"), F.struct("created_at", "id")).alias("s")).select("document_id", "s.status", "s.action")
