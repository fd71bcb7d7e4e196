"""Event-time windows: rate limits over batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def over_limit(events: DataFrame, ts: str, key: str, limit: int, width: str = "60 seconds", late: str | None = None) -> DataFrame:
    """Rows (key, minute, n) of keys with more than ``limit`` events in a fixed window.

    Works on a stream as well; ``late`` is then the watermark after which a window closes.
    """
    if late is not None:
        events = events.withWatermark(ts, late)
    n = events.groupBy(F.window(ts, width), F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.filter(F.col("n") > limit).select("key", F.col("window.start").alias("minute"), "n")
