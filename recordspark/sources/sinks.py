"""Writers: sorted tables, size-bounded chunks, JSON reports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_sorted(rows: DataFrame, path: str, partition_keys: list[str], order: list, files: int | None = None) -> None:
    """Rows ranged by ``partition_keys`` and sorted by ``order`` within, so that a key's rows lie together in one file."""
    ranged = rows.repartitionByRange(files, *partition_keys) if files else rows.repartitionByRange(*partition_keys)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_report(rows: DataFrame, path: str, name: str) -> None:
    """Findings as JSON lines under the report's name."""
    rows.withColumn("report", F.lit(name)).write.mode("overwrite").json(path)


def chunked(rows: DataFrame, group: str, key: str, size: str, budget: int) -> DataFrame:
    """Rows (group, key, chunk): greedy chunks of at most ``budget``, a row never split; a larger row is a chunk alone.

    Groups are independent, so they are packed by different tasks; within one the packing is sequential by nature.
    """

    def pack(batches: Iterator[pd.DataFrame]):
        held, number, current = 0, -1, None
        for pdf in batches:
            out = []
            for g, s in zip(pdf[group].tolist(), pdf[size].tolist()):
                s = 0 if s is None or s != s else int(s)
                if g != current:
                    current, number, held = g, 0, 0
                elif held and held + s > budget:
                    number, held = number + 1, 0
                held += s
                out.append(number)
            yield pd.DataFrame({group: pdf[group], key: pdf[key], "chunk": out}).astype({"chunk": "int32"})

    schema = f"{group} {rows.schema[group].dataType.simpleString()}, {key} {rows.schema[key].dataType.simpleString()}, chunk int"
    return rows.select(group, key, size).repartition(group).sortWithinPartitions(group, key).mapInPandas(pack, schema)
