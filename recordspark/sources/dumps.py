"""SQL dumps and media probes as sources."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def values(statement: str) -> list[list[str | None]]:
    """The rows of an INSERT statement's VALUES list; quotes doubled inside strings, NULL as None."""
    at = statement.upper().find("VALUES")
    rows: list[list[str | None]] = []
    row: list[str | None] | None = None
    i = at + 6 if at >= 0 else len(statement)
    while i < len(statement):
        c = statement[i]
        if c == "(" and row is None:
            row = []
        elif row is not None and c == "'":
            out = []
            i += 1
            while i < len(statement):
                if statement[i] == "'":
                    if statement[i + 1 : i + 2] != "'":
                        break
                    i += 1
                out.append(statement[i])
                i += 1
            row.append("".join(out))
        elif row is not None and c == ")":
            rows.append(row)
            row = None
        elif row is not None and c not in ", \n\r\t":
            j = i
            while j < len(statement) and statement[j] not in ",)":
                j += 1
            word = statement[i:j].strip()
            row.append(None if word.upper() == "NULL" else word)
            i = j - 1
        i += 1
    return rows


def read_dump(spark: SparkSession, path: str, table: str, columns: Sequence[str]) -> DataFrame:
    """String columns of a table's rows in (compressed) SQL dumps; statements end with ';' and a line end outside strings. Cast what is needed.

    A file's pieces up to every ';' and line end are brought in order to one task, which joins those that a string cuts.
    """
    read = spark.read.option("lineSep", ";\n").text(path)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    pieces = pieces.repartition("file").sortWithinPartitions("file", "block", "n")
    head = re.compile(rf"\s*insert\s+into\s+[\"`]?{re.escape(table)}[\"`]?[\s(]", re.I)

    def parse(batches: Iterator[pd.DataFrame]):
        held, odd, current = [], False, None
        for pdf in batches:
            rows = []
            for file, piece in zip(pdf["file"], pdf["value"]):
                if file != current:
                    held, odd, current = [], False, file
                held.append(piece)
                odd ^= bool(piece.count("'") % 2)
                if odd:  # inside a string, where quotes are doubled
                    continue
                statement = ";\n".join(held)
                held = []
                if head.match(statement):
                    rows += [r[: len(columns)] + [None] * (len(columns) - len(r)) for r in values(statement)]
            yield pd.DataFrame(rows, columns=list(columns), dtype=object)

    return pieces.mapInPandas(parse, ", ".join(f"{c} string" for c in columns))


def probe_pages(rows: DataFrame, column: str = "probe") -> DataFrame:
    """Adds ``pages`` read from a document probe's 'Pages: n' line; null without one."""
    return rows.withColumn("pages", F.nullif(F.regexp_extract(column, r"(?m)^Pages:\s+([0-9]+)", 1), F.lit("")).cast("int"))


def probe_fields(rows: DataFrame, column: str = "probe") -> DataFrame:
    """Adds ``seconds`` and ``has_audio`` read from a media probe's JSON; null where it cannot be read."""
    p = F.from_json(column, "format struct<duration: string>, streams array<struct<codec_type: string>>")
    return rows.withColumns({"seconds": p["format"]["duration"].try_cast("double"), "has_audio": F.exists(p["streams"], lambda s: s["codec_type"] == "audio")})
