"""Litigation load files: delimited metadata (DAT) and page rows (OPT)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.operators.state import positions

QUOTE, FIELD = "þ", "\x14"


def _lines(spark: SparkSession, path: str, encoding: str) -> DataFrame:
    """Rows (file, line_no, line) of the lines that are not blank, numbered from 0 over all lines of a file.

    Files are read in splits; a line's number comes from counts per range, see ``positions``.
    """
    utf8 = encoding.upper().replace("_", "-") in ("UTF-8", "UTF8")
    reader = spark.read.option("sep", "\u0001").option("quote", "").option("escape", "").option("encoding", encoding).option("ignoreLeadingWhiteSpace", False).option("maxCharsPerColumn", -1).schema("value string")
    read = spark.read.text(path) if utf8 else reader.csv(path)
    raw = read.select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_n"))
    rows = positions(raw, "file", "_block", "_n").select("file", (F.col("position") - 1).alias("line_no"), F.regexp_replace(F.regexp_replace("line", "^\ufeff", ""), "\r$", "").alias("line"))
    return rows.filter(F.trim("line") != "")


def read_dat(spark: SparkSession, path: str, columns: Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """One string column per named header field; empty and missing fields are null, short rows padded.

    ``columns`` are header names; a file's own header row says where they stand.
    """
    cells = F.transform(F.split("line", QUOTE + FIELD + QUOTE), lambda c: F.nullif(F.regexp_replace(c, f"^[{QUOTE}{FIELD}\\s]+|[{QUOTE}{FIELD}\\s]+$", ""), F.lit("")))
    rows = _lines(spark, path, encoding).withColumn("cells", cells)
    first = rows.filter("line_no = 0").select("file", F.col("cells").alias("header"))
    body = rows.filter("line_no > 0").join(first, "file")
    at = lambda n: F.array_position("header", F.lit(n)).cast("int")
    return body.select("file", "line_no", *[F.when(at(n) > 0, F.get("cells", at(n) - 1)).alias(n) for n in columns])


def typed_fields(raw: DataFrame) -> DataFrame:
    """Whole numbers only where all digits; the title from document title or subject."""
    out = raw
    for c in ("pages", "file_size"):
        if c in raw.columns:
            out = out.withColumn(c, F.when(F.col(c).rlike(r"^\d+$"), F.col(c).cast("int" if c == "pages" else "bigint")))
    titles = [F.nullif(F.col(c), F.lit("")) for c in ("document_title", "email_subject") if c in raw.columns]
    return out.withColumn("title", F.coalesce(*titles)) if titles else out


def read_opt(spark: SparkSession, path: str, encoding: str = "UTF-8", least_columns: int = 4) -> DataFrame:
    """Rows (volume, line_no, bates, path, brk, declared) of an OPT file; too short rows are left out."""
    rows = _lines(spark, path, encoding).withColumn("c", F.split("line", ",")).filter(F.size("c") >= least_columns)
    return rows.select(F.col("file").alias("volume"), "line_no", F.get("c", F.lit(0)).alias("bates"), F.regexp_replace(F.replace(F.get("c", F.lit(2)), F.lit("\\"), F.lit("/")), r"^[./]+", "").alias("path"), F.get("c", F.lit(3)).alias("brk"), F.get("c", F.lit(6)).try_cast("int").alias("declared"))


def opt_groups(rows: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    """One row per document: a row with brk 'Y' begins one, the rows after it are its pages. Volumes are ordered apart."""
    running = F.sum(F.when(F.col("brk") == "Y", 1).otherwise(0)).over(W.partitionBy("volume").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    g = rows.withColumn("document", running).filter("document > 0")
    pages = F.transform(F.sort_array(F.collect_list(F.struct("line_no", "path"))), lambda p: p["path"])
    return g.groupBy("volume", "document").agg(pages.alias("pages"), *extra)


def page_mapping(rows: DataFrame) -> DataFrame:
    """Rows (bates, pages, page_count, first_page); a declared page count wins over the counted one."""
    g = opt_groups(rows, extra=[F.min_by("bates", "line_no").alias("bates"), F.min_by("declared", "line_no").alias("declared")])
    return g.select("bates", "pages", F.coalesce("declared", F.size("pages")).alias("page_count"), F.get("pages", F.lit(0)).alias("first_page"))
