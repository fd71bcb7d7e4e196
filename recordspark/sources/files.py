"""Other sources: metadata sidecars, manifests, text files, archives, paged remote tables, sitemaps."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from recordspark.functions.records import MEDIA_TYPES, extension
from recordspark.schemas import DOWNLOAD_METADATA, EVALUATION_MANIFEST, IMAGE_MANIFEST


def read_metadata(spark: SparkSession, folder: str) -> DataFrame:
    """Download sidecars; unreadable files are rows with ``_corrupt_record`` and nothing else."""
    return spark.read.schema(DOWNLOAD_METADATA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").option("multiLine", True).json(folder)


def read_image_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row per image; the document id from the file name where the manifest has none."""
    images = spark.read.schema(IMAGE_MANIFEST).option("multiLine", True).json(path).select(F.inline("images"))
    named = F.nullif(F.regexp_extract("filename", r"^(\d+)_p\d+_\d+\.[A-Za-z0-9]+$", 1), F.lit("")).cast("bigint")
    return images.withColumn("doc_id", F.coalesce("doc_id", named))


def read_evaluation_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION_MANIFEST).json(path)


def read_text_files(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows (path, text); broken byte sequences become replacement characters."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    text = F.make_valid_utf8(F.col("content").cast("string")) if encoding.upper() == "UTF-8" else F.decode("content", encoding)
    return raw.select("path", text.alias("text"))


def discover(spark: SparkSession, root: str, extensions: tuple[str, ...] = tuple(MEDIA_TYPES)) -> DataFrame:
    """Rows (path, filename, category, data_set, content_type, size) of files with an allowed extension below ``root``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("size"))
    parts = F.split(F.regexp_replace("path", r"^.*?" + root.rstrip("/") + "/", ""), "/")
    out = raw.withColumn("filename", F.element_at(parts, -1)).withColumn("ext", extension(F.col("filename"))).filter(F.col("ext").isin(*extensions))
    types = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    first = F.get(parts, F.lit(0))
    return out.select("path", "filename", F.when(F.size(parts) > 1, first).alias("category"), F.when(F.lower(first).contains("data-set"), first).alias("data_set"), F.element_at(types, F.col("ext")).alias("content_type"), "size")


def expand_archives(spark: SparkSession, path: str, head_bytes: int | None = None) -> DataFrame:
    """Rows (archive, name, size, md5) of the members of ZIP files; of equal archives one is read, equal in their first ``head_bytes`` if these are given."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)
    one = raw.withColumn("head", F.md5(F.col("content") if head_bytes is None else F.substring("content", 1, head_bytes))).groupBy("head").agg(F.min("path").alias("path")).select("path")

    def members(batches: Iterator[pd.DataFrame]):
        import hashlib

        for pdf in batches:
            rows = []
            for archive, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    rows += [(archive, i.filename, i.file_size, hashlib.md5(z.read(i)).hexdigest()) for i in z.infolist() if not i.is_dir()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size", "md5"])

    return raw.join(one, "path", "left_semi").select("path", "content").mapInPandas(members, "archive string, name string, size bigint, md5 string")


def read_sitemap(spark: SparkSession, path: str, host: str) -> DataFrame:
    """Rows (loc, problem): entries of a sitemap; problem is null for a good one."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)
    n = urls.groupBy("loc").agg(F.count(F.lit(1)).alias("n"))
    problem = F.when(F.col("loc").isNull() | (F.trim("loc") == ""), "missing loc").when(F.lower(F.regexp_extract("loc", r"^[a-zA-Z]+://([^/?#]+)", 1)) != host.lower(), "foreign host").when(F.col("loc").contains("#"), "fragment").when(F.col("n") > 1, "duplicate")
    return urls.select("loc").distinct().join(n, "loc", "left").select("loc", problem.alias("problem"))


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (url, href) of the links in stored pages."""
    return pages.select(F.col(url).alias("url"), F.explode(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*href\s*=\s*[\"']([^\"'#]+)"), F.lit(1))).alias("href")).distinct()


class _Range(InputPartition):
    def __init__(self, begin: int, end: int):
        self.begin, self.end = begin, end


class PagedReader(DataSourceReader):
    """Reads a remote table by key ranges, each range by keyset pages, with retries."""

    def __init__(self, schema: StructType, fetch: Callable[[int, int, int], list[tuple]], low: int, high: int, parts: int, page: int, retries: int):
        self.schema, self.fetch, self.low, self.high, self.parts, self.page, self.retries = schema, fetch, low, high, parts, page, retries

    def partitions(self):
        step = max(1, -(-(self.high - self.low) // self.parts))
        return [_Range(b, min(b + step, self.high)) for b in range(self.low, self.high, step)]

    def read(self, partition):
        import time

        after = partition.begin - 1
        while True:
            for attempt in range(self.retries + 1):
                try:
                    rows = self.fetch(after, partition.end, self.page)
                    break
                except OSError:
                    if attempt == self.retries:
                        raise
                    time.sleep(0.1 * 2**attempt)
            yield from rows
            if len(rows) < self.page:
                return
            after = rows[-1][0]


def offset_pages(fetch: Callable[[int, int], list[tuple]], page: int = 5000) -> Iterator[tuple]:
    """Rows of ``fetch(offset, limit)``, page by page until a short one."""
    at = 0
    while True:
        rows = fetch(at, page)
        yield from rows
        if len(rows) < page:
            return
        at += len(rows)


def cursor_pages(fetch: Callable[[str | None], tuple[list[tuple], str | None]]) -> Iterator[tuple]:
    """Rows of ``fetch(cursor)``, which gives a page and the next cursor; a cursor or key given twice is an error."""
    cursor, seen, keys = None, set(), set()
    while True:
        rows, after = fetch(cursor)
        for r in rows:
            if r[0] in keys:
                raise ValueError(f"the inventory repeats the key {r[0]}")
            keys.add(r[0])
            yield r
        if not after:
            return
        if after in seen:
            raise ValueError("the inventory repeats a cursor")
        seen.add(after)
        cursor = after


def sequential_source(name_: str, schema_: str, rows: Callable[[], Iterator[tuple]]) -> type[DataSource]:
    """A Python data source class over pages that only follow one another, such as those of ``offset_pages`` and ``cursor_pages``."""

    class Rows(DataSourceReader):
        def read(self, partition):
            yield from rows()

    class Sequential(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema_

        def reader(self, schema):
            return Rows()

    return Sequential


def paged_source(name_: str, schema_: str, fetch: Callable[[int, int, int], list[tuple]], low: int, high: int, parts: int = 4, page: int = 1000, retries: int = 3) -> type[DataSource]:
    """A Python data source class over ``fetch(after, end, limit)``: rows with after < key < end in key order, the key first."""

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name_

        def schema(self):
            return schema_

        def reader(self, schema):
            return PagedReader(schema, fetch, low, high, parts, page, retries)

    return Paged
