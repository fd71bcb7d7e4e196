"""Every query against its SQL on the smallest tables, where they are at hand."""

import datetime as dt
import math
import os

import pytest

from recordspark.functions.quality import edit_distance
from recordspark.plans import catalogue

DATA = os.environ.get("RECORDSPARK_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def db():
    import duckdb

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


def _edits(spark, df):
    t = spark.read.parquet(f"{DATA}/archive_documents.parquet").filter("title is not null").select("id", "title", "filename").collect()
    want = {r["id"]: edit_distance(r["title"].lower().split(), (r["filename"] or "").replace("_", " ").lower().split()) for r in t}
    assert {r["id"]: r["edits"] for r in df.collect()} == want


def _parts(spark, df):
    held = {}
    for r in sorted(df.collect(), key=lambda r: (r["document_id"], r["part"])):
        assert len(r["piece"].encode()) <= 1000
        held[r["document_id"]] = held.get(r["document_id"], "") + r["piece"]
    want = {r["document_id"]: r["full_text"] for r in spark.read.parquet(f"{DATA}/document_texts.parquet").filter("full_text <> ''").select("document_id", "full_text").collect()}
    assert held == want


def _sample(spark, df):
    per = {r["band"]: r["count"] for r in df.groupBy("band").count().collect()}
    assert per and max(per.values()) <= 5 and df.distinct().count() == df.count()


def _spans(spark, df):
    texts = {r["document_id"]: r["full_text"] for r in spark.read.parquet(f"{DATA}/document_texts.parquet").select("document_id", "full_text").collect()}
    assert all(texts[r["document_id"]] for r in df.select("document_id").distinct().collect())


# what queries without SQL must fulfil
ROWS_ONLY = {"wer_pairs": _edits, "utf8_parts": _parts, "stratified_sample": _sample, "ner_stub_mentions": _spans, "casefold_keys": lambda spark, df: df.columns}


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    if name not in catalogue.SQL:
        assert got and got == sorted(tuple(map(plain, r)) for r in catalogue.QUERIES[name](spark, DATA).select(*columns).collect())
        ROWS_ONLY[name](spark, df)
        return
    sql = db.sql(catalogue.SQL[name])
    assert sorted(sql.columns) == columns
    at = [sql.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())
