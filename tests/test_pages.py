"""Page rules, header policies, chunks, the facade."""

import pytest
from pyspark.sql import functions as F

from recordspark.functions import urls as U
from recordspark.operators import pages
from recordspark.operators.visibility import parse_policy
from recordspark.plans.api import Archive, ParameterError, expand_sets, whole
from recordspark.sources.sinks import chunked, write_report, write_sorted

GOOD = '<html><head><title>T</title><link rel="canonical" href="https://a.org/1"><meta property="og:url" content="/1"><script type="application/ld+json">{"a": 1}</script></head><body><h1>x</h1></body></html>'
BAD = '<html><head><link rel="canonical" href="https://a.org/2"><meta name="robots" content="NoIndex"><script type="application/ld+json">{a}</script></head></html>'


def test_findings(spark):
    p = spark.createDataFrame([("https://a.org/1", 200, "text/html; charset=utf-8", None, GOOD), ("https://a.org/3", 200, "text/html", "https://a.org/4", BAD), ("https://a.org/5", 404, None, None, None), ("https://a.org/6", 200, "image/png", None, "x")], "url string, status int, content_type string, final_url string, html string")
    got = sorted((r["url"][-1], r["problem"]) for r in pages.findings(p).collect())
    assert got == sorted([("3", x) for x in ("redirect", "missing-title", "h1-count", "canonical-mismatch", "unexpected-noindex", "invalid-json-ld")] + [("5", "http-status"), ("6", "content-type")])


def test_urls(spark):
    r = spark.range(1).select(U.header_policy(F.lit("default-src 'self'; img-src a.org b.org;")).alias("p"), U.byte_range(F.lit("bytes 0-9/20")).alias("b"), U.utf8_chunks(F.lit("aéb€c"), F.lit(4)).alias("c"), U.safe_filename(F.lit("https://a.org/x y.pdf?q")).alias("f")).first()
    assert r["p"] == {"default-src": ["'self'"], "img-src": ["a.org", "b.org"]} and tuple(r["b"]) == (0, 9, 20) and r["c"] == ["aéb", "€c"] and r["f"] == "x_y.pdf"


def test_chunks_and_writers(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 3, 4), ("a", 4, 99), ("b", 5, None)], "g string, id long, size long")
    assert sorted(tuple(r) for r in chunked(d, "g", "id", "size", 8).collect()) == [("a", 1, 0), ("a", 2, 0), ("a", 3, 1), ("a", 4, 2), ("b", 5, 0)]
    write_sorted(d, str(tmp_path / "s"), ["g"], ["g", F.desc("size")])
    write_report(d, str(tmp_path / "r"), "sizes")
    assert spark.read.parquet(str(tmp_path / "s")).count() == 5 and spark.read.json(str(tmp_path / "r")).filter("report = 'sizes'").count() == 5


def test_parameters():
    assert whole("24", 1, 100) == 24
    for bad in ("0", "101", "1.5", "x", "-1", None):
        with pytest.raises(ParameterError):
            whole(bad, 1, 100)
    assert expand_sets(["b", "z"], "g", {"g": ["a", "b"]}) == ["b"] and expand_sets(None, "g", {"g": ["a"]}) == ["a"] and expand_sets(None, None, {}) is None
    with pytest.raises(ParameterError):
        expand_sets(None, "x", {})


def test_facade(spark):
    d = spark.createDataFrame([(1, "ARC-1", "release 1", "email", "t1", "f1", 2), (2, "ARC-2", "Release 01", "E-MAIL", "t2", "f2", 1), (3, None, "release-2", "pdf", None, "f3", None)], "id long, bates_number string, data_set string, document_type string, title string, filename string, page_count int")
    x = spark.createDataFrame([(1, "the night porter left", ["p0", "p1"]), (2, "the night was long", None), (3, "", None)], "document_id long, full_text string, pages_text array<string>")
    e = spark.createDataFrame([(1, "Ann Lee", "person", "Ann", "Lee", 3), (2, "ANN LEE", "PER", None, None, 1), (3, "Bo", "org", None, None, 9)], "id long, canonical_name string, entity_type string, first_name string, last_name string, mention_count long")
    m = spark.createDataFrame([(1, 1, 1, "Ann", "witness", 0.5), (2, 1, 3, "Bo", "x", 0.1), (3, 2, 2, "ANN", "Witness", 0.9), (4, 2, 3, "Bo", "x", None), (5, None, 1, "Ann", None, None)], "id long, document_id long, entity_id long, name_as_appears string, role string, role_confidence double")
    a = Archive(d, x, e, m)
    page, total = a.search("night")
    assert [r["id"] for r in page.collect()] and total.first()["total"] == 2
    assert ">>>night<<<" in page.first()["snippet"]
    assert [r["id"] for r in a.search("")[0].collect()] == [3, 2, 1]
    assert [r["id"] for r in a.browse(sets=["release-01"])[0].collect()] == [2, 1] and a.browse(sets=[])[1].first()["total"] == 0
    assert [r["id"] for r in a.browse(has_text=False)[0].collect()] == [3]
    assert a.document_text(1, 1).first()["text"] == "p1" and a.document(1).first()["pages"] == 2
    assert a.entity(2).first()["total"] == 4
    assert [r["id"] for r in a.entity_mentions(2, "witness").collect()] == [3, 1]
    assert [(r["rep_id"], len(r["mentions"])) for r in a.search_entities("lee").collect()] == [(1, 2)]
    assert a.search_entities(role="witness", document_type="email").filter("rep_id = 1 or rep_id = 2").first()["total"] == 2
    hidden = Archive(d, x, e, m, parse_policy("bates:ARC-2"))
    assert hidden.stats().first().asDict() == {"documents": 2, "pages": 2, "mentions": 2, "mentioned_entities": 2}
    assert [r["id"] for r in hidden.search("night")[0].collect()] == [1] and hidden.document(2).count() == 0
    assert hidden.co_occurrences(1).collect() == [] and len(a.facets()[0].collect()) == 2
