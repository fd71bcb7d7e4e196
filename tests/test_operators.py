"""Golden and edge cases of the core's operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordspark.operators import audit, fts, graph, resolve, state
from recordspark.operators.components import connected_components
from recordspark.operators.visibility import Policy, PolicyError, hidden_ids, parse_policy, visible, visible_unguarded
from recordspark.plans.browsing import links
from recordspark.plans.query_language import parse


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_components(spark):
    chain = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 100), (7, 7), (None, 5)]
    got = dict(rows(connected_components(spark.createDataFrame(chain, "src long, dst long")), "node", "component"))
    assert got == {**dict.fromkeys(range(1, 41), 1), 100: 100, 101: 100}
    assert rows(connected_components(spark.createDataFrame([], "src long, dst long"))) == []


def test_components_of_a_star(spark):
    got = rows(connected_components(spark.range(1, 500).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))), "component")
    assert got == [(0,)] * 500


def test_policy():
    p = parse_policy("doc:5, bates:arc-1")
    assert p == Policy(frozenset([5]), frozenset(["ARC-1"]))
    assert parse_policy(" ".join(f"doc:{i}" for i in range(1, 81))).active
    for bad in (" ".join(f"doc:{i}" for i in range(1, 82)), "doc:x", "5", "x" * 17000):
        with pytest.raises(PolicyError):
            parse_policy(bad)


def test_visibility_of_null_bates(spark):
    d = spark.createDataFrame([(1, None), (2, "ARC-2"), (3, "arc-3")], "id long, bates_number string")
    p = parse_policy("bates:ARC-3 doc:2")
    assert rows(d.filter(visible(p, F.col("id"), F.col("bates_number"))), "id") == [(1,)]
    assert rows(d.filter(visible_unguarded(p, F.col("bates_number"))), "id") == [(2,)]
    assert rows(hidden_ids(p, d)) == [(2,), (3,)]


def test_fts_rebuild_skips_blank(spark, tmp_path):
    t = spark.createDataFrame([(7, "known searchable phrase"), (11, ""), (19, "other text"), (20, None), (21, "phrase known")], "document_id long, full_text string")
    p = fts.build_postings(t)
    assert rows(fts.match(p, parse("searchable"))) == [(7,)]
    assert rows(fts.match(p, parse('"known phrase" OR text'))) == [(19,)]
    assert rows(fts.match(p, parse("known phrase"))) == [(7,), (21,)]
    fts.write_index(t, str(tmp_path / "i"))
    assert rows(fts.match(fts.read_postings(spark, str(tmp_path / "i"), ["searchable"]), parse("searchable"))) == [(7,)]
    assert fts.index_consistency(t, p).first().asDict() == {"text_rows": 3, "index_rows": 3, "missing": 0, "orphans": 0, "ok": True}
    new = fts.sync_postings(p, spark.createDataFrame([(7, "fresh"), (19, "")], "document_id long, full_text string"))
    assert rows(new.select("document_id").distinct()) == [(7,), (21,)]


def test_bm25(spark):
    t = spark.createDataFrame([(1, "a b c d"), (2, "a a b"), (3, "c d"), (4, "e"), (5, "f")], "document_id long, full_text string")
    got = {r["document_id"]: r["score"] for r in fts.bm25(fts.build_postings(t), fts.lengths(t), parse("a")).collect()}
    import math

    idf, avg = max(math.log((5 - 2 + 0.5) / 2.5), 1e-6), 11 / 5
    assert got == pytest.approx({1: -idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 4 / avg)), 2: -idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg))})


def test_snippet_window(spark):
    t = spark.createDataFrame([(1, "x " * 50 + "needle and needle")], "document_id long, full_text string")
    assert rows(fts.snippet_window(fts.build_postings(t), parse("needle"), 8)) == [(1, 45, 2)]


def test_cooccurrence_cap_and_ties(spark):
    m = spark.createDataFrame([(d, e) for d in (1, 2) for e in (1, 2, 3)] + [(3, e) for e in range(1, 6)] + [(None, 1), (4, None), (1, 1)], "document_id long, entity_id long")
    assert rows(graph.cooccurrence_top(m, cap=3, least=2, top=1)) == [(1, 2, 2), (2, 1, 2), (3, 1, 2)]


def test_merge_keeps_longest(spark):
    e = spark.createDataFrame([(1, "Mr. Ann Lee"), (2, "ann lee"), (3, "Ann Lee Jr."), (4, "Bo"), (5, None)], "id long, canonical_name string")
    assert rows(resolve.merge_mapping(e)) == [(2, 1), (3, 1)]
    m = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "id long, entity_id long")
    assert rows(resolve.apply_mapping(m, resolve.merge_mapping(e)), "id", "entity_id") == [(1, 1), (2, 1), (3, 4)]


def test_two_stage_mapping(spark):
    new = spark.createDataFrame([(1, "a", "person"), (2, "b", "unknown"), (3, "c", "unknown"), (4, "d", "person")], "local_id long, name_key string, kind string")
    old = spark.createDataFrame([(10, "a", "person"), (11, "b", "location"), (12, "c", "person"), (13, "c", "location")], "id long, name_key string, kind string")
    mapped = resolve.map_to_existing(new, old)
    assert rows(mapped) == [(1, 10, "name and type"), (2, 11, "name"), (3, None, "new"), (4, None, "new")]
    assert rows(resolve.new_ids(mapped, old)) == [(1, 10), (2, 11), (3, 14), (4, 15)]


def test_upsert_texts(spark):
    held = spark.createDataFrame([(1, "old"), (2, "old"), (3, "old"), (4, "old")], "document_id long, full_text string")
    runs = spark.createDataFrame([(1, "success", "new"), (2, "success", " "), (3, "failed", None), (5, "success", "first"), (6, "failed", None)], "document_id long, status string, full_text string")
    assert rows(state.upsert_texts(held, runs)) == [(1, "new"), (3, "old"), (4, "old"), (5, "first")]


def test_batches(spark):
    p = spark.createDataFrame([(1, n) for n in (1, 2, 3, 4, 8, 9)], "k long, page int")
    assert rows(state.batches(p, "k", "page", 3)) == [(1, 1, 3, 3), (1, 4, 4, 1), (1, 8, 9, 2)]


def test_latest_and_retention(spark):
    t = lambda m: dt.datetime(2020, 1, 1, 0, m)
    logs = spark.createDataFrame([(1, 5, "failed", t(1)), (2, 5, "success", t(2)), (3, 6, "failed", t(1))], "id long, document_id long, status string, created_at timestamp")
    assert rows(state.latest(logs, ["document_id"], F.desc("created_at"), F.desc("id")), "document_id", "status") == [(5, "success"), (6, "failed")]
    assert rows(state.keep_newest(logs, ["document_id"], 1, "created_at"), "id") == [(1,)]


def test_storage_findings(spark):
    t = spark.createDataFrame([("a", "d", 1, "image/jpg"), ("b", "d", 2, None), ("c", "d", 3, None), ("e", "d", 0, "text/plain"), ("f", "d", 5, None)], "key string, kind string, expected_size long, expected_type string")
    i = spark.createDataFrame([("a", 1, "image/jpeg; x"), ("c", 0, None), ("e", 9, "image/png"), ("f", 4, None), ("z", 1, None)], "key string, size long, content_type string")
    assert rows(audit.compare_targets(t, i), "key", "problem") == [("b", "missing"), ("c", "zero-byte"), ("e", "type-mismatch"), ("f", "size-mismatch")]
    assert rows(audit.unreferenced(t, i), "key") == [("z",)]
    u = audit.union_targets(t, t.filter("key = 'a'").withColumn("expected_size", F.lit(7).cast("long")))
    assert rows(u.filter("conflict"), "key", "expected_size") == [("a", 1)]


def test_bands_without_pages_stand(spark):
    s = spark.createDataFrame([("0.90-plus", 10, 1), ("0.90-plus", 10, 0)], "band string, ref_chars long, char_edits long")
    assert rows(audit.accuracy_by_band(s), "band", "pages", "cer") == [("0.50-0.69", 0, 0.0), ("0.70-0.89", 0, 0.0), ("0.90-plus", 2, 0.05), ("under-0.50", 0, 0.0)]


def test_page_links_reach_all_in_few_hops(spark):
    got = {r["page"]: r["links"] for r in links(spark.range(1, 196).select(F.col("id").cast("int").alias("page"), F.lit(195).alias("pages"))).collect()}
    seen, edge = {1}, {1}
    for _ in range(4):
        edge = {x for p in edge for x in got[p]} - seen
        seen |= edge
    assert seen == set(range(1, 196))


def test_extend_entities(spark):
    e = spark.createDataFrame([(5, "Ann Lee"), (9, "ann lee"), (7, None)], "id long, canonical_name string")
    f = spark.createDataFrame([(1, "ANN LEE", "person"), (1, "Bo Ray", "person"), (2, "bo ray", "person"), (2, "Bo Ray", "person"), (3, None, "person")], "document_id long, name string, kind string")
    links_, new = resolve.extend_entities(f, e)
    assert rows(links_) == [(1, 9, 1), (1, 10, 1), (2, 10, 2)]
    assert rows(new) == [(10, "bo ray", "person")]
