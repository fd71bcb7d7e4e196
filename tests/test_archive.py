"""The facade, the written index, ordered numbering, and sources that come in pages."""

import pytest
from pyspark.sql import functions as F

from recordspark import session
from recordspark.functions import quality as Q
from recordspark.functions import records as R
from recordspark.functions import text as X
from recordspark.operators import fts, state
from recordspark.operators.visibility import parse_policy
from recordspark.plans.api import Archive, ParameterError
from recordspark.plans.query_language import parse
from recordspark.sources import dumps, files, loadfile
from recordspark.streaming import incremental

DOCS = "id long, bates_number string, data_set string, document_type string, content_type string, title string, filename string, page_count int"
TEXTS = "document_id long, full_text string"


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]


@pytest.fixture(scope="module")
def tables(spark):
    d = spark.createDataFrame(
        [
            (1, "ARC-001", "Release 1", "email", None, "Yacht log", "a.eml", 1), (2, "ARC-009", "Release 1", "Video", "video/mp4", None, "b.mp4", None), (3, "ARC-010", "Release 2", "audio", "audio/wav", "Interview Day 2 Part 4", "c.wav", None),
            (4, None, None, "image", "image/png", "", "d.png", 1), (5, "ARC-098", "Release 2", "pdf", None, "Yacht papers", "e.pdf", 3), (6, "ARC-006", None, "audio", None, "Talk", "f.wav", None),
        ],
        DOCS,
    )
    t = spark.createDataFrame([(1, "The yacht is here."), (5, "A yacht, a yacht and a café."), (3, None)], TEXTS).withColumn("pages_text", F.lit(None).cast("array<string>"))
    e = spark.createDataFrame([(1, "Mill Trust", "org", None, None, 9), (2, "mill trust", "Organization", None, None, 3), (3, "Other", "person", None, None, 1)], "id long, canonical_name string, entity_type string, first_name string, last_name string, mention_count long")
    m = spark.createDataFrame([(1, 1, 1, "Mill Trust", "payer"), (2, 1, 1, "the trust", "payer"), (3, 5, 2, "mill trust", "payee"), (4, 2, 1, "M. Trust", None), (5, 99, 1, "lost", None)], "id long, document_id long, entity_id long, name_as_appears string, role string")
    return d, t, e, m


def test_search_keeps_its_order(tables):
    page, total = Archive(*tables).search("yacht", limit=5)
    assert rows(page, "id") == [(5,), (1,)] and total.first()["total"] == 2
    assert rows(Archive(*tables).search("CAFE")[0], "id") == rows(Archive(*tables).search("café")[0], "id") == [(5,)]


def test_search_entities_over_siblings_and_policy(tables):
    found = Archive(*tables).search_entities("trust").collect()
    assert [(r["rep_id"], r["total"], [(x["document_id"], x["name_as_appears"]) for x in r["mentions"]]) for r in found] == [(1, 12, [(1, "Mill Trust"), (2, "M. Trust"), (5, "mill trust")])]
    hidden = Archive(*tables, parse_policy("doc:1")).search_entities("trust").collect()
    assert [(r["rep_id"], r["total"], [x["document_id"] for x in r["mentions"]]) for r in hidden] == [(1, 2, [2, 5])]
    assert [len(r["mentions"]) for r in Archive(*tables).search_entities("trust", samples=1).collect()] == [1]


def test_images_under_a_policy(spark, tables):
    manifest = spark.createDataFrame([("4_p1.png", None, None), ("x.png", 2, None), ("y.png", None, "arc-098"), ("z.png", None, None), ("w.png", None, "ARC-777")], "filename string, doc_id long, bates string")
    page, total = Archive(*tables).images(manifest)
    assert rows(page, "filename", "document_id") == [("4_p1.png", 4), ("w.png", None), ("x.png", 2), ("y.png", 5), ("z.png", None)] and total.first()["total"] == 5
    assert rows(Archive(*tables, parse_policy("doc:2 bates:ARC-098")).images(manifest)[0], "filename") == [("4_p1.png",), ("w.png",)]


def test_media_listings(tables):
    a = Archive(*tables)
    assert rows(a.videos()[0]) == [(2, "b.mp4", "b.mp4", "release-01")] and a.videos()[1].first()["total"] == 1
    assert rows(a.recordings(), "id", "day", "part") == [(3, "Day 2", "4"), (6, "Unknown", None)]
    assert rows(a.recordings(["release-02"]), "id") == [(3,)]


def test_records(tables):
    a = Archive(*tables)
    assert rows(a.records("yacht")[0], "id", "bates", "page_count") == [(1, "ARC-001", 1), (5, "ARC-098", 3)]
    shown, entities = a.record("ARC-098")
    assert [tuple(p) for p in shown.first()["pages"]] == [(0, "ARC-098"), (1, "ARC-099"), (2, "ARC-100")]
    assert rows(entities, "entity_id", "name_as_appears") == [(2, "mill trust")]
    assert rows(Archive(*tables, parse_policy("bates:ARC-098")).record("ARC-098")[0]) == [] and a.record("none")[0].count() == 0
    with pytest.raises(ParameterError):
        a.records("x" * 101)


def test_fold(spark):
    x = spark.createDataFrame([("Café Ångström",), ("café",), ("STRASSE ß ñ",), (None,)], "t string")
    assert rows(x.select(X.tokens(F.col("t")))) == [(["cafe", "angstrom"],), (["cafe"],), (["strasse", "ß", "n"],), (None,)]
    assert parse('"Café Ångström" café') == [[("cafe", "angstrom"), ("cafe",)]]


def test_written_index_has_buckets_by_size_and_updates(spark, tmp_path):
    t = spark.createDataFrame([(i, "common words and " + f"rare{i} more") for i in range(40)], TEXTS)
    p = str(tmp_path / "i")
    fts.write_index(t, p, per_bucket=50)
    assert spark.read.parquet(f"{p}/postings").select("buckets").first()[0] == 4
    assert rows(fts.match(fts.read_postings(spark, p, ["rare7"]), parse("rare7"))) == [(7,)]
    changed = spark.createDataFrame([(7, "new words"), (8, "")], TEXTS)
    fts.update_index(spark, p, changed, t.filter("document_id in (7, 8)"))
    want = {tuple(r) for r in fts.build_postings(t.filter("document_id not in (7, 8)").unionAll(changed)).collect()}
    assert {tuple(r) for r in fts.read_postings(spark, p).collect()} == want
    assert fts.read_lengths(spark, p).count() == 39


def test_snippet_text(spark):
    t = spark.createDataFrame([(1, "one two three, Cafés and a café here at last"), (2, "café")], TEXTS)
    asked = parse("café")
    got = dict(rows(fts.snippet_text(t, fts.snippet_window(fts.build_postings(t), asked, 3), asked, 3)))
    assert got == {1: "...and a >>>café<<<...", 2: ">>>café<<<"}


def test_replayed_batch_counts_once(spark, tmp_path):
    each = incremental.sync_index(str(tmp_path))
    first, second = spark.createDataFrame([(1, "red red blue"), (2, "green")], TEXTS), spark.createDataFrame([(2, "blue")], TEXTS)
    each(first, 0), each(first, 0), each(second, 1), each(second, 1)
    assert sorted(rows(incremental.current_postings(spark, str(tmp_path)))) == [("blue", 1, 2), ("blue", 2, 0), ("red", 1, 0), ("red", 1, 1)]


def test_positions_and_packs(spark):
    d = spark.createDataFrame([("a" if i % 3 else None, i, 4) for i in range(100)], "k string, i long, s long").repartition(5)
    got = {(r["k"], r["i"]): r["position"] for r in state.positions(d, "k", "i").collect()}
    for k in ("a", None):
        mine = sorted(i for kk, i in got if kk == k)
        assert [got[k, i] for i in mine] == list(range(1, len(mine) + 1))
    packed = {(r["k"], r["i"]): r["pack"] for r in state.packs(d, "k", "i", F.col("s"), 10).collect()}
    assert [packed[None, i] for i in range(0, 18, 3)] == [0, 0, 0, 1, 1, 2]


def test_keep_newest_of_a_hot_key(spark):
    d = spark.createDataFrame([("x", i, None if i < 3 else i) for i in range(200)] + [("y", 500, 1), (None, 600, 2), (None, 601, 3)], "k string, id long, at long")
    assert sorted(r[0] for r in rows(state.keep_newest(d, ["k"], 2, "at", "id"), "id")) == list(range(198))


def test_dump_strings_with_line_ends(spark, tmp_path):
    (tmp_path / "d.sql").write_text("CREATE TABLE t (a);\nINSERT INTO t VALUES (1, 'one;\ntwo ''quoted'';\nthree');\nINSERT INTO u VALUES (9, 'x');\nINSERT INTO t VALUES (2, NULL);\n")
    assert sorted(rows(dumps.read_dump(spark, str(tmp_path / "d.sql"), "t", ["a", "b"]))) == [("1", "one;\ntwo 'quoted';\nthree"), ("2", None)]


def test_load_file_in_splits(spark, tmp_path):
    lines = ["þBatesþ\x14þTitleþ"] + [f"þX{i:05d}þ\x14þtitle {i}þ" for i in range(5000)]
    (tmp_path / "a.dat").write_text("﻿" + "\r\n".join(lines) + "\r\n", encoding="utf-8", newline="")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        got = loadfile.read_dat(spark, str(tmp_path / "a.dat"), ["Bates", "Title"]).orderBy("line_no").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r["line_no"], r["Bates"]) for r in got] == [(i + 1, f"X{i:05d}") for i in range(5000)]


def test_offset_and_cursor_pages(spark):
    held = [(i, f"o{i}") for i in range(7)]
    assert list(files.offset_pages(lambda at, n: held[at : at + n], 3)) == held
    pages = {None: (held[:3], "a"), "a": (held[3:], None)}
    assert list(files.cursor_pages(lambda c: pages[c])) == held
    for bad in ({None: (held[:1], "a"), "a": (held[1:2], "a")}, {None: (held[:2], "a"), "a": (held[:1], None)}):
        with pytest.raises(ValueError):
            list(files.cursor_pages(lambda c, bad=bad: bad[c]))
    spark.dataSource.register(files.sequential_source("held_rows", "id long, name string", lambda: iter([(1, "a"), (2, "b")])))
    assert rows(spark.read.format("held_rows").load()) == [(1, "a"), (2, "b")]


def test_hybrid_pages_and_word_figures(spark):
    x = spark.createDataFrame([(["x" * 60, "3", ""], ["y" * 99, "body of the page", "scan"], [0.4, 0.8, 0.6]), (["3"], ["33"], [0.5]), ([""], ["a"], [0.5])], "n array<string>, o array<string>, c array<double>")
    got = [r["h"] for r in x.select(Q.hybrid_pages(F.col("n"), F.col("o"), F.col("c")).alias("h")).collect()]
    assert [(g["method"], round(g["confidence"], 6)) for g in got] == [("hybrid", 0.8), ("ocr", 0.5), ("ocr", 0.5)] and got[0]["pages"] == ["x" * 60, "body of the page", "scan"]
    w = spark.createDataFrame([(1, 1, "a", 90.0), (1, 1, "b", 80.0), (1, 1, "c", 70.0), (1, 2, "d", 60.0), (1, 2, " ", 99.0), (1, 3, "e", -1.0)], "doc long, line int, text string, conf double")
    assert rows(Q.word_figures(w, ["doc"], ["line"]), "doc", "confidence", "dense") == [(1, 0.75, 0.75)]


def test_redaction_rectangles(spark):
    x = spark.createDataFrame([(50.0, 12.0, [0.0, 0.0, 0.1]), (8.0, 12.0, [0.5, 0.0, 0.0]), (50.0, 200.0, []), (600.0, 12.0, None)], "w double, h double, f array<double>")
    assert rows(x.select(Q.redaction_sized(F.col("w"), F.col("h"), F.lit(612.0), F.lit(792.0)), Q.dark_fill(F.col("f")))) == [(True, True), (False, False), (False, False), (False, False)]


def test_names_of_files(spark):
    x = spark.createDataFrame([("A-1", "A-1.pdf", "scan.pdf"), ("A-1", "own name.doc", None), (None, None, "prose"), ("A-1", "A-1", "Report 2")], "bates string, filename string, title string")
    assert [r[0] for r in x.select(R.released_name(F.col("filename"), F.col("title"), F.col("bates"))).collect()] == ["scan.pdf", "own name.doc", "", ""]
    assert [r[0] for r in x.select(X.looks_like_filename(F.col("title"))).collect()] == [True, False, False, False]


def test_cluster_without_a_shared_folder_is_an_error():
    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context

    with pytest.raises(RuntimeError):
        session.shared_folder(Session)


def test_collection_and_record_pages(spark, tables):
    d, t, e, m = tables
    many = spark.createDataFrame([(100 + i, f"B-{i:03d}", "release 9", "pdf", None, None, f"f{i:03d}.pdf", 2) for i in range(50)], DOCS)
    a = Archive(many, t, e, m, parse_policy("doc:103"))
    items, about = a.collection_page("release-09", 9, 24)
    assert rows(items, "position", "id") == [(49, 149)] and about.first()["pages"] == 3 and about.first()["page"] == 3 and about.first()["total"] == 49
    assert rows(items, "meta") == [("release-09 · pdf · 2 pages",)]
    assert rows(a.record_page(104), "previous", "next") == [(102, 105)] and rows(a.record_page(100), "previous", "next") == [(None, 101)]
    assert rows(a.record_page(103)) == [] and a.collection_page("none")[1].first()["pages"] == 1


def test_small_columns(spark):
    x = spark.createDataFrame([('<script src="/a/app-0123abcd.js">', bytearray(b"\xff\xd8\xffrest"), "é" * 10, "B-1", "film.MP4", "Title: x\nPages:          12\n"), (None, None, None, None, None, None)], "h string, c binary, t string, b string, title string, probe string")
    from recordspark.functions import urls as U

    got = dumps.probe_pages(x).select(U.hashed_asset(F.col("h")), U.is_jpeg(F.col("c")), U.truncate_utf8(F.col("t"), F.lit(10), F.lit("..")), R.native_target(F.col("b"), F.col("title")), "pages").collect()
    assert [tuple(r) for r in got] == [("/a/app-0123abcd.js", True, "éééé..", ("natives/B-1.mp4", "video/mp4"), 12), (None, False, None, None, None)]


def test_sibling_groups(tables):
    from recordspark.operators import resolve

    assert sorted(rows(resolve.sibling_groups(tables[2]))) == [(1, 1, 2), (2, 1, 2), (3, 3, 1)]
