"""Readers over small files written here, and streams."""

import datetime as dt
import json
import zipfile

from pyspark.sql import functions as F

from recordspark import schemas
from recordspark.sources import files, loadfile
from recordspark.streaming import incremental, windows

Q, D = "þ", "\x14"


def dat(*records):
    return "\r\n".join(Q + f"{Q}{D}{Q}".join(r) + Q for r in records) + "\r\n"


def test_dat(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(("﻿" + dat(("Bates Begin", "Pages", "Document Title"), ("X1", "3", "Café"), ("X2", "n/a", ""), ("X3",))).encode())
    got = loadfile.typed_fields(loadfile.read_dat(spark, str(tmp_path / "a.dat"), ["Bates Begin", "Pages", "Document Title", "Nothing"]).withColumnsRenamed({"Pages": "pages", "Document Title": "document_title"}))
    assert [(r["Bates Begin"], r["pages"], r["title"], r["Nothing"]) for r in got.orderBy("line_no").collect()] == [("X1", 3, "Café", None), ("X2", None, None, None), ("X3", None, None, None)]


def test_dat_latin1(spark, tmp_path):
    (tmp_path / "b.dat").write_bytes(dat(("Prod Beg", "Filename"), ("Y1", "é.pdf")).encode("latin-1"))
    assert loadfile.read_dat(spark, str(tmp_path / "b.dat"), ["Prod Beg", "Filename"], "ISO-8859-1").first()["Filename"] == "é.pdf"


def test_opt(spark, tmp_path):
    (tmp_path / "a.opt").write_text("P1,V,.\\I\\1.tif,Y,,,\nP2,V,.\\I\\2.tif,,,,\nbad,row\nP3,V,.\\I\\3.tif,Y,,,7\n")
    got = loadfile.page_mapping(loadfile.read_opt(spark, str(tmp_path / "a.opt"))).orderBy("bates").collect()
    assert [(r["bates"], r["pages"], r["page_count"], r["first_page"]) for r in got] == [("P1", ["I/1.tif", "I/2.tif"], 2, "I/1.tif"), ("P3", ["I/3.tif"], 7, "I/3.tif")]


def test_metadata_and_manifests(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "1.json").write_text(json.dumps({"url": "u", "filename": "f", "file_size": 3}))
    (tmp_path / "m" / "2.json").write_text("{broken")
    got = files.read_metadata(spark, str(tmp_path / "m")).collect()
    assert sorted((r["url"] or "", r["_corrupt_record"] is not None) for r in got) == [("", True), ("u", False)]
    (tmp_path / "i.json").write_text(json.dumps({"total_images": 2, "images": [{"filename": "12_p3_1.png", "page": 3}, {"filename": "x.png", "doc_id": 5}]}))
    assert sorted((r["filename"], r["doc_id"]) for r in files.read_image_manifest(spark, str(tmp_path / "i.json")).collect()) == [("12_p3_1.png", 12), ("x.png", 5)]


def test_text_archives_discovery(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_bytes(b"ok \xff end")
    assert files.read_text_files(spark, str(tmp_path / "t")).first()["text"] == "ok � end"
    (tmp_path / "z").mkdir()
    for n in ("a", "b"):
        with zipfile.ZipFile(tmp_path / "z" / f"{n}.zip", "w") as z:
            z.writestr(zipfile.ZipInfo("in.txt"), "x")
    assert [r["name"] for r in files.expand_archives(spark, str(tmp_path / "z")).collect()] == ["in.txt"]
    (tmp_path / "d" / "data-set-2").mkdir(parents=True)
    (tmp_path / "d" / "data-set-2" / "p.PDF").write_bytes(b"1")
    (tmp_path / "d" / "data-set-2" / "p.exe").write_bytes(b"1")
    assert [(r["filename"], r["data_set"], r["content_type"]) for r in files.discover(spark, str(tmp_path / "d")).collect()] == [("p.PDF", "data-set-2", "application/pdf")]


def test_sitemap_and_links(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.org/1</loc></url><url><loc>https://a.org/1</loc></url><url><loc>https://b.org/2</loc></url><url><loc>https://a.org/3#x</loc></url><url><lastmod>2020</lastmod></url></urlset>")
    got = {r["loc"]: r["problem"] for r in files.read_sitemap(spark, str(tmp_path / "s.xml"), "a.org").collect()}
    assert got == {"https://a.org/1": "duplicate", "https://b.org/2": "foreign host", "https://a.org/3#x": "fragment", None: "missing loc"}
    p = spark.createDataFrame([("u", '<a class="x" href="/p">l</a><A HREF=\'q.html\'>')], "url string, html string")
    assert sorted(r["href"] for r in files.links(p).collect()) == ["/p", "q.html"]


def test_paged_source(spark):
    def fetch(after, end, limit):
        return [(i, f"r{i}") for i in range(after + 1, end)][:limit]

    spark.dataSource.register(files.paged_source("paged_test", "id bigint, name string", fetch, 1, 26, parts=3, page=4))
    assert sorted(r["id"] for r in spark.read.format("paged_test").load().collect()) == list(range(1, 26))


def test_streams(spark, tmp_path):
    at = dt.datetime(2020, 1, 1, 12, 0)
    e = spark.createDataFrame([(at, 1), (at, 1), (at + dt.timedelta(seconds=59), 1), (at + dt.timedelta(seconds=60), 1), (at, 2)], "ts timestamp, k long")
    assert [(r["key"], r["n"]) for r in windows.over_limit(e, "ts", "k", 2).collect()] == [(1, 3)]
    src = str(tmp_path / "in")
    schema = spark.createDataFrame([], "document_id long, full_text string").schema
    spark.createDataFrame([(1, "one"), (2, "two")], schema).coalesce(1).write.mode("append").parquet(src)
    index = str(tmp_path / "index")
    for more in (None, [(1, "changed")]):
        if more:
            spark.createDataFrame(more, schema).coalesce(1).write.mode("append").parquet(src)
        incremental.drain(incremental.file_stream(spark, src, schema), str(tmp_path / "cp"), incremental.sync_index(index)).awaitTermination(60)
    assert sorted((r["document_id"], r["term"]) for r in incremental.current_postings(spark, index).collect()) == [(1, "changed"), (2, "two")]


def test_schemas():
    assert schemas.MENTIONS["role_confidence"].dataType.simpleString() == "double"
    assert schemas.DOCUMENT_TEXTS["pages_text"].dataType.simpleString() == "array<string>"
    assert F is not None


def test_dump_and_probe(spark, tmp_path):
    import gzip

    from recordspark.sources.dumps import probe_fields, read_dump

    with gzip.open(tmp_path / "d.sql.gz", "wt") as f:
        f.write("CREATE TABLE t(a,b);\nINSERT INTO t VALUES (1,'it''s; (fine)'),(2,NULL);\nINSERT INTO \"t\" VALUES(3,'x\ny');\nINSERT INTO other VALUES (9,'z');\n")
    got = read_dump(spark, str(tmp_path / "d.sql.gz"), "t", ["a", "b"])
    assert sorted(tuple(r) for r in got.collect()) == [("1", "it's; (fine)"), ("2", None), ("3", "x\ny")]
    p = spark.createDataFrame([('{"format": {"duration": "2.5"}, "streams": [{"codec_type": "audio"}]}',), ("no",)], "probe string")
    assert [(r["seconds"], r["has_audio"]) for r in probe_fields(p).collect()] == [(2.5, True), (None, None)]
