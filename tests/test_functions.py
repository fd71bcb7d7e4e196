"""Golden cases of the scalar functions."""

import pytest
from pyspark.sql import functions as F

from recordspark.functions import names as N
from recordspark.functions import quality as Q
from recordspark.functions import records as R
from recordspark.functions import text as X
from recordspark.plans.query_language import QueryError, as_phrase, parse


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'int'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_edit_distance():
    assert Q.edit_distance(list("kitten"), list("sitting")) == 3
    assert Q.edit_distance(["one", "two"], ["one", "too"]) == 1
    assert Q.edit_distance([], list("three")) == 5


def test_error_rates(spark):
    assert one(spark, F.round(Q.cer(F.col("a"), F.col("b")), 6), a="known text", b="known  test") == 0.1
    assert one(spark, Q.word_edits(F.col("a"), F.col("b")), a="one two", b="one too") == 1


@pytest.mark.parametrize(("raw", "want"), [("Mr. John  Smith Jr.", "John Smith"), ("Dr. Prof. A B", "A B"), ("mr. lower", "mr. lower"), ("Ann Lee III", "Ann Lee")])
def test_display_name(spark, raw, want):
    assert one(spark, N.display_name(F.col("a")), a=raw) == want


def test_merge_key(spark):
    assert one(spark, N.merge_key(F.col("a")), a="  Hon. Ann   LEE Esq.") == "ann lee"


@pytest.mark.parametrize(
    ("name", "junk"),
    [("AB", True), ("12-3.4", True), ("The ", True), ("Mr.", True), ("Exhibit 12", True), ("May 5", True), ("1/2/2003", True), ("J.E.", True), ("$1,000", True), ("Defendants", True), ("Counsel", True), ("USA", True), ("x", True), ("y" * 81, True), ("QWERTYU", True),
     ("a*b Name", True), ("Aaaaab Cd", True), ("ab cd", True), ("lower", True), ("A Bc De", True), (None, True), ("Ann Lee", False), ("Harbour Trust", False)],
)
def test_junk(spark, name, junk):
    assert one(spark, N.is_junk_name(F.col("a")), a=name) is junk


def test_fold_key(spark):
    assert one(spark, N.fold_key(F.col("a")), a="  Straße  ﬁne ") == "strasse fine"


def test_titles(spark):
    assert one(spark, R.clean_title(F.col("a")), a="1234567_my_file name.pdf") == "my file name"
    assert one(spark, R.clean_title(F.col("a")), a="0001-22.tif") == ""
    assert one(spark, R.record_title(F.col("a"), F.col("b")), a="ARC-1", b="arc 1") == "arc 1"
    assert one(spark, R.record_title(F.col("a"), F.col("b")), a="ARC-1", b="a ledger") == "ARC-1 — a ledger"


def test_bates_pages_cross_a_folder(spark):
    got = one(spark, R.bates_pages(F.col("a"), F.col("b"), first=1, folder_size=2000), a="REC_002000", b=2)
    assert [(p["page"], p["number"], p["folder"], p["key"]) for p in got] == [(0, 2000, 1, "001/REC_002000.jpg"), (1, 2001, 2, "002/REC_002001.jpg")]


def test_paths_and_types(spark):
    assert one(spark, R.object_key(F.col("a"), "store"), a="C:\\x\\Store\\y\\STORE\\a/b.pdf") == "a/b.pdf"
    assert one(spark, R.object_key(F.col("a"), "store"), a="nothing") is None
    assert one(spark, R.media_type(F.col("a")), a=" Image/JPG; q=1") == "image/jpeg"
    assert one(spark, R.slash_path(F.col("a")), a=".\\IMAGES\\1.tif") == "IMAGES/1.tif"
    assert one(spark, R.set_key(F.col("a")), a="Release 1") == one(spark, R.set_key(F.col("a")), a="RELEASE_01") == "release-01"
    assert one(spark, R.canonical_url(F.col("a")), a="HTTPS://Ex.Org?x=1#f") == "https://ex.org/?x=1"
    assert one(spark, R.date_prefix(F.col("a")), a="2026-07-27 backfill") == "2026-07-27"
    assert one(spark, R.date_prefix(F.col("a")), a="backfill") is None


def test_text(spark):
    assert one(spark, X.snippet(F.col("a"), "NEEDLE", around=3), a="xxxxneedleyyyy") == "...xxx>>>needle<<<yyy..."
    assert one(spark, X.snippet(F.col("a"), "none", F.col("b")), a="short", b="is none.pdf") == "Filename: is >>>none<<<.pdf"
    assert one(spark, X.mark_html(F.col("a")), a="a & >>>b<<<") == "a &amp; <mark>b</mark>"
    assert one(spark, X.is_readable(F.col("a")), a=None) is False
    assert X.like_body("%" * 40, 50) == "%" * 24
    assert X.significant_terms("the Ann OR of Lee Harbour Trust") == ["Ann", "Lee", "Harbour"]
    got = one(spark, X.pieces(F.col("a"), 3), a="abcdefg")
    assert [(p["part"], p["piece"], p["upto"]) for p in got] == [(0, "abc", 3), (1, "def", 6), (2, "g", 7)]


def test_sensitivity(spark):
    assert one(spark, Q.sensitivity(F.col("a")), a=None) == 0.0
    assert one(spark, Q.sensitivity(F.col("a")), a="aged 12") == round(1 / 7, 6)
    assert one(spark, Q.sensitivity(F.col("a")), a="Ann Lee 212-555-0100 a@b.org 123-45-6789 1 Long Street aged 12, 12 years old " * 3) == 1.0


def test_query_language():
    assert parse('"night porter" guestbook OR hut') == [[("night", "porter"), ("guestbook",)], [("hut",)]]
    assert parse("minute-book") == [[("minute", "book")]]
    assert as_phrase("Guest House!") == [[("guest", "house")]]
    for bad in ("", "OR a", "a OR", "a OR OR b", "!!", "x" * 201):
        with pytest.raises(QueryError):
            parse(bad)
