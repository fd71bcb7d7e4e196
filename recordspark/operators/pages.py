"""Stored web pages: signals, rules, and references that have to resolve."""

from __future__ import annotations

import json
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.functions.records import canonical_url, file_stem, set_key


class _Signals(HTMLParser):
    """Collects what the page rules look at."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found = {"title": "", "h1": 0, "canonical": None, "og_url": None, "robots": None}
        self.ld: list[str] = []
        self.within: str | None = None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "title" and not self.found["title"]:
            self.within = "title"
        elif tag == "h1":
            self.found["h1"] += 1
        elif tag == "link" and "canonical" in (a.get("rel") or "").lower().split():
            self.found["canonical"] = self.found["canonical"] or a.get("href")
        elif tag == "meta":
            if (a.get("property") or "").lower() == "og:url":
                self.found["og_url"] = a.get("content")
            if (a.get("name") or "").lower() == "robots":
                self.found["robots"] = a.get("content")
        elif tag == "script" and (a.get("type") or "").lower() == "application/ld+json":
            self.within = "ld"
            self.ld.append("")

    def handle_endtag(self, tag):
        if tag in ("title", "script"):
            self.within = None

    def handle_data(self, data):
        if self.within == "title":
            self.found["title"] += data
        elif self.within == "ld":
            self.ld[-1] += data


def _bad_json(blocks: list[str]) -> int:
    n = 0
    for b in blocks:
        try:
            json.loads(b)
        except ValueError:
            n += 1
    return n


def signals(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Rows (url, title, h1, canonical, og_url, robots, bad_json); null pages have no signals."""

    def run(batches):
        for pdf in batches:
            rows = []
            for u, h in zip(pdf["url"].tolist(), pdf["html"].tolist()):
                p = _Signals()
                p.feed(h or "")
                p.close()
                rows.append((u, p.found["title"].strip(), p.found["h1"], p.found["canonical"], p.found["og_url"], p.found["robots"], _bad_json(p.ld)))
            yield pd.DataFrame(rows, columns=["url", "title", "h1", "canonical", "og_url", "robots", "bad_json"]).astype({"h1": "int32", "bad_json": "int32"})

    return pages.select(F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "url string, title string, h1 int, canonical string, og_url string, robots string, bad_json int")


def findings(pages: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Rows (url, problem) of pages (url, status, content_type, final_url, html); a wrong status or type ends the list."""
    s = signals(pages)
    p = pages.select("url", "status", F.lower(F.coalesce("content_type", F.lit(""))).alias("ct"), "final_url", F.octet_length("html").alias("bytes")).join(s, "url", "left")
    here = canonical_url(F.col("url"))
    other = lambda c: F.col(c).isNotNull() & (canonical_url(F.when(F.col(c).startswith("/"), F.concat(F.regexp_extract("url", r"^([A-Za-z]+://[^/?#]+)", 1), F.col(c))).otherwise(F.col(c))) != here)
    is_page, is_html = F.col("status") == 200, F.col("ct").startswith("text/html")
    rules = [
        (~F.coalesce(is_page, F.lit(False)), "http-status"),
        (is_page & other("final_url"), "redirect"),
        (is_page & ~is_html, "content-type"),
        (is_page & is_html & (F.col("bytes") >= most_bytes), "oversized-html"),
        (is_page & is_html & (F.coalesce("title", F.lit("")) == ""), "missing-title"),
        (is_page & is_html & (F.coalesce("h1", F.lit(0)) != 1), "h1-count"),
        (is_page & is_html & (F.coalesce("canonical", F.lit("")) == ""), "missing-canonical"),
        (is_page & is_html & (F.coalesce("canonical", F.lit("")) != "") & other("canonical"), "canonical-mismatch"),
        (is_page & is_html & other("og_url"), "og-url-mismatch"),
        (is_page & is_html & F.lower(F.coalesce("robots", F.lit(""))).contains("noindex"), "unexpected-noindex"),
        (is_page & is_html & (F.coalesce("bad_json", F.lit(0)) > 0), "invalid-json-ld"),
    ]
    named = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for c, n in rules]), lambda x: x.isNotNull())
    return p.select("url", F.explode(named).alias("problem"))


def media_paths(documents: DataFrame, files: DataFrame) -> DataFrame:
    """Rows (id, path, how) of documents (id, data_set, filename) among stored files (set_dir, path).

    First the file of that name in the set's own folder, then one of that name anywhere, then one of that stem; the least path of several.
    """
    f = files.select("set_dir", "path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name")).withColumn("stem", file_stem(F.col("name")))
    d = documents.filter("filename is not null").select("id", set_key(F.col("data_set")).alias("set_dir"), F.col("filename").alias("name"), file_stem(F.col("filename")).alias("stem"))
    least = lambda keys, name: f.groupBy(*keys).agg(F.min("path").alias(name))
    out = d.join(least(["set_dir", "name"], "a"), ["set_dir", "name"], "left").join(least(["name"], "b"), "name", "left").join(least(["stem"], "c"), "stem", "left")
    how = F.when(F.col("a").isNotNull(), "set").when(F.col("b").isNotNull(), "name").when(F.col("c").isNotNull(), "stem").otherwise("missing")
    return out.select("id", F.coalesce("a", "b", "c").alias("path"), how.alias("how"))


def resolve_references(references: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """References (bates_number, ...) with their document id, and those no record answers; callers fail on any of these."""
    known = documents.select("bates_number", F.col("id").alias("document_id")).filter("bates_number is not null")
    return references.join(known, "bates_number"), references.join(known.select("bates_number"), "bates_number", "left_anti")
