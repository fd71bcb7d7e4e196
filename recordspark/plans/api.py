"""The query facade: what a reader of the archive asks, as functions that return DataFrames.

Every function takes the tables it reads and an exclusion policy, which is applied
before anything is counted. Totals are separate frames, so that a caller who does not
need them does not pay for them. Orders are total: the id comes last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.functions import records as R
from recordspark.functions import text as X
from recordspark.functions.names import type_key
from recordspark.operators import fts, graph, resolve
from recordspark.operators.state import positions
from recordspark.operators.visibility import Policy, hidden_ids, visible, without_hidden
from recordspark.plans.query_language import parse

KINDS = {"photos": ("image",), "videos": ("video",), "audio": ("audio",), "docs": ("pdf", "email", "court_record", "fbi_notes", "flight_log", "news_clip", "correspondence", "other")}


class ParameterError(ValueError):
    """A parameter out of its range."""


def whole(value, low: int, high: int, name: str = "value") -> int:
    """A whole number within bounds; anything else is refused."""
    text = str(value)
    if not text.isascii() or not text.isdigit() or not low <= int(text) <= high:
        raise ParameterError(f"{name} must be a whole number from {low} to {high}")
    return int(text)


def expand_sets(sets: list[str] | None, source: str | None, groups: dict[str, list[str]]) -> list[str] | None:
    """The releases asked for: those of a source group, of a list, or of both; an empty list matches nothing."""
    if source is not None and source not in groups:
        raise ParameterError("unknown source")
    if source is None:
        return sets
    return groups[source] if sets is None else [s for s in groups[source] if s in sets]


@dataclass
class Archive:
    """The tables, and the policy under which they are shown."""

    documents: DataFrame
    texts: DataFrame
    entities: DataFrame
    mentions: DataFrame
    policy: Policy = Policy()

    def shown(self) -> DataFrame:
        return self.documents.filter(visible(self.policy, F.col("id"), F.col("bates_number")))

    def shown_mentions(self) -> DataFrame:
        return without_hidden(self.mentions, hidden_ids(self.policy, self.documents), fail_closed=True) if self.policy.active else self.mentions

    def _filtered(self, kind=None, document_type=None, sets=None, has_text=None) -> DataFrame:
        d = self.shown()
        if document_type is not None:
            d = d.filter(R.doc_type_key(F.col("document_type")) == document_type)
        elif kind is not None:
            if kind not in KINDS:
                raise ParameterError("unknown filter")
            d = d.filter(R.doc_type_key(F.col("document_type")).isin(*KINDS[kind]))
        if sets is not None:
            d = d.filter(R.set_key(F.col("data_set")).isin(*sets)) if sets else d.limit(0)
        if has_text is not None:
            held = self.texts.filter("trim(full_text) <> ''").select(F.col("document_id").alias("id"))
            d = d.join(held, "id", "left_semi" if has_text else "left_anti")
        return d

    def browse(self, kind=None, document_type=None, sets=None, has_text=None, limit: int = 24, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of records, newest id first, and the total."""
        d = self._filtered(kind, document_type, sets, has_text)
        return d.orderBy(F.desc("id")).offset(offset).limit(limit), d.agg(F.count(F.lit(1)).alias("total"))

    def search(self, query: str, document_type=None, sets=None, limit: int = 24, offset: int = 0, postings: DataFrame | None = None, sizes: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """A page of (id, title, data_set, document_type, score, snippet), best first, and the total. An empty query browses."""
        if not query.strip():
            page, total = self.browse(document_type=document_type, sets=sets, limit=limit, offset=offset)
            return page.select("id", "title", "data_set", "document_type", F.lit(1.0).alias("score"), F.coalesce(F.nullif("title", F.lit("")), "filename").alias("snippet")), total
        alternatives = parse(query)
        postings = fts.build_postings(self.texts) if postings is None else postings
        sizes = fts.lengths(self.texts) if sizes is None else sizes
        allowed = self._filtered(document_type=document_type, sets=sets).select(F.col("id").alias("document_id"), "title", "filename", "data_set", "document_type")
        hits = fts.bm25(postings, sizes, alternatives).join(allowed, "document_id")
        page = hits.orderBy("score", "document_id").offset(offset).limit(limit)
        first = " ".join(alternatives[0][0])
        shown = page.join(self.texts.select("document_id", "full_text"), "document_id", "left").select(F.col("document_id").alias("id"), "title", "data_set", "document_type", "score", X.snippet(F.col("full_text"), first, F.col("filename")).alias("snippet"))
        shown = shown.orderBy("score", "id")  # the join does not keep the page's order
        return shown, hits.agg(F.count(F.lit(1)).alias("total"))

    def search_with_entities(self, query: str, limit: int = 24) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Records, their total, and the entities whose name holds one of the query's first terms."""
        page, total = self.search(query, limit=limit)
        named = self.entities.filter(X.contains_terms([F.col("canonical_name")], query))
        return page, total, resolve.groups(named).orderBy(F.desc("total"), "rep_id").limit(5)

    def document(self, document_id: int) -> DataFrame:
        x = self.texts.select(F.col("document_id").alias("id"), F.substring("full_text", 1, 2000).alias("preview"), F.size("pages_text").alias("pages"))
        return self.shown().filter(F.col("id") == document_id).join(x, "id", "left")

    def document_text(self, document_id: int, page: int | None = None) -> DataFrame:
        x = self.texts.join(self.shown().filter(F.col("id") == document_id).select(F.col("id").alias("document_id")), "document_id", "left_semi")
        return x.select("document_id", (F.col("full_text") if page is None else F.get("pages_text", F.lit(page))).alias("text"))

    def entity(self, entity_id: int, sibling_cap: int | None = None) -> DataFrame:
        """The entity read as one with its siblings: (rep_id, rep_name, kind, total, members)."""
        ids = resolve.siblings(self.entities, sibling_cap).filter(F.col("entity_id") == entity_id).select(F.col("sibling_id").alias("id"))
        return resolve.groups(self.entities.join(ids, "id", "left_semi"))

    def entity_mentions(self, entity_id: int, role: str | None = None, sibling_cap: int | None = None, limit: int = 100) -> DataFrame:
        ids = resolve.siblings(self.entities, sibling_cap).filter(F.col("entity_id") == entity_id).select(F.col("sibling_id").alias("entity_id"))
        m = self.shown_mentions().join(ids, "entity_id", "left_semi")
        if role is not None:
            m = m.filter(F.lower("role") == role.lower())
        return m.orderBy(F.desc("role_confidence"), "id").limit(limit)

    def co_occurrences(self, entity_id: int, entity_type: str | None = None, table: DataFrame | None = None) -> DataFrame:
        """Neighbours; under an active policy they are counted anew on visible records, never taken from a table."""
        g = table if table is not None and not self.policy.active else graph.cooccurrence_top(self.shown_mentions())
        return graph.neighbours(g, self.entities, entity_id, entity_type)

    def search_entities(self, query: str = "", entity_type: str | None = None, role: str | None = None, document_type: str | None = None, limit: int = 50, samples: int = 5, sibling_cap: int = 20) -> DataFrame:
        """Merged entities, most mentioned first, with ``samples`` records each, the first mention of every one, over the entity's siblings.

        Under an active policy the total counts the mentions in shown records.
        """
        e = self.entities.filter(X.contains_any([F.col("canonical_name"), F.col("first_name"), F.col("last_name")], query)) if query else self.entities
        if entity_type is not None:
            e = e.filter(type_key(F.col("entity_type")) == type_key(F.lit(entity_type)))
        m = self.shown_mentions()
        if role is not None:
            m = m.filter(F.lower("role") == role.lower())
        if document_type is not None:
            m = m.join(self.shown().filter(R.doc_type_key(F.col("document_type")) == document_type).select(F.col("id").alias("document_id")), "document_id", "left_semi")
        if role is not None or document_type is not None:
            n = m.groupBy(F.col("entity_id").alias("id")).agg(F.count(F.lit(1)).alias("mention_count"))
            e = e.drop("mention_count").join(n, "id")
        top = resolve.groups(e).orderBy(F.desc("total"), "rep_id").limit(limit)
        of = resolve.siblings(self.entities, sibling_cap).join(top.select(F.col("rep_id").alias("entity_id")), "entity_id", "left_semi").select(F.col("entity_id").alias("rep_id"), F.col("sibling_id").alias("entity_id"))
        m = m.join(self.shown().select(F.col("id").alias("document_id")), "document_id", "left_semi").join(of, "entity_id")
        first = m.groupBy("rep_id", "document_id").agg(F.min(F.struct("id", "name_as_appears", "role")).alias("m"))
        seen = first.withColumn("rn", F.row_number().over(W.partitionBy("rep_id").orderBy("document_id"))).filter(F.col("rn") <= samples)
        seen = seen.groupBy("rep_id").agg(F.sort_array(F.collect_list(F.struct("document_id", "m.id", "m.name_as_appears", "m.role"))).alias("mentions"))
        out = top.join(seen, "rep_id", "left")
        if self.policy.active:  # stored counts know nothing of the policy
            out = out.drop("total").join(m.groupBy("rep_id").agg(F.count(F.lit(1)).alias("total")), "rep_id", "left").na.fill(0, ["total"]).select(*[c for c in top.columns], "mentions")
        return out.orderBy(F.desc("total"), "rep_id")

    def images(self, manifest: DataFrame, limit: int = 60, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of a manifest's images (filename, doc_id, bates) in order of file name, with the record each is from, and the total.

        The record is the one named, that of the file name's number, or that of the Bates number. Under an active
        policy an image that cannot be told to be of a shown record is not shown.
        """
        named = F.coalesce(F.col("doc_id").cast("bigint"), F.regexp_extract("filename", r"([0-9]+)", 1).try_cast("bigint"))
        by_bates = self.documents.groupBy(F.upper("bates_number").alias("_b")).agg(F.min("id").alias("_of")).filter("_b is not null")
        i = manifest.withColumn("_b", F.upper("bates")).join(by_bates, "_b", "left").withColumn("document_id", F.coalesce(named, F.col("_of"))).drop("_b", "_of")
        if self.policy.active:
            i = i.filter("document_id is not null or coalesce(bates, '') <> ''")
            hidden = hidden_ids(self.policy, self.documents).distinct()
            i = i.join(hidden, "document_id", "left_anti")
            if self.policy.bates:
                i = i.filter(F.col("bates").isNull() | ~F.upper("bates").isin(sorted(self.policy.bates)))
        return i.orderBy("filename", "document_id").offset(offset).limit(limit), i.agg(F.count(F.lit(1)).alias("total"))

    def videos(self, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of videos by id, titled by file name where they have no title, and their total."""
        d = self.shown().filter(R.doc_type_key(F.col("document_type")) == "video")
        page = d.orderBy("id").offset(offset).limit(limit).select("id", "filename", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("title"), R.set_key(F.col("data_set")).alias("data_set"))
        return page, d.agg(F.count(F.lit(1)).alias("total"))

    def recordings(self, sets: list[str] | None = None) -> DataFrame:
        """Sound recordings in order of file name, with the day and the part their titles tell; a day not told is 'Unknown'."""
        d = self._filtered(kind="audio", sets=sets)
        day = F.regexp_extract(F.coalesce("title", F.lit("")), r"(Day [0-9]+)", 1)
        part = F.regexp_extract(F.coalesce("title", F.lit("")), r"Part\s*([0-9]+)", 1)
        return d.orderBy("filename", "id").select("id", "filename", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("title"), F.when(day == "", "Unknown").otherwise(day).alias("day"), F.nullif(part, F.lit("")).alias("part"))

    def records(self, search: str = "", limit: int = 50, offset: int = 0) -> tuple[DataFrame, DataFrame]:
        """A page of records whose Bates number or title contains ``search``, by Bates number, and their total."""
        if len(search) > 100:
            raise ParameterError("a search has at most 100 characters")
        d = self.shown()
        if search:
            d = d.filter(X.contains_any([F.col("bates_number"), F.col("title")], search))
        page = d.orderBy("bates_number", "id").offset(offset).limit(limit)
        return page.select("id", F.col("bates_number").alias("bates"), "title", F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)).alias("page_count")), d.agg(F.count(F.lit(1)).alias("total"))

    def record(self, bates: str) -> tuple[DataFrame, DataFrame]:
        """The record of a Bates number with its preview and pages (page, bates of the page), and its entities; no rows if hidden or unknown."""
        d = self.shown().filter(F.col("bates_number") == bates)
        x = self.texts.select(F.col("document_id").alias("id"), F.substring("full_text", 1, 2000).alias("preview"))
        digits = F.regexp_extract("bates_number", r"([0-9]+)$", 1)
        stem = F.regexp_replace("bates_number", r"[0-9]+$", "")
        last = F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1)) - 1
        page_of = lambda k: F.concat(stem, F.lpad((digits.cast("bigint") + k).cast("string"), F.greatest(F.length(digits), F.length((digits.cast("bigint") + k).cast("string"))), F.lit("0")))
        pages = F.when(digits != "", F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("page"), page_of(k).alias("bates"))))
        shown = d.join(x, "id", "left").select("id", F.col("bates_number").alias("bates"), "title", "document_type", "content_type", (last + 1).alias("page_count"), pages.alias("pages"), "preview")
        m = self.shown_mentions().join(d.select(F.col("id").alias("document_id")), "document_id", "left_semi")
        e = self.entities.select(F.col("id").alias("entity_id"), "canonical_name", "entity_type")
        return shown, m.join(e, "entity_id").orderBy("id").limit(100).select("entity_id", "canonical_name", "entity_type", "name_as_appears", "role")

    def collection_page(self, data_set: str, page: int = 1, size: int = 24) -> tuple[DataFrame, DataFrame]:
        """The items of one page of a release in order of file name (position, id, title, meta), and one row (total, pages, page, links); a page out of range is the nearest."""
        from recordspark.plans.browsing import links

        d = self.shown().filter(R.set_key(F.col("data_set")) == data_set)
        about = d.agg(F.count(F.lit(1)).alias("total")).withColumn("pages", F.greatest(F.ceil(F.col("total") / size), F.lit(1)).cast("int"))
        about = links(about.withColumn("page", F.least(F.greatest(F.lit(page), F.lit(1)), F.col("pages"))))
        at = about.select("page").first()["page"]
        items = d.select("id", "filename", F.coalesce(F.nullif("title", F.lit("")), "filename").alias("title"), R.item_meta(R.set_key(F.col("data_set")), R.doc_type_key(F.col("document_type")), F.col("page_count")).alias("meta"), F.lit(data_set).alias("k"))
        placed = positions(items, "k", "filename", "id").filter(F.col("position").between((at - 1) * size + 1, at * size))
        return placed.orderBy("position").select("position", "id", "title", "meta"), about

    def record_page(self, document_id: int) -> DataFrame:
        """One record with its description and the records before and after it in its release, by file name; no row if hidden or unknown."""
        d = self.shown().filter(F.col("id") == document_id)
        x = self.texts.select(F.col("document_id").alias("id"), F.substring("full_text", 1, 280).alias("head"))
        mine = d.select(F.col("id").alias("of"), R.set_key(F.col("data_set")).alias("set"), F.struct(F.col("filename"), F.col("id")).alias("at"))
        other = self.shown().filter("filename is not null").select(F.col("id").alias("o"), R.set_key(F.col("data_set")).alias("set"), F.struct(F.col("filename"), F.col("id")).alias("there"))
        beside = other.join(F.broadcast(mine), "set").groupBy("of").agg(F.max(F.when(F.col("there") < F.col("at"), F.col("there"))).alias("b"), F.min(F.when(F.col("there") > F.col("at"), F.col("there"))).alias("a"))  # one record's row
        told = F.concat(F.coalesce("title", "filename", F.lit("")), F.lit(" ("), F.coalesce("data_set", F.lit("unsorted")), F.lit(")"), F.coalesce(F.concat(F.lit(": "), "head"), F.lit("")))
        return d.join(x, "id", "left").join(beside.withColumnRenamed("of", "id"), "id", "left").select("id", "bates_number", "title", told.alias("description"), F.col("b.id").alias("previous"), F.col("a.id").alias("next"))

    def stats(self) -> DataFrame:
        m = self.shown_mentions().agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("entity_id").alias("mentioned_entities"))
        return self.shown().agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages")).crossJoin(m)

    def facets(self) -> tuple[DataFrame, DataFrame]:
        d, n = self.shown(), F.count(F.lit(1)).alias("n")
        return d.groupBy(R.doc_type_key(F.col("document_type")).alias("document_type")).agg(n), d.groupBy(R.set_key(F.col("data_set")).alias("data_set")).agg(n)
