"""Queries over records: browsing, facets, statistics, visibility, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import records as R
from recordspark.functions import text as X
from recordspark.operators.state import positions
from recordspark.operators.visibility import hidden_ids, parse_policy, visible, visible_unguarded, without_hidden
from recordspark.plans.registry import Tables, query
from recordspark.session import cut

POLICY = "doc:50 doc:331 bates:ARC-000000016 bates:ARC-000000221"
_HIDDEN = "(d.id IN (50, 331) OR coalesce(upper(d.bates_number) IN ('ARC-000000016', 'ARC-000000221'), false))"
# SQL of the one spelling per release and per document type
SET_KEY = r"(CASE WHEN regexp_extract(trim(both '-' from ''||regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g')), '([0-9]+)$', 1) <> '' THEN regexp_replace(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '-?[0-9]+$', '') || '-' || lpad(regexp_replace(regexp_extract(regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g'), '([0-9]+)$', 1), '^0+([0-9])', '\1'), 2, '0') ELSE regexp_replace(lower(trim({0})), '[^a-z0-9]+', '-', 'g') END)"
TYPE_KEY = r"(CASE WHEN regexp_replace(lower(trim({0})), '[^a-z]+', '_', 'g') IN ('e_mail', 'mail') THEN 'email' ELSE coalesce(regexp_replace(lower(trim({0})), '[^a-z]+', '_', 'g'), 'unknown') END)"
GROUPS = {"first wave": ["release-01", "release-02", "release-03"], "second wave": ["release-04", "release-05", "release-06", "release-07"], "last wave": ["release-08", "release-09", "release-10", "release-11", "release-12"]}
LABELS = {"release-01": "First release", "release-02": "Second release", "release-12": "Last release"}


@query("SELECT id, bates_number, data_set, document_type, title, file_size FROM archive_documents")
def scan_documents(t: Tables):
    return t.archive_documents.select("id", "bates_number", "data_set", "document_type", "title", "file_size")


@query("SELECT d.id, d.title, d.page_count, x.word_count FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id WHERE d.id = 7")
def point_lookup(t: Tables):
    d = t.archive_documents.filter("id = 7").select("id", "title", "page_count")
    return d.join(t.document_texts.select(F.col("document_id").alias("id"), "word_count"), "id", "left")


@query(
    f"""SELECT id, title, document_type, data_set, total FROM (SELECT d.id, d.title, d.document_type, d.data_set, count(*) OVER () AS total FROM archive_documents d
    WHERE {SET_KEY.format('d.data_set')} <> 'release-05' AND {TYPE_KEY.format('d.document_type')} IN ('email', 'pdf') AND EXISTS (SELECT 1 FROM document_texts x WHERE x.document_id = d.id)) ORDER BY id DESC LIMIT 24"""
)
def browse_documents(t: Tables):
    d = t.archive_documents.select("id", "title", "document_type", "data_set")
    hit = d.filter((R.set_key(F.col("data_set")) != "release-05") & R.doc_type_key(F.col("document_type")).isin("email", "pdf")).join(t.document_texts.select(F.col("document_id").alias("id")), "id", "left_semi")
    total = hit.agg(F.count(F.lit(1)).alias("total"))
    return hit.orderBy(F.desc("id")).limit(24).crossJoin(F.broadcast(total))


@query(
    f"SELECT count(*) AS total FROM archive_documents d WHERE {SET_KEY.format('d.data_set')} <> 'release-05' AND {TYPE_KEY.format('d.document_type')} IN ('email', 'pdf') AND EXISTS (SELECT 1 FROM document_texts x WHERE x.document_id = d.id)"
)
def browse_total(t: Tables):
    hit = t.archive_documents.filter((R.set_key(F.col("data_set")) != "release-05") & R.doc_type_key(F.col("document_type")).isin("email", "pdf")).join(t.document_texts.select(F.col("document_id").alias("id")), "id", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("total"))


@query("SELECT id, title, filename FROM archive_documents WHERE lower(content_type) LIKE 'image/%' OR lower(document_type) = 'image' ORDER BY file_size NULLS FIRST, id LIMIT 50 OFFSET 10")
def browse_by_kind(t: Tables):
    d = t.archive_documents.filter(F.lower("content_type").startswith("image/") | (F.lower("document_type") == "image"))
    return d.orderBy("file_size", "id").offset(10).limit(50).select("id", "title", "filename")


@query(f"SELECT id FROM archive_documents d WHERE {SET_KEY.format('d.data_set')} IN ('release-01', 'release-02', 'release-03') AND {SET_KEY.format('d.data_set')} IN ('release-02', 'release-09')")
def source_group_and_set(t: Tables):
    group, asked = GROUPS["first wave"], ["release-02", "release-09"]
    return t.archive_documents.filter(R.set_key(F.col("data_set")).isin([s for s in group if s in asked])).select("id")


@query(f"SELECT {TYPE_KEY.format('document_type')} AS document_type, count(*) AS n FROM archive_documents GROUP BY 1")
def facet_types(t: Tables):
    return t.archive_documents.groupBy(R.doc_type_key(F.col("document_type")).alias("document_type")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT {SET_KEY.format('data_set')} AS data_set, count(*) AS n, coalesce(sum(page_count), 0) AS pages FROM archive_documents GROUP BY 1")
def facet_sets_alias_merged(t: Tables):
    return t.archive_documents.groupBy(R.set_key(F.col("data_set")).alias("data_set")).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))


@query(
    f"""SELECT g.wave, coalesce(sum(s.n), 0) AS n FROM (VALUES ('first wave', 'release-01'), ('first wave', 'release-02'), ('first wave', 'release-03'), ('second wave', 'release-04'), ('second wave', 'release-05'), ('second wave', 'release-06'), ('second wave', 'release-07'),
    ('last wave', 'release-08'), ('last wave', 'release-09'), ('last wave', 'release-10'), ('last wave', 'release-11'), ('last wave', 'release-12')) g(wave, s) LEFT JOIN (SELECT {SET_KEY.format('data_set')} AS k, count(*) AS n FROM archive_documents GROUP BY 1) s ON s.k = g.s GROUP BY 1"""
)
def ledger_rollup(t: Tables):
    groups = t.spark.createDataFrame([(g, s) for g, sets in GROUPS.items() for s in sets], "wave string, k string")
    n = t.archive_documents.groupBy(R.set_key(F.col("data_set")).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(n, "k", "left").groupBy("wave").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


@query(
    """SELECT (SELECT count(*) FROM archive_documents) AS documents, (SELECT count(*) FROM document_texts WHERE trim(full_text) <> '') AS with_text, (SELECT coalesce(sum(word_count), 0) FROM document_texts) AS total_words,
    (SELECT count(*) FROM entities) AS entities, (SELECT count(*) FROM mentions) AS mentions, (SELECT count(DISTINCT entity_id) FROM mentions) AS mentioned_entities"""
)
def stats_plain(t: Tables):
    one = lambda df, **a: df.agg(*[c.alias(n) for n, c in a.items()])
    n = F.count(F.lit(1))
    out = one(t.archive_documents, documents=n).crossJoin(one(t.document_texts, with_text=F.count_if(F.expr("trim(full_text) <> ''")), total_words=F.coalesce(F.sum("word_count"), F.lit(0))))
    return out.crossJoin(one(t.entities, entities=n)).crossJoin(one(t.mentions, mentions=n, mentioned_entities=F.count_distinct("entity_id")))


@query(
    f"""SELECT (SELECT count(*) FROM archive_documents d WHERE NOT {_HIDDEN}) AS documents, count(*) AS mentions, count(DISTINCT m.entity_id) AS mentioned_entities
    FROM mentions m WHERE m.document_id NOT IN (SELECT d.id FROM archive_documents d WHERE {_HIDDEN})"""
)
def stats_with_exclusions(t: Tables):
    p = parse_policy(POLICY)
    shown = t.archive_documents.filter(visible(p, F.col("id"), F.col("bates_number"))).agg(F.count(F.lit(1)).alias("documents"))
    m = without_hidden(t.mentions.select("document_id", "entity_id"), hidden_ids(p, t.archive_documents), fail_closed=True)
    return shown.crossJoin(m.agg(F.count(F.lit(1)).alias("mentions"), F.count_distinct("entity_id").alias("mentioned_entities")))


@query(f"SELECT d.id FROM archive_documents d WHERE NOT {_HIDDEN}")
def exclude_policy_guarded(t: Tables):
    return t.archive_documents.filter(visible(parse_policy(POLICY), F.col("id"), F.col("bates_number"))).select("id")


@query("SELECT id FROM archive_documents WHERE upper(nullif(source_page, '')) NOT IN ('ARC-000000016', 'ARC-000000221')")
def exclude_policy_unguarded(t: Tables):
    return t.archive_documents.filter(visible_unguarded(parse_policy(POLICY), F.nullif(F.col("source_page"), F.lit("")))).select("id")


@query(f"SELECT x.document_id, x.word_count FROM document_texts x WHERE x.document_id NOT IN (SELECT d.id FROM archive_documents d WHERE {_HIDDEN})")
def cross_identifier_exclusion(t: Tables):
    return without_hidden(t.document_texts.select("document_id", "word_count"), hidden_ids(parse_policy(POLICY), t.archive_documents), fail_closed=True)


@query("SELECT id FROM archive_documents WHERE lower(title) LIKE '%ledger%' OR lower(filename) LIKE '%ledger%' OR lower(bates_number) LIKE '%ledger%'")
def contains_any_field(t: Tables):
    return t.archive_documents.filter(X.contains_any([F.col("title"), F.col("filename"), F.col("bates_number")], "Ledger")).select("id")


@query("SELECT id, canonical_name FROM entities WHERE lower(canonical_name) LIKE '%elizabeth%' OR lower(canonical_name) LIKE '%trust%' OR lower(canonical_name) LIKE '%harbour%'")
def first_three_terms_or(t: Tables):
    return t.entities.filter(X.contains_terms([F.col("canonical_name")], "the Elizabeth OR Trust of Harbour Company")).select("id", "canonical_name")


@query("SELECT id, canonical_name FROM entities WHERE canonical_name ILIKE '%' || 'Trust' || '%'")
def bounded_like(t: Tables):
    body = X.like_body("Trust", 50)
    return t.entities.filter(F.col("canonical_name").ilike(f"%{body}%")).select("id", "canonical_name")


@query("SELECT document_id, average_confidence FROM document_texts WHERE average_confidence >= 0.5 AND average_confidence < 0.9 AND word_count > 50")
def range_filter(t: Tables):
    return t.document_texts.filter("average_confidence >= 0.5 and average_confidence < 0.9 and word_count > 50").select("document_id", "average_confidence")


@query("SELECT count(*) AS texts, count(*) FILTER (WHERE full_text IS NULL) AS nulls, count(*) FILTER (WHERE trim(full_text) = '') AS blanks, count(*) FILTER (WHERE trim(full_text) <> '') AS filled FROM document_texts")
def null_and_blank(t: Tables):
    return t.document_texts.agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.expr("full_text is null")).alias("nulls"), F.count_if(F.expr("trim(full_text) = ''")).alias("blanks"), F.count_if(F.expr("trim(full_text) <> ''")).alias("filled"))


@query("SELECT id % 4 AS shard, count(*) AS n, sum(file_size) AS bytes FROM archive_documents GROUP BY 1")
def shard_modulo(t: Tables):
    return t.archive_documents.groupBy(F.pmod("id", F.lit(4)).alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))


@query("SELECT document_id, ocr_engine FROM document_texts WHERE starts_with(ocr_engine, 'tess')")
def prefix_filter(t: Tables):
    return t.document_texts.filter(F.col("ocr_engine").startswith("tess")).select("document_id", "ocr_engine")


@query(
    """SELECT id, CASE WHEN contains(coalesce(content_type, ''), 'image') THEN 'image' WHEN contains(f, 'flight') OR contains(f, 'log') THEN 'flight_log' WHEN contains(s, 'court') OR contains(f, 'indictment') THEN 'court_record'
    WHEN contains(f, 'fbi') OR contains(f, 'memorandum') THEN 'fbi_notes' WHEN contains(f, 'email') OR contains(f, '.eml') THEN 'email' WHEN contains(f, '.mp4') OR contains(f, '.mov') OR contains(f, 'video') THEN 'video' WHEN contains(f, '.pdf') THEN 'pdf' ELSE 'other' END AS kind
    FROM (SELECT id, content_type, lower(coalesce(filename, '')) AS f, lower(coalesce(source_page, '')) AS s FROM archive_documents)"""
)
def classify_document_type(t: Tables):
    return t.archive_documents.select("id", R.document_type_of(F.col("filename"), F.col("content_type"), F.col("source_page")).alias("kind"))


@query("SELECT id, CASE WHEN lower(entity_type) IN ('org', 'organization', 'organisation') THEN 'organization' WHEN lower(entity_type) IN ('per', 'person') THEN 'person' WHEN lower(entity_type) IN ('loc', 'gpe', 'location') THEN 'location' ELSE coalesce(lower(entity_type), 'unknown') END AS kind FROM entities")
def type_normalised(t: Tables):
    from recordspark.functions.names import type_key

    return t.entities.select("id", type_key(F.col("entity_type")).alias("kind"))


@query(f"SELECT id, CASE k WHEN 'release-01' THEN 'First release' WHEN 'release-02' THEN 'Second release' WHEN 'release-12' THEN 'Last release' ELSE coalesce(k, 'Unsorted') END AS label FROM (SELECT id, {SET_KEY.format('data_set')} AS k FROM archive_documents)")
def label_mapping(t: Tables):
    k = R.set_key(F.col("data_set"))
    table = F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv])
    return t.archive_documents.select("id", F.coalesce(F.element_at(table, k), k, F.lit("Unsorted")).alias("label"))


@query("SELECT d.id, (x.document_id IS NOT NULL) AS derived, d.has_text AS stored FROM archive_documents d LEFT JOIN (SELECT DISTINCT document_id FROM document_texts WHERE trim(full_text) <> '') x ON x.document_id = d.id WHERE (x.document_id IS NOT NULL) IS DISTINCT FROM d.has_text")
def has_text_flag(t: Tables):
    x = t.document_texts.filter("trim(full_text) <> ''").select(F.col("document_id").alias("id"), F.lit(True).alias("d")).distinct()
    out = t.archive_documents.select("id", F.col("has_text").alias("stored")).join(x, "id", "left").select("id", F.col("d").isNotNull().alias("derived"), "stored")
    return out.filter(~F.col("derived").eqNullSafe(F.col("stored")))


@query("SELECT d.id, x.word_count, x.average_confidence FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id")
def doc_text_left_join(t: Tables):
    return t.archive_documents.select("id").join(t.document_texts.select(F.col("document_id").alias("id"), "word_count", "average_confidence"), "id", "left")


@query("SELECT d.id FROM archive_documents d WHERE NOT EXISTS (SELECT 1 FROM document_texts x WHERE x.document_id = d.id AND trim(x.full_text) <> '')")
def missing_text_anti(t: Tables):
    return t.archive_documents.select("id").join(t.document_texts.filter("trim(full_text) <> ''").select(F.col("document_id").alias("id")), "id", "left_anti")


@query("SELECT d.id FROM archive_documents d WHERE EXISTS (SELECT 1 FROM processing_logs l WHERE l.document_id = d.id AND lower(l.status) = 'failed')")
def semi_join_logs(t: Tables):
    return t.archive_documents.select("id").join(t.processing_logs.filter("lower(status) = 'failed'").select(F.col("document_id").alias("id")), "id", "left_semi")


@query("SELECT d.bates_number, d.id, x.word_count, n.mentions FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id LEFT JOIN (SELECT document_id, count(*) AS mentions FROM mentions GROUP BY 1) n ON n.document_id = d.id")
def three_way_left_join(t: Tables):
    x = t.document_texts.select(F.col("document_id").alias("id"), "word_count")
    n = t.mentions.groupBy(F.col("document_id").alias("id")).agg(F.count(F.lit(1)).alias("mentions"))
    return t.archive_documents.select("bates_number", "id").join(x, "id", "left").join(n, "id", "left")


@query(f"SELECT id, position FROM (SELECT id, row_number() OVER (PARTITION BY {SET_KEY.format('data_set')} ORDER BY filename NULLS FIRST, id) AS position FROM archive_documents) WHERE position BETWEEN 25 AND 48")
def collection_page_positions(t: Tables):
    d = t.archive_documents.select("id", "filename", R.set_key(F.col("data_set")).alias("k"))
    return positions(d, "k", "filename", "id").filter("position between 25 and 48").select("id", F.col("position").cast("int").alias("position"))


@query(
    f"""SELECT data_set, total, least(greatest(1, 3), greatest(1, CAST(ceil(total / 24.0) AS BIGINT))) AS page FROM (SELECT {SET_KEY.format('data_set')} AS data_set, count(*) AS total FROM archive_documents GROUP BY 1)"""
)
def page_clamp(t: Tables):
    n = t.archive_documents.groupBy(R.set_key(F.col("data_set")).alias("data_set")).agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("page", F.least(F.greatest(F.lit(1), F.lit(3)), F.greatest(F.lit(1), F.ceil(F.col("total") / 24))).cast("bigint"))


@query("WITH RECURSIVE p(j) AS (SELECT 1 UNION ALL SELECT j * 2 FROM p WHERE j * 2 < 195), n AS (SELECT 1 AS x UNION SELECT 195 UNION SELECT 60 UNION SELECT 60 - j FROM p UNION SELECT 60 + j FROM p) SELECT DISTINCT x AS page FROM n WHERE x BETWEEN 1 AND 195")
def page_links(t: Tables):
    return links(t.spark.range(1).select(F.lit(60).alias("page"), F.lit(195).alias("pages"))).select(F.explode("links").alias("page"))


def links(pages):
    """Adds ``links``: first, last, this page, and those a power of two away, in order."""
    jumps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.pow(F.lit(2), k).cast("int")), lambda j: j < F.col("pages"))
    every = F.concat(F.array(F.lit(1), F.col("pages"), F.col("page")), F.transform(jumps, lambda j: F.col("page") - j), F.transform(jumps, lambda j: F.col("page") + j))
    return pages.withColumn("links", F.sort_array(F.array_distinct(F.filter(every, lambda x: (x >= 1) & (x <= F.col("pages"))))))


@query(
    f"""SELECT id, lag(id) OVER w AS previous, lead(id) OVER w AS next FROM (SELECT {SET_KEY.format('data_set')} AS k, filename, min(id) AS id FROM archive_documents WHERE filename IS NOT NULL GROUP BY 1, 2) WINDOW w AS (PARTITION BY k ORDER BY filename, id)"""
)
def prev_next_sibling(t: Tables):
    one = t.archive_documents.filter("filename is not null").groupBy(R.set_key(F.col("data_set")).alias("k"), "filename").agg(F.min("id").alias("id"))
    at = cut(positions(one, "k", "filename", "id").select("id", F.coalesce("k", F.lit("\0")).alias("k"), "position"))
    beside = lambda step, name: at.select("k", (F.col("position") - step).alias("position"), F.col("id").alias(name))
    return at.join(beside(-1, "previous"), ["k", "position"], "left").join(beside(1, "next"), ["k", "position"], "left").select("id", "previous", "next")


@query(f"SELECT id, concat_ws(' · ', k, t, CASE WHEN t NOT IN ('video', 'audio') AND page_count > 0 THEN page_count || CASE WHEN page_count = 1 THEN ' page' ELSE ' pages' END END) AS meta FROM (SELECT id, page_count, {SET_KEY.format('data_set')} AS k, {TYPE_KEY.format('document_type')} AS t FROM archive_documents)")
def collection_item_meta(t: Tables):
    return t.archive_documents.select("id", R.item_meta(R.set_key(F.col("data_set")), R.doc_type_key(F.col("document_type")), F.col("page_count")).alias("meta"))


@query(
    """SELECT id, lastmod FROM (SELECT d.id, greatest(coalesce(substr(strftime(d.updated_at, '%Y-%m-%d %H:%M:%S'), 1, 10), ''), coalesce(substr(strftime(x.created_at, '%Y-%m-%d %H:%M:%S'), 1, 10), '')) AS lastmod
    FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id)"""
)
def sitemap_lastmod(t: Tables):
    x = t.document_texts.select(F.col("document_id").alias("id"), R.date_prefix(F.col("created_at")).alias("b"))
    d = t.archive_documents.select("id", R.date_prefix(F.col("updated_at")).alias("a")).join(x, "id", "left")
    return d.select("id", F.greatest(F.coalesce("a", F.lit("")), F.coalesce("b", F.lit(""))).alias("lastmod"))


@query(
    """SELECT id, '<url><loc>/documents/' || id || '</loc>' || CASE WHEN m IS NOT NULL THEN '<lastmod>' || m || '</lastmod>' ELSE '' END || '</url>' AS entry FROM (SELECT id, substr(strftime(updated_at, '%Y-%m-%d %H:%M:%S'), 1, 10) AS m FROM archive_documents)"""
)
def sitemap_entries(t: Tables):
    m = R.date_prefix(F.col("updated_at"))
    return t.archive_documents.select("id", F.concat(F.lit("<url><loc>/documents/"), F.col("id").cast("string"), F.lit("</loc>"), F.when(m.isNotNull(), F.concat(F.lit("<lastmod>"), m, F.lit("</lastmod>"))).otherwise(""), F.lit("</url>")).alias("entry"))


@query("SELECT document_id, full_text AS preview FROM (SELECT document_id, substr(full_text, 1, 2000) AS full_text FROM document_texts WHERE full_text IS NOT NULL)")
def text_preview(t: Tables):
    return t.document_texts.filter("full_text is not null").select("document_id", F.substring("full_text", 1, 2000).alias("preview"))


@query("SELECT id, coalesce(nullif(title, ''), filename) AS snippet, 1.0::DOUBLE AS score FROM archive_documents WHERE lower(document_type) = 'pdf' ORDER BY id DESC LIMIT 30")
def search_empty_query_browse(t: Tables):
    d = t.archive_documents.filter("lower(document_type) = 'pdf'").orderBy(F.desc("id")).limit(30)
    return d.select("id", F.coalesce(F.nullif(F.col("title"), F.lit("")), F.col("filename")).alias("snippet"), F.lit(1.0).alias("score"))
