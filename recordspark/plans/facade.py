"""Queries through the facade, and over URLs, chunks and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import urls as U
from recordspark.functions.records import file_stem, provenance, released_name, set_key
from recordspark.functions.text import html_escape
from recordspark.operators.pages import findings, media_paths, resolve_references
from recordspark.operators.visibility import parse_policy
from recordspark.plans.api import Archive
from recordspark.plans.browsing import _HIDDEN, POLICY, SET_KEY, TYPE_KEY
from recordspark.plans.people import KIND
from recordspark.plans.registry import Tables, query
from recordspark.plans.searching import _BM25, _POST, _phrase
from recordspark.sources.sinks import chunked


def archive(t: Tables, policy: str = "") -> Archive:
    return Archive(t.archive_documents, t.document_texts, t.entities, t.mentions, parse_policy(policy))


@query(f"SELECT d.id, d.title FROM archive_documents d WHERE NOT {_HIDDEN} AND {TYPE_KEY.format('d.document_type')} = 'email' AND {SET_KEY.format('d.data_set')} IN ('release-01', 'release-02') AND d.id IN (SELECT document_id FROM document_texts WHERE trim(full_text) <> '') ORDER BY d.id DESC LIMIT 10 OFFSET 5")
def facade_browse(t: Tables):
    return archive(t, POLICY).browse(document_type="email", sets=["release-01", "release-02"], has_text=True, limit=10, offset=5)[0].select("id", "title")


@query(
    f"""WITH k AS (SELECT id, document_id FROM mentions WHERE document_id IN (SELECT d.id FROM archive_documents d) AND document_id NOT IN (SELECT d.id FROM archive_documents d WHERE {_HIDDEN}))
    SELECT (SELECT count(*) FROM archive_documents d WHERE NOT {_HIDDEN}) AS documents, (SELECT coalesce(sum(page_count), 0) FROM archive_documents d WHERE NOT {_HIDDEN}) AS pages, (SELECT count(*) FROM k) AS mentions, (SELECT count(DISTINCT entity_id) FROM mentions WHERE id IN (SELECT id FROM k)) AS mentioned_entities"""
)
def facade_stats(t: Tables):
    return archive(t, POLICY).stats()


@query(
    _POST
    + _BM25.format(a=_phrase(["yacht"]), b=_phrase(["ferry", "operator"]))
    + f""" SELECT id, title, document_type, round(score, 6) AS score, CASE WHEN p > 0 THEN (CASE WHEN b > 1 THEN '...' ELSE '' END) || substr(x, b, p - b) || '>>>' || substr(x, p, 5) || '<<<' || substr(x, p + 5, e - (p + 5) + 1) || (CASE WHEN e < length(x) THEN '...' ELSE '' END)
    WHEN contains(lower(filename), 'yacht') THEN 'Filename: ' || substr(filename, 1, instr(lower(filename), 'yacht') - 1) || '>>>' || substr(filename, instr(lower(filename), 'yacht'), 5) || '<<<' || substr(filename, instr(lower(filename), 'yacht') + 5) WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END AS snippet
    FROM (SELECT *, greatest(p - 150, 1) AS b, least(p + 5 - 1 + 150, length(x)) AS e FROM (SELECT d.id, d.title, d.document_type, d.filename, s.score, t.full_text AS x, instr(lower(t.full_text), 'yacht') AS p FROM s JOIN archive_documents d ON d.id = s.document_id JOIN document_texts t ON t.document_id = d.id
    WHERE NOT {_HIDDEN} AND {TYPE_KEY.format('d.document_type')} = 'email' ORDER BY s.score, d.id LIMIT 20))"""
)
def facade_search(t: Tables):
    return archive(t, POLICY).search('yacht OR "ferry operator"', document_type="email", limit=20)[0].select("id", "title", "document_type", F.round("score", 6).alias("score"), "snippet")


_SEARCHED = f"""WITH g AS (SELECT lower(canonical_name) AS name_key, {KIND.format('entity_type')} AS kind, arg_max(id, (coalesce(mention_count, 0), -id)) AS rep_id, arg_max(canonical_name, (coalesce(mention_count, 0), -id)) AS rep_name, sum(coalesce(mention_count, 0)) AS total
    FROM entities WHERE lower(canonical_name) LIKE '%trust%' OR lower(first_name) LIKE '%trust%' OR lower(last_name) LIKE '%trust%' GROUP BY 1, 2 ORDER BY total DESC, rep_id LIMIT 20),
r AS (SELECT id, lower(canonical_name) AS n, {KIND.format('entity_type')} AS t, row_number() OVER (PARTITION BY lower(canonical_name), {KIND.format('entity_type')} ORDER BY coalesce(mention_count, 0) DESC, id) AS rn FROM entities WHERE canonical_name IS NOT NULL),
m AS (SELECT g.rep_id, m.* FROM mentions m JOIN r ON r.id = m.entity_id AND r.rn <= 20 JOIN g ON g.name_key = r.n AND g.kind = r.t JOIN archive_documents d ON d.id = m.document_id WHERE NOT {_HIDDEN}),
f AS (SELECT rep_id, document_id, arg_min(name_as_appears, id) AS name_as_appears, row_number() OVER (PARTITION BY rep_id ORDER BY document_id) AS rn FROM (SELECT * FROM m WHERE name_as_appears IS NOT NULL) GROUP BY 1, 2)"""


@query(_SEARCHED + " SELECT g.rep_id, g.rep_name, g.kind, (SELECT count(*) FROM m WHERE m.rep_id = g.rep_id) AS total, f.document_id, f.name_as_appears FROM g LEFT JOIN f ON f.rep_id = g.rep_id AND f.rn <= 5")
def facade_search_entities(t: Tables):
    found = archive(t, POLICY).search_entities("trust", limit=20)
    flat = found.select("rep_id", "rep_name", "kind", "total", F.explode_outer("mentions").alias("m"))
    return flat.select("rep_id", "rep_name", "kind", "total", "m.document_id", "m.name_as_appears")


_IMAGES = f"""SELECT filename, document_id FROM (SELECT i.filename, i.bates, coalesce(try_cast(nullif(regexp_extract(i.filename, '([0-9]+)', 1), '') AS BIGINT), b.id) AS document_id FROM (SELECT filename, CASE WHEN id % 2 = 0 THEN bates_number END AS bates FROM archive_documents WHERE filename IS NOT NULL) i
    LEFT JOIN (SELECT upper(bates_number) AS b, min(id) AS id FROM archive_documents GROUP BY 1) b ON b.b = upper(i.bates)) d WHERE (document_id IS NOT NULL OR coalesce(bates, '') <> '') AND (document_id IS NULL OR document_id NOT IN (SELECT d.id FROM archive_documents d WHERE {_HIDDEN})) AND (bates IS NULL OR upper(bates) NOT IN ('ARC-000000016', 'ARC-000000221'))"""


@query(_IMAGES + " ORDER BY filename, document_id NULLS FIRST LIMIT 60 OFFSET 20")
def facade_images(t: Tables):
    # a manifest in which every second image has its Bates number
    manifest = t.archive_documents.filter("filename is not null").select("filename", F.lit(None).cast("bigint").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.col("bates_number")).alias("bates"))
    return archive(t, POLICY).images(manifest, 60, 20)[0].select("filename", "document_id")


@query(f"SELECT d.id, d.filename, coalesce(nullif(d.title, ''), d.filename) AS title, {SET_KEY.format('d.data_set')} AS data_set FROM archive_documents d WHERE NOT {_HIDDEN} AND {TYPE_KEY.format('d.document_type')} = 'video' ORDER BY d.id LIMIT 100")
def facade_videos(t: Tables):
    return archive(t, POLICY).videos()[0]


@query(f"SELECT d.id, d.filename, coalesce(nullif(d.title, ''), d.filename) AS title, coalesce(nullif(regexp_extract(coalesce(d.title, ''), '(Day [0-9]+)', 1), ''), 'Unknown') AS day, nullif(regexp_extract(coalesce(d.title, ''), 'Part\\s*([0-9]+)', 1), '') AS part FROM archive_documents d WHERE NOT {_HIDDEN} AND {TYPE_KEY.format('d.document_type')} = 'audio'")
def facade_recordings(t: Tables):
    return archive(t, POLICY).recordings()


@query(f"SELECT d.id, d.bates_number AS bates, d.title, greatest(coalesce(d.page_count, 1), 1) AS page_count FROM archive_documents d WHERE NOT {_HIDDEN} AND (contains(lower(d.bates_number), '00001') OR contains(lower(d.title), '00001')) ORDER BY d.bates_number, d.id LIMIT 50 OFFSET 10")
def facade_records(t: Tables):
    return archive(t, POLICY).records("00001", 50, 10)[0]


@query(
    f"""WITH v AS (SELECT d.id, d.filename, coalesce(nullif(d.title, ''), d.filename) AS title FROM archive_documents d WHERE NOT {_HIDDEN} AND {SET_KEY.format('d.data_set')} = 'release-01'), p AS (SELECT *, row_number() OVER (ORDER BY filename NULLS FIRST, id) AS position FROM v)
    SELECT position, id, title FROM p WHERE position BETWEEN (SELECT least(2, greatest(ceil(count(*) / 24.0), 1)) FROM v) * 24 - 23 AND (SELECT least(2, greatest(ceil(count(*) / 24.0), 1)) FROM v) * 24"""
)
def facade_collection_page(t: Tables):
    return archive(t, POLICY).collection_page("release-01", 2)[0].select("position", "id", "title")


@query(
    f"""WITH v AS (SELECT d.id, d.filename, {SET_KEY.format('d.data_set')} AS k FROM archive_documents d WHERE NOT {_HIDDEN}), m AS (SELECT * FROM v WHERE id = 12)
    SELECT m.id, (SELECT o.id FROM v o WHERE o.k = m.k AND o.filename IS NOT NULL AND (m.filename IS NOT NULL AND (o.filename < m.filename OR (o.filename = m.filename AND o.id < m.id))) ORDER BY o.filename DESC, o.id DESC LIMIT 1) AS previous,
    (SELECT o.id FROM v o WHERE o.k = m.k AND o.filename IS NOT NULL AND (m.filename IS NULL OR o.filename > m.filename OR (o.filename = m.filename AND o.id > m.id)) ORDER BY o.filename, o.id LIMIT 1) AS next FROM m"""
)
def facade_record_page(t: Tables):
    return archive(t, POLICY).record_page(12).select("id", "previous", "next")


@query("SELECT d.id, d.page_count, d.k AS page, 'ARC-' || lpad(CAST(12 + d.k AS VARCHAR), 9, '0') AS bates, substr(x.full_text, 1, 2000) AS preview FROM (SELECT id, greatest(coalesce(page_count, 1), 1) AS page_count, unnest(range(0, greatest(coalesce(page_count, 1), 1)))::INT AS k FROM archive_documents WHERE bates_number = 'ARC-000000012') d LEFT JOIN document_texts x ON x.document_id = d.id")
def facade_record(t: Tables):
    shown = archive(t, POLICY).record("ARC-000000012")[0]
    return shown.select("id", "page_count", "preview", F.explode("pages").alias("p")).select("id", "page_count", "p.page", "p.bates", "preview")


@query("SELECT id, name_as_appears FROM mentions WHERE entity_id IN (SELECT b.id FROM entities a JOIN entities b ON lower(a.canonical_name) = lower(b.canonical_name) AND (lower(a.entity_type) LIKE 'org%') = (lower(b.entity_type) LIKE 'org%') WHERE a.id = 1) ORDER BY role_confidence DESC NULLS LAST, id LIMIT 100")
def facade_entity_mentions(t: Tables):
    return archive(t).entity_mentions(1).select("id", "name_as_appears")


@query(
    r"""SELECT DISTINCT source_url AS url, regexp_matches(lower(p), '\.(pdf|doc|docx|jpg|jpeg|png|tif|tiff|mp4|mov|mp3|wav|zip|txt|eml|msg)$') AS is_document, CASE WHEN n <> '' THEN 'release-' || lpad(n, 2, '0') END AS release, CASE WHEN length(f) = 0 OR length(f) > 100 THEN md5(source_url) ELSE f END AS filename
    FROM (SELECT source_url, p, regexp_extract(lower(source_url), '(?:release|data[-_ ]?set)[-_ ]?0*([0-9]+)', 1) AS n, regexp_replace(string_split(p, '/')[-1], '[^A-Za-z0-9._-]+', '_', 'g') AS f FROM (SELECT source_url, regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS p FROM archive_documents WHERE source_url IS NOT NULL))"""
)
def url_parts(t: Tables):
    u = F.col("url")
    d = t.archive_documents.filter("source_url is not null").select(F.col("source_url").alias("url")).distinct()
    return d.select("url", U.is_document_url(u).alias("is_document"), U.set_of_url(u).alias("release"), U.safe_filename(u).alias("filename"))


@query(
    """WITH RECURSIVE o AS (SELECT coalesce(data_set, '') AS k, id, coalesce(file_size, 0) AS s, row_number() OVER (PARTITION BY coalesce(data_set, '') ORDER BY id) AS rn FROM archive_documents),
    c AS (SELECT k, id, rn, s AS held, 0 AS chunk FROM o WHERE rn = 1 UNION ALL SELECT o.k, o.id, o.rn, CASE WHEN c.held > 0 AND c.held + o.s > 5000000 THEN o.s ELSE c.held + o.s END, CASE WHEN c.held > 0 AND c.held + o.s > 5000000 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN o ON o.k = c.k AND o.rn = c.rn + 1)
    SELECT k, id, chunk FROM c"""
)
def size_chunks(t: Tables):
    d = t.archive_documents.withColumn("k", F.coalesce("data_set", F.lit(""))).select("k", "id", "file_size")
    return chunked(d, "k", "id", "file_size", 5_000_000)


@query("SELECT count(*) FILTER (WHERE d.id IS NOT NULL) AS resolved, count(*) FILTER (WHERE d.id IS NULL) AS open FROM (SELECT DISTINCT regexp_extract(full_text, 'Bates Begin[^A-Z]*(ARC-[0-9]+)', 1) AS b FROM document_texts WHERE regexp_matches(full_text, 'Bates Begin[^A-Z]*(ARC-[0-9]+)')) r LEFT JOIN archive_documents d ON d.bates_number = r.b")
def reference_resolution(t: Tables):
    r = t.document_texts.select(F.regexp_extract("full_text", r"Bates Begin[^A-Z]*(ARC-[0-9]+)", 1).alias("bates_number")).filter("bates_number <> ''").distinct()
    found, left = resolve_references(r, t.archive_documents)
    n = F.count(F.lit(1))
    return found.agg(n.alias("resolved")).crossJoin(left.agg(n.alias("open")))


@query(
    """WITH p AS (SELECT source_url AS url, max(CASE WHEN needs_ocr THEN 404 ELSE 200 END) AS status, max(CASE WHEN lower(content_type) LIKE 'image%' THEN lower(content_type) ELSE 'text/html' END) AS ct, coalesce(max(title), '') AS title, max(coalesce(page_count, 1)) AS h FROM archive_documents WHERE source_url IS NOT NULL GROUP BY 1)
    SELECT url, 'http-status' AS problem FROM p WHERE status <> 200 UNION ALL SELECT url, 'content-type' FROM p WHERE status = 200 AND ct <> 'text/html' UNION ALL SELECT url, 'missing-title' FROM p WHERE status = 200 AND ct = 'text/html' AND trim(title) = '' UNION ALL SELECT url, 'h1-count' FROM p WHERE status = 200 AND ct = 'text/html' AND h <> 1"""
)
def page_audit(t: Tables):
    d = t.archive_documents.filter("source_url is not null").groupBy(F.col("source_url").alias("url")).agg(
        F.max(F.when(F.col("needs_ocr"), 404).otherwise(200)).alias("status"), F.max(F.when(F.lower("content_type").startswith("image"), F.lower("content_type")).otherwise("text/html")).alias("content_type"),
        F.coalesce(F.max("title"), F.lit("")).alias("title"), F.max(F.coalesce("page_count", F.lit(1))).alias("h"),
    )
    html = F.concat(F.lit("<html><head><title>"), html_escape(F.col("title")), F.lit('</title><link rel="canonical" href="'), html_escape(F.col("url")), F.lit('"></head><body>'), F.repeat(F.lit("<h1>x</h1>"), F.col("h")), F.lit("</body></html>"))
    return findings(d.select("url", "status", "content_type", F.col("url").alias("final_url"), html.alias("html")))


_STEM = r"regexp_replace(regexp_extract({0}, '([^/]*)$', 1), '\.[^.]*$', '')"


@query(
    f"""WITH f AS (SELECT set_dir, path, regexp_extract(path, '([^/]*)$', 1) AS name FROM (SELECT {SET_KEY.format('data_set')} AS set_dir, CASE WHEN id % 3 = 0 THEN 'media/' || filename WHEN id % 3 = 1 THEN 'media/' || {_STEM.format('filename')} || '.mp4' END AS path FROM archive_documents WHERE filename IS NOT NULL) WHERE path IS NOT NULL),
    d AS (SELECT id, {SET_KEY.format('data_set')} AS set_dir, filename AS name, {_STEM.format('filename')} AS stem FROM archive_documents WHERE filename IS NOT NULL)
    SELECT id, coalesce(a, b, c) AS path, CASE WHEN a IS NOT NULL THEN 'set' WHEN b IS NOT NULL THEN 'name' WHEN c IS NOT NULL THEN 'stem' ELSE 'missing' END AS how FROM (SELECT d.id, x.p AS a, y.p AS b, z.p AS c FROM d LEFT JOIN (SELECT set_dir, name, min(path) AS p FROM f GROUP BY 1, 2) x ON x.set_dir = d.set_dir AND x.name = d.name
    LEFT JOIN (SELECT name, min(path) AS p FROM f GROUP BY 1) y ON y.name = d.name LEFT JOIN (SELECT {_STEM.format('name')} AS stem, min(path) AS p FROM f GROUP BY 1) z ON z.stem = d.stem)"""
)
def media_lookup(t: Tables):
    # stored files: some under their names, some as converted media, some not at all
    d = t.archive_documents.filter("filename is not null")
    path = F.when(F.col("id") % 3 == 0, F.concat(F.lit("media/"), "filename")).when(F.col("id") % 3 == 1, F.concat(F.lit("media/"), file_stem(F.col("filename")), F.lit(".mp4")))
    return media_paths(t.archive_documents, d.select(set_key(F.col("data_set")).alias("set_dir"), path.alias("path")).filter("path is not null"))


@query(f"SELECT id, CASE WHEN k = 'release-12' THEN 'Last release' WHEN starts_with(k, 'release-') THEN 'Evidence release' ELSE 'Public release' END AS provenance, CASE WHEN filename <> '' AND filename IS DISTINCT FROM bates_number AND filename IS DISTINCT FROM bates_number || '.pdf' THEN filename WHEN regexp_matches(coalesce(title, ''), '(?i)\\.[a-z0-9]{{2,4}}$') THEN title ELSE '' END AS released FROM (SELECT *, {SET_KEY.format('data_set')} AS k FROM archive_documents)")
def record_provenance(t: Tables):
    k = set_key(F.col("data_set"))
    return t.archive_documents.select("id", provenance(k, {"release-12": "Last release"}).alias("provenance"), released_name(F.col("filename"), F.col("title"), F.col("bates_number")).alias("released"))


@query()
def utf8_parts(t: Tables):
    x = t.document_texts.filter("full_text <> ''")
    return x.select("document_id", F.posexplode(U.utf8_chunks(F.col("full_text"), F.lit(1000))).alias("part", "piece"))


@query("SELECT d.id, coalesce(d.title, '') || ' (' || coalesce(d.data_set, 'unsorted') || ')' || coalesce(': ' || substr(x.full_text, 1, 280), '') AS description FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id")
def record_description(t: Tables):
    x = t.document_texts.select(F.col("document_id").alias("id"), F.substring("full_text", 1, 280).alias("head"))
    d = t.archive_documents.select("id", "title", "data_set").join(x, "id", "left")
    return d.select("id", F.concat(F.coalesce("title", F.lit("")), F.lit(" ("), F.coalesce("data_set", F.lit("unsorted")), F.lit(")"), F.coalesce(F.concat(F.lit(": "), F.col("head")), F.lit(""))).alias("description"))


@query("SELECT filename, nullif(regexp_extract(filename, '([0-9]+)\\.[A-Za-z0-9]+$', 1), '') AS number, count(*) AS n FROM archive_documents WHERE filename IS NOT NULL GROUP BY 1, 2")
def image_filename_ids(t: Tables):
    d = t.archive_documents.filter("filename is not null")
    return d.groupBy("filename", F.nullif(F.regexp_extract("filename", r"([0-9]+)\.[A-Za-z0-9]+$", 1), F.lit("")).alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, CASE lower(regexp_extract(filename, '\\.([A-Za-z0-9]{1,5})$', 1)) WHEN 'avi' THEN 'video/x-msvideo' WHEN 'bmp' THEN 'image/bmp' WHEN 'gif' THEN 'image/gif' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'jpg' THEN 'image/jpeg' WHEN 'mov' THEN 'video/quicktime' WHEN 'mp4' THEN 'video/mp4' WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'wmv' THEN 'video/x-ms-wmv' ELSE CASE WHEN contains(lower(coalesce(document_type, '')), 'mail') THEN 'message/rfc822' ELSE 'application/octet-stream' END END AS media FROM archive_documents")
def native_media_targets(t: Tables):
    from recordspark.functions.records import content_type_of

    return t.archive_documents.select("id", content_type_of(F.col("filename"), F.col("document_type")).alias("media"))
