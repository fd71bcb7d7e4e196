"""Queries of audits and text quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import quality as Q
from recordspark.functions import records as R
from recordspark.operators import audit, fts
from recordspark.plans.registry import Tables, query

_TARGETS = "SELECT bates_number AS key, 'document' AS kind, file_size AS expected_size, content_type AS expected_type FROM archive_documents WHERE bates_number IS NOT NULL"
_HELD = "SELECT bates_number AS key, CASE WHEN id % 17 = 0 THEN 0 WHEN id % 13 = 0 THEN file_size + 1 ELSE file_size END AS size, CASE WHEN id % 11 = 0 THEN 'text/plain' ELSE content_type END AS content_type FROM archive_documents WHERE id % 7 <> 0 AND bates_number IS NOT NULL"
_MEDIA = "CASE lower(trim(split_part({0}, ';', 1))) WHEN 'image/jpg' THEN 'image/jpeg' WHEN 'audio/x-wav' THEN 'audio/wav' WHEN 'audio/wave' THEN 'audio/wav' WHEN 'audio/vnd.wave' THEN 'audio/wav' ELSE nullif(lower(trim(split_part({0}, ';', 1))), '') END"
_FINDINGS = f"SELECT key, kind, problem FROM (SELECT t.key, t.kind, CASE WHEN h.key IS NULL THEN 'missing' WHEN h.size = 0 THEN 'zero-byte' WHEN coalesce(t.expected_size, 0) <> 0 AND h.size <> t.expected_size THEN 'size-mismatch' WHEN {_MEDIA.format('t.expected_type')} <> {_MEDIA.format('h.content_type')} THEN 'type-mismatch' END AS problem FROM ({_TARGETS}) t LEFT JOIN ({_HELD}) h ON h.key = t.key) WHERE problem IS NOT NULL"


def _targets(t: Tables):
    return t.archive_documents.filter("bates_number is not null").select(F.col("bates_number").alias("key"), F.lit("document").alias("kind"), F.col("file_size").alias("expected_size"), F.col("content_type").alias("expected_type"))


def _held(t: Tables):
    d = t.archive_documents.filter("id % 7 <> 0 and bates_number is not null")
    size = F.when(F.col("id") % 17 == 0, 0).when(F.col("id") % 13 == 0, F.col("file_size") + 1).otherwise(F.col("file_size"))
    return d.select(F.col("bates_number").alias("key"), size.alias("size"), F.when(F.col("id") % 11 == 0, "text/plain").otherwise(F.col("content_type")).alias("content_type"))


@query(_FINDINGS)
def storage_audit(t: Tables):
    return audit.compare_targets(_targets(t), _held(t))


@query(f"SELECT problem, count(*) AS n FROM ({_FINDINGS}) GROUP BY 1")
def problem_summary(t: Tables):
    return audit.compare_targets(_targets(t), _held(t)).groupBy("problem").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT h.key FROM ({_HELD}) h WHERE h.key NOT IN (SELECT bates_number FROM archive_documents WHERE bates_number IS NOT NULL AND page_count IS NOT NULL)")
def audit_unreferenced(t: Tables):
    targets = t.archive_documents.filter("bates_number is not null and page_count is not null").select(F.col("bates_number").alias("key"))
    return audit.unreferenced(targets, _held(t)).select("key")


@query(
    f"""WITH u AS (SELECT *, 0 AS p FROM ({_TARGETS}) UNION ALL SELECT key, 'copy', size, content_type, 1 FROM ({_HELD})) SELECT key, arg_min(kind, p) AS kind, count(DISTINCT (coalesce(expected_size, -1), coalesce(expected_type, ''))) > 1 AS conflict FROM u GROUP BY 1"""
)
def audit_conflicts(t: Tables):
    other = _held(t).select("key", F.lit("copy").alias("kind"), F.col("size").alias("expected_size"), F.col("content_type").alias("expected_type"))
    return audit.union_targets(_targets(t), other).select("key", "kind", "conflict")


@query("SELECT file_hash AS key, count(*) AS n FROM archive_documents WHERE file_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(t: Tables):
    return audit.duplicate_keys(t.archive_documents.filter("file_hash is not null").select(F.col("file_hash").alias("key")))


@query(
    """WITH t AS (SELECT DISTINCT document_id FROM document_texts WHERE trim(full_text) <> ''), i AS (SELECT DISTINCT document_id FROM document_texts WHERE trim(full_text) <> '' AND document_id % 19 <> 0 UNION SELECT -1)
    SELECT (SELECT count(*) FROM t) AS text_rows, (SELECT count(*) FROM i) AS index_rows, (SELECT count(*) FROM t WHERE document_id NOT IN (SELECT document_id FROM i)) AS missing, (SELECT count(*) FROM i WHERE document_id NOT IN (SELECT document_id FROM t)) AS orphans, false AS ok"""
)
def index_consistency(t: Tables):
    indexed = t.document_texts.filter("trim(full_text) <> '' and document_id % 19 <> 0").select("document_id").unionAll(t.spark.range(1).select(F.lit(-1).cast("bigint")))
    return fts.index_consistency(t.document_texts.select("document_id", "full_text"), indexed)


_BAND = "CASE WHEN c >= 0.0 AND c < 0.5 THEN 'under-0.50' WHEN c >= 0.5 AND c < 0.7 THEN '0.50-0.69' WHEN c >= 0.7 AND c < 0.9 THEN '0.70-0.89' WHEN c >= 0.9 AND c < 1.000001 THEN '0.90-plus' END"


@query(
    f"""WITH s AS (SELECT {_BAND} AS band, levenshtein(a, b) AS e, length(a) AS n FROM (SELECT x.average_confidence AS c, lower(d.title) AS a, lower(d.filename) AS b FROM document_texts x JOIN archive_documents d ON d.id = x.document_id WHERE d.title IS NOT NULL AND d.filename IS NOT NULL AND NOT regexp_matches(d.title || d.filename, '[^ -~]')))
    SELECT b.band, count(s.e) AS pages, coalesce(sum(s.e), 0)::BIGINT AS edits, coalesce(sum(s.n), 0)::BIGINT AS chars, round(coalesce(sum(s.e), 0) / greatest(coalesce(sum(s.n), 0), 1), 6) AS cer FROM (VALUES ('under-0.50'), ('0.50-0.69'), ('0.70-0.89'), ('0.90-plus')) b(band) LEFT JOIN s ON s.band = b.band GROUP BY 1"""
)
def cer_by_band(t: Tables):
    d = t.archive_documents.filter("title is not null and filename is not null").filter(~F.concat("title", "filename").rlike("[^ -~]")).select(F.col("id").alias("document_id"), F.lower("title").alias("a"), F.lower("filename").alias("b"))
    x = t.document_texts.select("document_id", audit.band(F.col("average_confidence")).alias("band")).join(d, "document_id")
    return audit.accuracy_by_band(x.select("band", F.length("a").cast("bigint").alias("ref_chars"), F.levenshtein("a", "b").cast("bigint").alias("char_edits")))


@query(f"SELECT coalesce({_BAND.replace('c ', 'average_confidence ')}, 'none') AS band, count(*) AS n, round(avg(average_confidence), 6) AS mean FROM document_texts GROUP BY 1")
def confidence_bands(t: Tables):
    b = F.coalesce(audit.band(F.col("average_confidence")), F.lit("none"))
    return t.document_texts.groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("average_confidence"), 6).alias("mean"))


@query("SELECT coalesce(sum(page_count), 0) AS pages, round(avg(page_count), 6) AS mean, max(page_count) AS most, count(*) FILTER (WHERE page_count = 1) AS single FROM archive_documents")
def page_stats(t: Tables):
    return t.archive_documents.agg(F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"), F.round(F.avg("page_count"), 6).alias("mean"), F.max("page_count").alias("most"), F.count_if(F.expr("page_count = 1")).alias("single"))


@query("SELECT lower(action) AS action, round(sum(least(greatest(exp(-duration_ms / 1000.0), 0), 1) * greatest(duration_ms / 1000.0, 0.01)) / sum(greatest(duration_ms / 1000.0, 0.01)), 6) AS weighted FROM (SELECT DISTINCT * FROM processing_logs) WHERE duration_ms IS NOT NULL GROUP BY 1")
def weighted_confidence(t: Tables):
    s = F.col("duration_ms") / 1000.0
    d = F.greatest(s, F.lit(0.01))
    return t.processing_logs.distinct().filter("duration_ms is not null").groupBy(F.lower("action").alias("action")).agg(F.round(F.sum(Q.clamp_probability(-s) * d) / F.sum(d), 6).alias("weighted"))


@query(
    """WITH w AS (SELECT x.document_id, l, CAST(len(list_filter(regexp_split_to_array(l, ' +'), lambda z: z <> '')) AS BIGINT) AS n FROM (SELECT document_id, unnest(string_split(full_text, chr(10))) AS l FROM document_texts WHERE trim(full_text) <> '') x)
    SELECT document_id, round(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / greatest(sum(n), 1), 6) AS dense FROM w GROUP BY 1"""
)
def dense_text_ratio(t: Tables):
    x = t.document_texts.filter("trim(full_text) <> ''").select("document_id", F.explode(F.split("full_text", "\n")).alias("l"))
    n = F.size(F.filter(F.split("l", " +"), lambda z: z != "")).cast("bigint")
    w = x.select("document_id", n.alias("n"))
    return w.groupBy("document_id").agg(F.round(F.sum(F.when(F.col("n") >= 3, F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("dense"))


@query("SELECT id, CASE WHEN i > 0 THEN 'improper' WHEN r > 0.5 * p THEN 'heavy' WHEN r > 0 THEN 'clean' ELSE 'none' END AS status FROM (SELECT id, CASE WHEN id % 23 = 0 THEN 1 ELSE 0 END AS i, id % 9 AS r, coalesce(page_count, 1) AS p FROM archive_documents)")
def redaction_status(t: Tables):
    d = t.archive_documents.select("id", F.when(F.col("id") % 23 == 0, 1).otherwise(0).alias("i"), (F.col("id") % 9).alias("r"), F.coalesce("page_count", F.lit(1)).alias("p"))
    return d.select("id", Q.redaction_status(F.col("i"), F.col("r"), F.col("p")).alias("status"))


@query("SELECT id, NOT (10 + id % 50 < 20 OR 40 < 10 + id % 7 OR 30 < 5 OR 25 < 3) AS touches FROM archive_documents")
def rectangles_overlap(t: Tables):
    i = F.col("id")
    return t.archive_documents.select("id", Q.overlap(10 + i % 7, F.lit(3), 10 + i % 50, F.lit(30), F.lit(20), F.lit(5), F.lit(40), F.lit(25)).alias("touches"))


@query("SELECT document_id, arg_max(ocr_engine, (average_confidence >= 0.5, word_count, -id)) AS engine FROM document_texts WHERE ocr_engine IS NOT NULL AND average_confidence IS NOT NULL AND word_count IS NOT NULL GROUP BY 1")
def ocr_candidate_choice(t: Tables):
    x = t.document_texts.filter("ocr_engine is not null and average_confidence is not null and word_count is not null")
    return x.groupBy("document_id").agg(F.max(F.struct((F.col("average_confidence") >= 0.5).alias("a"), F.col("word_count").alias("b"), (-F.col("id")).alias("c"), F.col("ocr_engine").alias("engine")))["engine"].alias("engine"))


@query(
    """WITH p AS (SELECT document_id, list_transform(range(1, len(pages_text) + 1), lambda k: {'n': coalesce(pages_text[k], ''), 'o': coalesce(pages_text[k], '') || CASE WHEN length(trim(coalesce(pages_text[k], ''))) % 3 = 0 THEN '' ELSE ' seen again: ' || coalesce(pages_text[k], '') END}) AS z, coalesce(average_confidence, 0) AS c FROM document_texts WHERE len(pages_text) > 0),
    t AS (SELECT document_id, c, list_transform(z, lambda p: {'t': length(trim(p.n)) < 50 AND length(trim(p.o)) > 0 AND (length(trim(p.n)) = 0 OR length(trim(p.o)) > length(trim(p.n)) * 1.25), 'n': p.n, 'o': p.o}) AS z FROM p),
    f AS (SELECT document_id, c, z, list_filter(z, lambda p: length(trim(CASE WHEN p.t THEN p.o ELSE p.n END)) > 0) AS f FROM t)
    SELECT document_id, length(array_to_string(list_transform(z, lambda p: CASE WHEN p.t THEN p.o ELSE p.n END), '|')) AS chars, round(CASE WHEN len(f) > 0 THEN list_sum(list_transform(f, lambda p: CASE WHEN p.t THEN c ELSE 1.0::DOUBLE END)) / len(f) ELSE 0 END, 6) AS confidence,
    CASE WHEN len(list_filter(z, lambda p: p.t)) > 0 THEN CASE WHEN len(list_filter(z, lambda p: length(trim(p.n)) >= 50)) > 0 THEN 'hybrid' ELSE 'ocr' END ELSE 'native' END AS method FROM f"""
)
def hybrid_pages(t: Tables):
    # a second reading of each page, that adds to some of them
    ocr = F.transform("pages_text", lambda p: F.concat(F.coalesce(p, F.lit("")), F.when(F.length(F.trim(F.coalesce(p, F.lit("")))) % 3 == 0, "").otherwise(F.concat(F.lit(" seen again: "), F.coalesce(p, F.lit(""))))))
    x = t.document_texts.filter("size(pages_text) > 0").select("document_id", "pages_text", ocr.alias("ocr"), F.transform("pages_text", lambda p: F.coalesce("average_confidence", F.lit(0.0))).alias("c"))
    h = x.select("document_id", Q.hybrid_pages(F.col("pages_text"), F.col("ocr"), F.col("c")).alias("h"))
    return h.select("document_id", F.length(F.array_join("h.pages", "|")).cast("bigint").alias("chars"), F.round("h.confidence", 6).alias("confidence"), "h.method")


@query("WITH l AS (SELECT document_id, page_number, lower(role) AS role, count(*) AS n, sum(round(extraction_confidence * 100)) AS s FROM mentions WHERE trim(coalesce(name_as_appears, '')) <> '' AND extraction_confidence >= 0 GROUP BY 1, 2, 3) SELECT document_id, round(sum(s) / sum(n) / 100, 6) AS confidence, round(sum(CASE WHEN n >= 3 THEN n ELSE 0 END) / sum(n), 6) AS dense FROM l GROUP BY 1")
def word_figures(t: Tables):
    # mentions read as recognised words, their page and role as block and line
    w = t.mentions.select("document_id", "page_number", F.lower("role").alias("role"), F.col("name_as_appears").alias("text"), F.round(F.col("extraction_confidence") * 100).alias("conf"))
    return Q.word_figures(w, ["document_id"], ["page_number", "role"]).select("document_id", F.round("confidence", 6).alias("confidence"), F.round("dense", 6).alias("dense"))


@query("SELECT id, w > 10 AND w < 612 * 0.95 AND h > 5 AND h < greatest(100.0, 792 * 0.15) AS sized, g <= 0.1 AS dark FROM (SELECT id, position_end - position_start AS w, coalesce(page_number, 1) * 9 AS h, 1 - extraction_confidence AS g FROM mentions WHERE position_start IS NOT NULL AND position_end IS NOT NULL AND extraction_confidence IS NOT NULL)")
def redaction_rectangles(t: Tables):
    m = t.mentions.filter("position_start is not null and position_end is not null and extraction_confidence is not null")
    g = 1 - F.col("extraction_confidence")
    return m.select("id", Q.redaction_sized(F.col("position_end") - F.col("position_start"), F.coalesce("page_number", F.lit(1)) * 9, F.lit(612), F.lit(792)).alias("sized"), Q.dark_fill(F.array(g, F.lit(0.0).cast("double"), g)).alias("dark"))


@query("SELECT document_id, CASE WHEN o > 1.25 * n THEN 'ocr' WHEN n > 0 THEN 'native' ELSE 'none' END AS method FROM (SELECT document_id, length(coalesce(full_text, '')) AS n, coalesce(length(array_to_string(pages_text, ' ')), 0) AS o FROM document_texts)")
def hybrid_page_choice(t: Tables):
    n, o = F.length(F.coalesce("full_text", F.lit(""))), F.coalesce(F.length(F.array_join("pages_text", " ")), F.lit(0))
    return t.document_texts.select("document_id", F.when(o > 1.25 * n, "ocr").when(n > 0, "native").otherwise("none").alias("method"))


@query("SELECT document_id, (average_confidence >= 0.5 AND average_confidence > coalesce(ocr_confidence, 0)) AS better FROM document_texts x JOIN archive_documents d ON d.id = x.document_id WHERE average_confidence IS NOT NULL")
def improvement_gate(t: Tables):
    d = t.archive_documents.select(F.col("id").alias("document_id"), "ocr_confidence")
    return t.document_texts.filter("average_confidence is not null").select("document_id", "average_confidence").join(d, "document_id").select("document_id", Q.better(F.col("average_confidence"), F.col("ocr_confidence")).alias("better"))


@query("SELECT document_id, CASE WHEN full_text IS NULL THEN 'failed' WHEN trim(full_text) <> '' THEN 'done' ELSE 'empty' END AS outcome, round(average_confidence, 4) AS confidence FROM document_texts")
def ocr_outcome(t: Tables):
    out = F.when(F.col("full_text").isNull(), "failed").when(F.trim("full_text") != "", "done").otherwise("empty")
    return t.document_texts.select("document_id", out.alias("outcome"), F.round("average_confidence", 4).alias("confidence"))


@query("SELECT d.id, CASE WHEN x.document_id IS NULL THEN 'no text' WHEN d.ocr_confidence IS NULL THEN 'text' ELSE 'text, ' || CAST(round(d.ocr_confidence * 100) AS INT) || ' % sure' END AS label FROM archive_documents d LEFT JOIN (SELECT DISTINCT document_id FROM document_texts WHERE trim(full_text) <> '') x ON x.document_id = d.id")
def text_status_labels(t: Tables):
    x = t.document_texts.filter("trim(full_text) <> ''").select(F.col("document_id").alias("id"), F.lit(True).alias("t")).distinct()
    d = t.archive_documents.select("id", "ocr_confidence").join(x, "id", "left")
    return d.select("id", R.confidence_label(F.col("ocr_confidence"), F.col("t").isNotNull()).alias("label"))


@query("SELECT lower(action) AS action, round(sum(duration_ms) / 3600000, 2) AS hours, count(*) FILTER (WHERE duration_ms > 0) AS timed, count(*) FILTER (WHERE coalesce(duration_ms, 0) = 0) AS untimed FROM (SELECT DISTINCT * FROM processing_logs) GROUP BY 1")
def media_hours(t: Tables):
    return t.processing_logs.distinct().groupBy(F.lower("action").alias("action")).agg(F.round(F.sum("duration_ms") / 3600000, 2).alias("hours"), F.count_if(F.expr("duration_ms > 0")).alias("timed"), F.count_if(F.expr("coalesce(duration_ms, 0) = 0")).alias("untimed"))


@query(
    r"""SELECT DISTINCT source_url AS url, lower(regexp_extract(source_url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || lower(regexp_extract(source_url, '^[^:]+://([^/?#]*)', 1)) || coalesce(nullif(regexp_extract(source_url, '^[^:]+://[^/?#]*([^?#]*)', 1), ''), '/') || regexp_extract(source_url, '(\?[^#]*)', 1) AS canonical FROM archive_documents WHERE source_url IS NOT NULL"""
)
def canonical_urls(t: Tables):
    return t.archive_documents.filter("source_url is not null").select(F.col("source_url").alias("url")).distinct().withColumn("canonical", R.canonical_url(F.col("url")))


@query("SELECT document_id, CASE WHEN page_number IS NULL THEN 'no page' WHEN t.document_id IS NULL THEN 'no text' WHEN page_number < 1 OR page_number > len(t.pages_text) THEN 'page out of range' ELSE 'scored' END AS reason, count(*) AS n FROM (SELECT m.document_id, m.page_number FROM mentions m) m LEFT JOIN (SELECT document_id, pages_text FROM document_texts WHERE pages_text IS NOT NULL) t USING (document_id) GROUP BY 1, 2".replace("t.document_id IS NULL", "t.pages_text IS NULL"))
def manifest_skip_reasons(t: Tables):
    x = t.document_texts.filter("pages_text is not null").select("document_id", F.size("pages_text").alias("pages"))
    m = t.mentions.select("document_id", "page_number").join(x, "document_id", "left")
    why = F.when(F.col("page_number").isNull(), "no page").when(F.col("pages").isNull(), "no text").when((F.col("page_number") < 1) | (F.col("page_number") > F.col("pages")), "page out of range").otherwise("scored")
    return m.groupBy("document_id", why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))
