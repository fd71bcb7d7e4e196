"""Queries over logs and incremental state, load files, windows and sets."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.functions import records as R
from recordspark.operators import state
from recordspark.plans.browsing import SET_KEY
from recordspark.plans.registry import Tables, query
from recordspark.sources.loadfile import opt_groups, typed_fields

_LOG_ORDER = "created_at DESC NULLS LAST, id DESC, status DESC NULLS LAST, duration_ms DESC NULLS LAST"


def _latest(t: Tables):
    logs = t.processing_logs.select("id", "document_id", F.lower("action").alias("action"), F.lower("status").alias("status"), "created_at", "duration_ms")
    return state.latest(logs, ["document_id", "action"], F.desc("created_at"), F.desc("id"), F.desc("status"), F.desc("duration_ms"))


_LATEST = f"SELECT document_id, action, status, id FROM (SELECT document_id, lower(action) AS action, lower(status) AS status, id, row_number() OVER (PARTITION BY document_id, lower(action) ORDER BY created_at DESC NULLS LAST, id DESC, lower(status) DESC NULLS LAST, duration_ms DESC NULLS LAST) AS rn FROM processing_logs) WHERE rn = 1"


@query(_LATEST)
def latest_status_per_doc(t: Tables):
    return _latest(t).select("document_id", "action", "status", "id")


@query(
    f"""WITH l AS ({_LATEST}) SELECT action, count(*) FILTER (WHERE status IN ('success', 'completed')) AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status NOT IN ('success', 'completed', 'failed') OR status IS NULL) AS other,
    round(100.0 * count(*) FILTER (WHERE status IN ('success', 'completed')) / count(*), 4) AS percent FROM l GROUP BY 1"""
)
def processing_stats(t: Tables):
    done = F.count_if(F.col("status").isin("success", "completed"))
    return _latest(t).groupBy("action").agg(
        done.alias("completed"), F.count_if(F.expr("status = 'failed'")).alias("failed"), F.count_if(F.expr("status not in ('success', 'completed', 'failed') or status is null")).alias("other"), F.round(100.0 * done / F.count(F.lit(1)), 4).alias("percent")
    )


@query("SELECT lower(status) AS status, count(DISTINCT id) AS n, sum(coalesce(duration_ms, 0)) AS ms FROM (SELECT DISTINCT * FROM processing_logs) GROUP BY 1")
def log_status_counts(t: Tables):
    return t.processing_logs.distinct().groupBy(F.lower("status").alias("status")).agg(F.count_distinct("id").alias("n"), F.sum(F.coalesce("duration_ms", F.lit(0))).alias("ms"))


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY lower(action) ORDER BY created_at DESC NULLS LAST, id DESC) AS rn FROM (SELECT DISTINCT id, action, created_at FROM processing_logs)) WHERE rn > 8")
def retention_keep_n(t: Tables):
    logs = t.processing_logs.select("id", "action", "created_at").distinct().withColumn("k", F.lower("action"))
    return state.keep_newest(logs, ["k"], 8, "created_at", "id").select("id")


@query("SELECT d.id FROM archive_documents d WHERE d.file_hash IS NOT NULL AND d.id > 300 AND d.file_hash NOT IN (SELECT file_hash FROM archive_documents WHERE id <= 300 AND file_hash IS NOT NULL)")
def insert_if_absent(t: Tables):
    d = t.archive_documents.filter("file_hash is not null").select("id", "file_hash")
    return state.insert_if_absent(d.filter("id > 300"), d.filter("id <= 300"), ["file_hash"]).select("id")


_RUNS = "SELECT document_id, max(CASE WHEN lower(status) = 'failed' THEN 'failed' ELSE 'success' END) AS status FROM processing_logs GROUP BY 1"


@query(f"SELECT coalesce(h.document_id, r.document_id) AS document_id, CASE WHEN r.status = 'success' THEN r.new_text ELSE h.full_text END AS full_text FROM (SELECT document_id, full_text FROM document_texts WHERE full_text IS NOT NULL) h FULL JOIN (SELECT document_id, status, CASE WHEN document_id % 2 = 0 THEN 'rerun ' || document_id ELSE '' END AS new_text FROM ({_RUNS})) r ON r.document_id = h.document_id WHERE NOT (coalesce(r.status = 'success', false) AND trim(coalesce(r.new_text, '')) = '') AND (CASE WHEN r.status = 'success' THEN r.new_text ELSE h.full_text END) IS NOT NULL")
def upsert_delete_empty(t: Tables):
    runs = t.processing_logs.groupBy("document_id").agg(F.max(F.when(F.lower("status") == "failed", "failed").otherwise("success")).alias("status"))
    runs = runs.withColumn("full_text", F.when(F.col("document_id") % 2 == 0, F.concat(F.lit("rerun "), F.col("document_id").cast("string"))).otherwise(""))
    return state.upsert_texts(t.document_texts.filter("full_text is not null").select("document_id", "full_text"), runs)


@query("SELECT d.id FROM archive_documents d WHERE d.needs_ocr AND NOT EXISTS (SELECT 1 FROM processing_logs l WHERE l.document_id = d.id AND lower(l.status) IN ('success', 'completed'))")
def worklist_difference(t: Tables):
    done = t.processing_logs.filter("lower(status) in ('success', 'completed')").select(F.col("document_id").alias("id"))
    return state.worklist(t.archive_documents.filter("needs_ocr").select("id"), done, "id")


@query("SELECT id, file_size FROM archive_documents WHERE lower(processing_status) = 'pending' ORDER BY file_size NULLS FIRST, id LIMIT 10")
def claim_next(t: Tables):
    return state.claim(t.archive_documents.filter("lower(processing_status) = 'pending'").select("id", "file_size"), 10, F.asc_nulls_first("file_size"), F.col("id"))


@query("SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY file_hash ORDER BY id) AS rn FROM archive_documents WHERE file_hash IS NOT NULL) WHERE rn = 1")
def keep_first_dedup(t: Tables):
    return state.latest(t.archive_documents.filter("file_hash is not null").select("id", "file_hash"), ["file_hash"], F.col("id")).select("id")


@query(
    """WITH p AS (SELECT DISTINCT document_id, page_number FROM mentions WHERE page_number IS NOT NULL), i AS (SELECT *, page_number - row_number() OVER (PARTITION BY document_id ORDER BY page_number) AS g FROM p),
    b AS (SELECT *, (row_number() OVER (PARTITION BY document_id, g ORDER BY page_number) - 1) // 10 AS n FROM i) SELECT document_id, min(page_number) AS first, max(page_number) AS last, count(*) AS pages FROM b GROUP BY document_id, g, n"""
)
def contiguous_batches(t: Tables):
    return state.batches(t.mentions.filter("page_number is not null"), "document_id", "page_number", 10)


@query(f"SELECT id, CAST((r - s) // 5000000 AS INT) AS pack FROM (SELECT id, coalesce(file_size, 0) AS s, sum(coalesce(file_size, 0)) OVER (PARTITION BY {SET_KEY.format('data_set')} ORDER BY id ROWS UNBOUNDED PRECEDING) AS r FROM archive_documents)")
def size_packs(t: Tables):
    d = t.archive_documents.select("id", R.set_key(F.col("data_set")).alias("k"), "file_size")
    return state.packs(d, "k", "id", F.coalesce("file_size", F.lit(0)), 5_000_000).select("id", "pack")


@query("SELECT p.document_id AS grp, count(*) AS pages, min(p.document_id || ':' || p.k) AS first_page FROM (SELECT document_id, unnest(range(1, len(pages_text) + 1)) AS k FROM document_texts WHERE len(pages_text) > 0) p GROUP BY 1")
def opt_page_groups(t: Tables):
    rows = t.document_texts.filter("size(pages_text) > 0").select("document_id", F.posexplode("pages_text").alias("k", "page"))
    rows = rows.select(F.col("document_id").cast("string").alias("volume"), (F.col("document_id") * 1000 + F.col("k")).alias("line_no"), F.when(F.col("k") == 0, "Y").alias("brk"), F.concat_ws(":", "document_id", F.col("k") + 1).alias("path"), "document_id")
    g = opt_groups(rows, extra=[F.min("document_id").alias("grp")])
    return g.select("grp", F.size("pages").cast("bigint").alias("pages"), F.array_min("pages").alias("first_page"))


_FIELD = r"regexp_extract(full_text, '(?:^|\n){0}: ([^\n]*)', 1)"


@query(
    "SELECT document_id, nullif(%s, '') AS bates_begin, nullif(%s, '') AS custodian, CASE WHEN regexp_matches(%s, '^[0-9]+$') THEN CAST(%s AS INT) END AS pages, coalesce(nullif(%s, ''), nullif(%s, ''), nullif(%s, '')) AS title FROM document_texts WHERE starts_with(full_text, 'Bates Begin: ')"
    % (_FIELD.format("Bates Begin"), _FIELD.format("Custodian"), _FIELD.format("Pages"), _FIELD.format("Pages").replace("regexp_extract", "regexp_extract").join(["nullif(", ", '')"]), _FIELD.format("Document Title"), _FIELD.format("Original Filename"), _FIELD.format("Bates Begin"))
)
def loadfile_fields(t: Tables):
    x = t.document_texts.filter(F.col("full_text").startswith("Bates Begin: "))
    fields = F.transform(F.split("full_text", "\n"), lambda line: F.struct(F.substring_index(line, ": ", 1).alias("k"), F.expr("1").cast("string").alias("_"), line.alias("line")))
    pairs = F.map_from_entries(F.transform(F.array_distinct(F.transform(fields, lambda f: f["k"])), lambda k: F.struct(k, F.get(F.filter(fields, lambda f: f["k"] == k), F.lit(0))["line"])))
    value = lambda n: F.nullif(F.regexp_replace(F.element_at("f", F.lit(n)), f"^{n}: ", ""), F.lit(""))
    raw = x.withColumn("f", pairs).select("document_id", value("Bates Begin").alias("bates_begin"), value("Custodian").alias("custodian"), value("Pages").alias("pages"), value("Document Title").alias("document_title"), value("Original Filename").alias("original_filename"))
    return typed_fields(raw).select("document_id", "bates_begin", "custodian", "pages", F.coalesce("title", "original_filename", "bates_begin").alias("title"))


@query("SELECT id, CASE WHEN nullif(local_path, '') IS NOT NULL THEN 'native' WHEN page_count > 0 THEN 'pages' ELSE 'error' END AS route, coalesce(nullif(page_count, 0), 1) AS pages, coalesce(nullif(title, ''), nullif(filename, ''), bates_number) AS title FROM archive_documents")
def loadfile_route(t: Tables):
    path = F.nullif(F.col("local_path"), F.lit(""))
    route = F.when(path.isNotNull(), "native").when(F.col("page_count") > 0, "pages").otherwise("error")
    return t.archive_documents.select("id", route.alias("route"), F.coalesce(F.nullif("page_count", F.lit(0)), F.lit(1)).alias("pages"), F.coalesce(F.nullif("title", F.lit("")), F.nullif("filename", F.lit("")), "bates_number").alias("title"))


@query("SELECT count(*) FILTER (WHERE x.document_id IS NOT NULL) AS matched, count(*) FILTER (WHERE x.document_id IS NULL) AS unmatched, count(*) FILTER (WHERE x.pages <> d.page_count) AS changed FROM archive_documents d LEFT JOIN (SELECT document_id, len(pages_text) AS pages FROM document_texts WHERE pages_text IS NOT NULL) x ON x.document_id = d.id")
def page_count_update(t: Tables):
    x = t.document_texts.filter("pages_text is not null").select(F.col("document_id").alias("id"), F.size("pages_text").alias("pages"))
    j = t.archive_documents.select("id", "page_count").join(x, "id", "left")
    return j.agg(F.count("pages").alias("matched"), F.count_if(F.expr("pages is null")).alias("unmatched"), F.count_if(F.expr("pages <> page_count")).alias("changed"))


@query(r"SELECT id, regexp_replace(replace(local_path, chr(92), '/'), '^[./]+', '') AS path FROM archive_documents WHERE local_path IS NOT NULL")
def windows_paths(t: Tables):
    return t.archive_documents.filter("local_path is not null").select("id", R.slash_path(F.col("local_path")).alias("path"))


@query(
    "SELECT d.id, k AS page, n + k AS number, CAST(floor((n + k - 1) / 2000) AS BIGINT) + 1 AS folder FROM (SELECT id, CAST(regexp_extract(bates_number, '([0-9]+)$', 1) AS BIGINT) AS n, unnest(range(0, greatest(coalesce(page_count, 1), 1)))::INT AS k FROM archive_documents WHERE regexp_matches(bates_number, '[0-9]+$')) d WHERE CAST(floor((n + k - 1) / 2000) AS BIGINT) + 1 >= 1"
)
def bates_pages(t: Tables):
    d = t.archive_documents.filter(F.col("bates_number").rlike(r"[0-9]+$")).select("id", F.inline(R.bates_pages(F.col("bates_number"), F.col("page_count"))))
    return d.select("id", "page", "number", "folder")


@query(r"SELECT id, nullif(regexp_replace(regexp_extract(replace(local_path, chr(92), '/'), '(?i)^.*archive/(.*)$', 1), '^/+', ''), '') AS key FROM archive_documents")
def object_keys(t: Tables):
    return t.archive_documents.select("id", R.object_key(F.col("local_path"), "archive").alias("key"))


@query("SELECT content_type AS raw, CASE lower(trim(split_part(content_type, ';', 1))) WHEN 'audio/vnd.wave' THEN 'audio/wav' WHEN 'audio/wave' THEN 'audio/wav' WHEN 'audio/x-wav' THEN 'audio/wav' WHEN 'image/jpg' THEN 'image/jpeg' ELSE nullif(lower(trim(split_part(content_type, ';', 1))), '') END AS media, count(*) AS n FROM archive_documents GROUP BY 1, 2")
def media_types(t: Tables):
    return t.archive_documents.groupBy(F.col("content_type").alias("raw"), R.media_type(F.col("content_type")).alias("media")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, substr(strftime(created_at, '%Y-%m-%d'), 1, 10) AS day, year(created_at) AS y, month(created_at) AS m FROM archive_documents WHERE created_at IS NOT NULL")
def date_parts(t: Tables):
    return t.archive_documents.filter("created_at is not null").select("id", R.date_prefix(F.col("created_at")).alias("day"), F.year("created_at").cast("bigint").alias("y"), F.month("created_at").cast("bigint").alias("m"))


@query(r"SELECT id, nullif(regexp_extract(coalesce(title, ''), '(?i)(?:part|item|no\.?)\s*([0-9]+)', 1), '') AS part FROM archive_documents")
def title_parts(t: Tables):
    return t.archive_documents.select("id", F.nullif(F.regexp_extract(F.coalesce("title", F.lit("")), r"(?i)(?:part|item|no\.?)\s*([0-9]+)", 1), F.lit("")).alias("part"))


@query("SELECT key, minute, n FROM (SELECT user_id AS key, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY 1, 2) WHERE n > 1")
def rate_limit_windows(t: Tables):
    from recordspark.streaming.windows import over_limit

    return over_limit(t.events, "ts", "user_id", 1)


@query()
def stratified_sample(t: Tables):
    from recordspark.operators.audit import band

    d = t.document_texts.withColumn("band", band(F.col("average_confidence"))).filter("band is not null")
    w = W.partitionBy("band").orderBy(F.xxhash64("document_id", F.lit(11)))
    return d.withColumn("rn", F.row_number().over(w)).filter("rn <= 5").select("document_id", "band", (F.pmod(F.xxhash64("document_id", F.lit(12)), F.greatest(F.size(F.coalesce("pages_text", F.array().cast("array<string>"))), F.lit(1))) + 1).cast("int").alias("page"))


@query("SELECT x.document_id + 100 AS target_id, x.word_count FROM document_texts x JOIN archive_documents d ON d.id = x.document_id JOIN archive_documents p ON p.id = x.document_id + 100 WHERE d.filename IS NOT NULL AND trim(x.full_text) <> ''")
def transcript_export(t: Tables):
    x = t.document_texts.filter("trim(full_text) <> ''").select(F.col("document_id").alias("id"), "word_count")
    d = t.archive_documents.filter("filename is not null").select("id")
    p = t.archive_documents.select(F.col("id").alias("target_id"))
    return x.join(d, "id").withColumn("target_id", F.col("id") + 100).join(p, "target_id").select("target_id", "word_count")
