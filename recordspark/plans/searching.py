"""Queries over the full-text index and free text."""

from __future__ import annotations

from pyspark.sql import functions as F

from recordspark.functions import quality as Q
from recordspark.functions import records as R
from recordspark.functions import text as X
from recordspark.operators import fts
from recordspark.plans.query_language import as_phrase, parse
from recordspark.plans.registry import Tables, query
from recordspark.session import shared_folder

_POST = r"""WITH tx AS (SELECT document_id, regexp_extract_all(strip_accents(lower(full_text)), '[\p{L}\p{N}]+') AS w FROM document_texts WHERE trim(full_text) <> ''),
po AS (SELECT document_id, unnest(w) AS term, generate_subscripts(w, 1) AS pos FROM tx)"""


def _phrase(words: list[str]) -> str:
    joins = " ".join(f"JOIN po p{k} ON p{k}.document_id = p0.document_id AND p{k}.pos = p0.pos + {k} AND p{k}.term = '{w}'" for k, w in enumerate(words) if k)
    return f"SELECT p0.document_id, count(*) AS tf FROM po p0 {joins} WHERE p0.term = '{words[0]}' GROUP BY 1"


def _index(t: Tables):
    """The written index of a folder's texts; built once per session and state of the files, in the shared folder."""
    files = t.document_texts.select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct()
    state = files.agg(F.sum(F.xxhash64("file_path", "file_modification_time", "file_size") % F.lit(1 << 40)).alias("s")).first()["s"]
    path = f"{shared_folder(t.spark)}/text-index-{state}"
    done = t.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/lengths/_SUCCESS")
    if not done.getFileSystem(t.spark._jsc.hadoopConfiguration()).exists(done):
        fts.write_index(t.document_texts.select("document_id", "full_text"), path)
    return fts.read_postings(t.spark, path), fts.read_lengths(t.spark, path)


@query(_POST + " SELECT term, count(*) AS n, count(DISTINCT document_id) AS documents FROM po GROUP BY 1")
def fts_vocabulary(t: Tables):
    return _index(t)[0].groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("document_id").alias("documents"))


@query(_POST + " SELECT DISTINCT document_id FROM po WHERE term = 'guestbook'")
def fts_term(t: Tables):
    return fts.match(_index(t)[0], parse("guestbook"))


@query(_POST + f" SELECT document_id FROM ({_phrase(['the', 'port', 'chaplain'])})")
def fts_phrase(t: Tables):
    return fts.match(_index(t)[0], parse('"the port chaplain"'))


@query(_POST + f" SELECT document_id FROM ({_phrase(['minute', 'book'])})")
def fts_split_term(t: Tables):
    return fts.match(_index(t)[0], parse("minute-book"))


@query(_POST + f", a AS ({_phrase(['night', 'porter'])}), b AS ({_phrase(['guestbook'])}), c AS ({_phrase(['survey', 'hut'])}) SELECT document_id FROM a WHERE document_id IN (SELECT document_id FROM b) UNION SELECT document_id FROM c")
def fts_and_or(t: Tables):
    return fts.match(_index(t)[0], parse('"night porter" guestbook OR "survey hut"'))


@query(_POST + f" SELECT count(*) AS total FROM ({_phrase(['guest', 'house'])}) h JOIN archive_documents d ON d.id = h.document_id WHERE lower(d.document_type) = 'email'")
def fts_count(t: Tables):
    hits = fts.match(_index(t)[0], as_phrase("guest house"))
    d = t.archive_documents.filter("lower(document_type) = 'email'").select(F.col("id").alias("document_id"))
    return hits.join(d, "document_id").agg(F.count(F.lit(1)).alias("total"))


_BM25 = """, a AS ({a}), b AS ({b}), f AS (SELECT count(*) AS docs, avg(len(w)) AS al FROM tx), l AS (SELECT document_id, len(w) AS n FROM tx),
h AS (SELECT document_id, tf, (SELECT count(*) FROM a) AS n FROM a UNION ALL SELECT document_id, tf, (SELECT count(*) FROM b) FROM b),
s AS (SELECT h.document_id, -sum(greatest(ln((f.docs - h.n + 0.5) / (h.n + 0.5)), 1e-6) * h.tf * 2.2 / (h.tf + 1.2 * (1 - 0.75 + 0.75 * l.n / f.al))) AS score FROM h JOIN l ON l.document_id = h.document_id CROSS JOIN f GROUP BY 1)"""


@query(_POST + _BM25.format(a=_phrase(["yacht"]), b=_phrase(["ferry", "operator"])) + " SELECT document_id, round(score, 6) AS score FROM s ORDER BY round(score, 9), document_id LIMIT 50")
def fts_bm25_top(t: Tables):
    postings, sizes = _index(t)
    scored = fts.bm25(postings, sizes, parse('yacht OR "ferry operator"'))
    return scored.orderBy(F.round("score", 9), "document_id").limit(50).select("document_id", F.round("score", 6).alias("score"))


@query(
    _POST
    + _BM25.format(a=_phrase(["lodge"]), b=_phrase(["lodge"])).replace(" UNION ALL SELECT document_id, tf, (SELECT count(*) FROM b) FROM b", "")
    + """, q AS (SELECT document_id AS id, round(score, 6) AS score, 0 AS src FROM s ORDER BY round(score, 9), document_id LIMIT 20), n AS (SELECT id, 0.5::DOUBLE AS score, 1 AS src FROM archive_documents WHERE (lower(title) LIKE '%ledger%' OR lower(filename) LIKE '%ledger%') AND id NOT IN (SELECT id FROM q))
    SELECT id, score, src FROM (SELECT * FROM q UNION ALL SELECT * FROM n) ORDER BY src, score, id DESC LIMIT 40"""
)
def fts_plus_filename_fill(t: Tables):
    postings, sizes = _index(t)
    top = fts.bm25(postings, sizes, parse("lodge")).orderBy(F.round("score", 9), "document_id").limit(20)
    hits = top.select(F.col("document_id").alias("id"), F.round("score", 6).alias("score"), F.lit(0).alias("src"))
    named = t.archive_documents.filter(X.contains_any([F.col("title"), F.col("filename")], "ledger")).select("id").join(hits.select("id"), "id", "left_anti")
    return hits.unionByName(named.select("id", F.lit(0.5).alias("score"), F.lit(1).alias("src"))).orderBy("src", "score", F.desc("id")).limit(40)


_WINDOW = _POST + """, hp AS (SELECT document_id, pos - 1 AS pos FROM po WHERE term IN ('yacht', 'lodge')), sp AS (SELECT document_id, unnest(range(greatest(pos - 31, 0), pos + 1)) AS first_pos FROM hp), cn AS (SELECT document_id, first_pos, count(*) AS hits FROM sp GROUP BY 1, 2),
    wi AS (SELECT document_id, arg_min(first_pos, (-hits, first_pos)) AS first_pos, max(hits) AS hits FROM cn GROUP BY 1)"""


@query(_WINDOW + " SELECT document_id, first_pos, hits FROM wi")
def fts_snippet_window(t: Tables):
    return fts.snippet_window(_index(t)[0], parse("yacht OR lodge"))


@query(
    _WINDOW
    + r""" SELECT document_id, (CASE WHEN first_pos > 0 THEN '...' ELSE '' END) || array_to_string(list_transform(w[first_pos + 1 : first_pos + 32], lambda t: CASE WHEN strip_accents(lower(t)) IN ('yacht', 'lodge') THEN '>>>' || t || '<<<' ELSE t END), ' ') || (CASE WHEN first_pos + 32 < len(w) THEN '...' ELSE '' END) AS snippet
    FROM (SELECT wi.document_id, first_pos, regexp_extract_all(full_text, '[\p{L}\p{N}]+') AS w FROM wi JOIN document_texts t ON t.document_id = wi.document_id)"""
)
def fts_snippet_text(t: Tables):
    asked = parse("yacht OR lodge")
    return fts.snippet_text(t.document_texts, fts.snippet_window(_index(t)[0], asked), asked)


@query("SELECT d.id FROM archive_documents d LEFT JOIN document_texts x ON x.document_id = d.id WHERE contains(lower(coalesce(d.title, '')), 'ledger') OR contains(lower(coalesce(d.filename, '')), 'ledger') OR contains(lower(coalesce(x.full_text, '')), 'ledger')")
def contains_full_text(t: Tables):
    d = t.archive_documents.select("id", "title", "filename").join(t.document_texts.select(F.col("document_id").alias("id"), "full_text"), "id", "left")
    return d.filter(X.contains_any([F.col("title"), F.col("filename"), F.col("full_text")], "ledger")).select("id")


@query(r"SELECT id, regexp_matches(trim(title), '(?i)^[A-Za-z0-9_.\-]+\.(pdf|jpe?g|png|tiff?|mp4|mov|avi|wav|mp3|m4a|docx?|xlsx?|txt)$') AS is_filename FROM archive_documents WHERE title IS NOT NULL")
def titles_like_filenames(t: Tables):
    return t.archive_documents.filter("title is not null").select("id", X.looks_like_filename(F.col("title")).alias("is_filename"))


@query(
    """SELECT document_id, CASE WHEN p > 0 THEN (CASE WHEN b > 1 THEN '...' ELSE '' END) || substr(x, b, p - b) || '>>>' || substr(x, p, 10) || '<<<' || substr(x, p + 10, e - (p + 10) + 1) || (CASE WHEN e < length(x) THEN '...' ELSE '' END)
    WHEN length(x) > 300 THEN substr(x, 1, 300) || '...' ELSE x END AS snippet FROM (SELECT *, greatest(p - 150, 1) AS b, least(p + 10 - 1 + 150, length(x)) AS e FROM (SELECT document_id, full_text AS x, instr(lower(full_text), 'restricted') AS p FROM document_texts WHERE full_text <> ''))"""
)
def snippet_markers(t: Tables):
    x = t.document_texts.filter("full_text <> ''")
    return x.select("document_id", X.snippet(F.col("full_text"), "restricted").alias("snippet"))


@query("SELECT id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS title FROM archive_documents WHERE title IS NOT NULL")
def html_escaped_titles(t: Tables):
    return t.archive_documents.filter("title is not null").select("id", X.html_escape(F.col("title")).alias("title"))


@query("SELECT id, regexp_replace(replace(replace('>>>' || title || '<<< & more', '&', '&amp;'), '>', '&gt;').replace('<', '&lt;'), '&gt;&gt;&gt;(.+?)&lt;&lt;&lt;', '<mark>\\1</mark>', 'g') AS marked FROM archive_documents WHERE title IS NOT NULL AND NOT regexp_matches(title, '[\"''<>]')")
def highlight_html(t: Tables):
    d = t.archive_documents.filter("title is not null").filter(~F.col("title").rlike("[\"'<>]"))
    return d.select("id", X.mark_html(F.concat(F.lit(">>>"), F.col("title"), F.lit("<<< & more"))).alias("marked"))


@query(r"SELECT document_id, len(list_filter(regexp_split_to_array(full_text, '[ \t\n\r\f\x0B]+'), lambda w: w <> '')) AS words FROM document_texts WHERE full_text IS NOT NULL")
def word_count(t: Tables):
    return t.document_texts.filter("full_text is not null").select("document_id", X.word_count(F.col("full_text")).cast("bigint").alias("words"))


_COMMON = ", ".join(f"'{w}'" for w in X.COMMON_WORDS)


@query(
    rf"""SELECT document_id, (length(full_text) >= 100 AND len(w) >= 20 AND len(list_filter(w, lambda x: x IN ({_COMMON}))) / len(w) >= 0.05) AS readable FROM (SELECT document_id, full_text, list_filter(regexp_split_to_array(lower(full_text), '[ \t\n\r\f\x0B]+'), lambda w: w <> '') AS w FROM document_texts WHERE full_text IS NOT NULL)"""
)
def quality_text(t: Tables):
    return t.document_texts.filter("full_text is not null").select("document_id", X.is_readable(F.col("full_text")).alias("readable"))


@query(
    r"""SELECT id, CASE WHEN length(s) < 4 OR len(regexp_extract_all(s, '[A-Za-z]')) < length(s) * 0.4 THEN '' ELSE s END AS title FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(filename, ''), '(?i)\.[a-z0-9]{2,4}$', ''), '^[0-9]{6,}[_-]\s*', ''), '_+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM archive_documents)"""
)
def clean_title(t: Tables):
    return t.archive_documents.select("id", R.clean_title(F.col("filename")).alias("title"))


@query(
    r"""WITH c AS (SELECT id, bates_number AS b, CASE WHEN length(s) < 4 OR len(regexp_extract_all(s, '[A-Za-z]')) < length(s) * 0.4 THEN '' ELSE s END AS s FROM (SELECT id, bates_number, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(filename, ''), '(?i)\.[a-z0-9]{2,4}$', ''), '^[0-9]{6,}[_-]\s*', ''), '_+', ' ', 'g'), '\s+', ' ', 'g')) AS s FROM archive_documents))
    SELECT id, CASE WHEN s = '' THEN b WHEN b IS NULL OR regexp_replace(lower(s), '[^a-z0-9]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9]', '', 'g') THEN s ELSE b || ' — ' || s END AS title FROM c"""
)
def title_composition(t: Tables):
    said = t.archive_documents.select("id", "bates_number", R.clean_title(F.col("filename")).alias("said"))
    return said.select("id", R.record_title(F.col("bates_number"), F.col("said")).alias("title"))


@query(
    r"""SELECT id, substr((CASE WHEN b > 0 THEN '...' ELSE '' END) || trim(regexp_replace(substr(x, b + 1, e - b), '\s+', ' ', 'g'), ' ') || (CASE WHEN e < length(x) THEN '...' ELSE '' END), 1, 500) AS context
    FROM (SELECT m.id, t.full_text AS x, greatest(m.position_start - 150, 0) AS b, least(m.position_end + 150, length(t.full_text)) AS e FROM mentions m JOIN document_texts t ON t.document_id = m.document_id WHERE t.full_text IS NOT NULL AND m.position_start IS NOT NULL AND m.position_end <= length(t.full_text) AND m.position_start >= 0 AND m.position_start <= m.position_end)"""
)
def context_snippet(t: Tables):
    x = t.document_texts.filter("full_text is not null").select("document_id", "full_text")
    m = t.mentions.select("id", "document_id", "position_start", "position_end").join(x, "document_id").filter("position_start is not null and position_end <= length(full_text) and position_start >= 0 and position_start <= position_end")
    return m.select("id", X.context(F.col("full_text"), F.col("position_start"), F.col("position_end")).alias("context"))


@query("SELECT document_id, k AS part, substr(full_text, k * 1000 + 1, 1000) AS piece, least((k + 1) * 1000, length(full_text)) AS upto FROM (SELECT document_id, full_text, unnest(range(0, greatest(CAST(ceil(length(full_text) / 1000.0) AS INT), 1)))::INT AS k FROM document_texts WHERE full_text <> '')")
def text_pieces(t: Tables):
    x = t.document_texts.filter("full_text <> ''").select("document_id", F.inline(X.pieces(F.col("full_text"), 1000)))
    return x.withColumn("upto", F.col("upto").cast("bigint"))


@query("SELECT document_id, len(pages_text) AS pages, pages_text[1] AS first_page FROM document_texts WHERE pages_text IS NOT NULL")
def pages_array_element(t: Tables):
    return t.document_texts.filter("pages_text is not null").select("document_id", F.size("pages_text").cast("bigint").alias("pages"), F.get("pages_text", F.lit(0)).alias("first_page"))


@query("SELECT document_id, array_to_string(pages_text, chr(10) || chr(10)) AS joined, array_to_string(list_filter(pages_text, lambda p: trim(p) <> ''), chr(10)) AS filled FROM document_texts WHERE pages_text IS NOT NULL")
def page_concat(t: Tables):
    x = t.document_texts.filter("pages_text is not null")
    return x.select("document_id", F.array_join("pages_text", "\n\n").alias("joined"), F.array_join(F.filter("pages_text", lambda p: F.trim(p) != ""), "\n").alias("filled"))


@query("SELECT id, md5(coalesce(title, '')) AS md5, sha256(coalesce(title, '')) AS sha256 FROM archive_documents")
def hashes(t: Tables):
    c = F.coalesce("title", F.lit(""))
    return t.archive_documents.select("id", F.md5(c).alias("md5"), F.sha2(c, 256).alias("sha256"))


@query("SELECT id, levenshtein(lower(filename), lower(title)) AS edits FROM archive_documents WHERE filename IS NOT NULL AND title IS NOT NULL AND NOT regexp_matches(filename || title, '[^ -~]')")
def cer_pairs(t: Tables):
    d = t.archive_documents.filter("filename is not null and title is not null").filter(~F.concat("filename", "title").rlike("[^ -~]"))
    return d.select("id", F.levenshtein(F.lower("filename"), F.lower("title")).cast("bigint").alias("edits"))


@query()
def wer_pairs(t: Tables):
    d = t.archive_documents.filter("title is not null")
    return d.select("id", Q.word_edits(F.lower("title"), F.replace(F.lower("filename"), F.lit("_"), F.lit(" "))).alias("edits"))


def _sensitive(c: str) -> str:
    return " + ".join("CAST(regexp_matches(" + c + ", '(?i)" + p.replace("'", "''") + "') AS INT)" for p in Q.SENSITIVE_SHAPES)


@query(f"SELECT id, round(least(({_sensitive('x')}) / 7 + CASE WHEN length(x) > 20 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(x) > 100 THEN 0.2::DOUBLE ELSE 0 END, 1), 6) AS score FROM (SELECT id, coalesce(context_snippet, '') AS x FROM mentions)")
def sensitivity_score(t: Tables):
    return t.mentions.select("id", Q.sensitivity(F.col("context_snippet")).alias("score"))
