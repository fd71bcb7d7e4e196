"""Queries of the problems pN and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordspark.llm.abuse import abuse_rates, scored
from recordspark.llm.cooccurrence import cooccurrence
from recordspark.llm.emails import new_lines, new_text
from recordspark.llm.formdup import LABELS, copies, copy_groups
from recordspark.llm.leakage import leak_report, leaked
from recordspark.llm.mixture import mixture, shares
from recordspark.llm.names import same_entities, same_pairs
from recordspark.llm.pii import personal_data, redacted_tables
from recordspark.llm.scans import repaired, scan_cases
from recordspark.llm.truncation import judged, truncation_rates
from recordspark.sources.tables import table


def p1_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return same_entities(table(spark, sf, "entities", "id", "canonical_name", "entity_type", "first_name", "aliases"), table(spark, sf, "mentions", "entity_id", "name_as_appears"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return same_pairs(p1_clusters(spark, sf))


def _p2(spark: SparkSession, sf: str) -> DataFrame:
    return judged(table(spark, sf, "document_texts", "document_id", "full_text", "pages_text", "word_count"), table(spark, sf, "archive_documents", "id", "data_set"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _p2(spark, sf).filter("cut").select("document_id")


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation_rates(_p2(spark, sf))


def p2_judged(spark: SparkSession, sf: str) -> DataFrame:
    return _p2(spark, sf)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return new_lines(table(spark, sf, "document_texts", "document_id", "full_text"), table(spark, sf, "archive_documents", "id", "document_type"))


def p3_new_text(spark: SparkSession, sf: str) -> DataFrame:
    return new_text(table(spark, sf, "document_texts", "document_id", "full_text"), table(spark, sf, "archive_documents", "id", "document_type"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    groups = copy_groups(table(spark, sf, "archive_documents", "id", "file_hash"), table(spark, sf, "document_texts", "document_id", "full_text"))
    return groups.filter("first_id <> copy_id")


def p4_copies(spark: SparkSession, sf: str) -> DataFrame:
    return copies(table(spark, sf, "archive_documents", "id", "file_hash"), table(spark, sf, "document_texts", "document_id", "full_text"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return scan_cases(table(spark, sf, "document_texts", "document_id", "pages_text", "full_text"))[0]


def p5_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return repaired(table(spark, sf, "document_texts", "document_id", "pages_text", "full_text"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return personal_data(
        table(spark, sf, "document_texts", "document_id", "full_text"), table(spark, sf, "mentions", "id", "context_snippet", "name_as_appears"), table(spark, sf, "entities", "canonical_name", "aliases", "entity_type")
    )


def p6_redacted(spark: SparkSession, sf: str) -> DataFrame:
    return redacted_tables(
        table(spark, sf, "document_texts", "document_id", "full_text"), table(spark, sf, "mentions", "id", "context_snippet", "name_as_appears"), table(spark, sf, "entities", "canonical_name", "aliases", "entity_type")
    )


def p7_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = cooccurrence(table(spark, sf, "mentions", "document_id", "entity_id"), "document_id", "entity_id", min_support=5, min_lift=3.0)
    out = pairs.withColumnsRenamed({"item_1": "entity_id_1", "item_2": "entity_id_2"})
    return out.withColumns({"lift": F.round("lift", 6), "llr": F.round("llr", 4)})


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_pairs(spark, sf).select("entity_id_1", "entity_id_2")


def p8_leaks(spark: SparkSession, sf: str) -> DataFrame:
    return leaked(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_leaks(spark, sf).select("doc_id", "item_id")


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return leak_report(p8_leaks(spark, sf), table(spark, sf, "eval_items", "item_id", "text"))


def p9_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return mixture(table(spark, sf, "documents", "doc_id", "text", "source"), table(spark, sf, "mixture_targets"))


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return shares(p9_mixture(spark, sf), table(spark, sf, "mixture_targets"))


def p10_scores(spark: SparkSession, sf: str) -> DataFrame:
    return scored(table(spark, sf, "documents", "doc_id", "text", "source"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return p10_scores(spark, sf).filter("score >= 0.5").select("doc_id")


def p10_rates(spark: SparkSession, sf: str) -> DataFrame:
    return abuse_rates(p10_scores(spark, sf))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_clusters": p1_clusters,
    "p2_found": p2_found,
    "p2_rates": p2_rates,
    "p2_judged": p2_judged,
    "p3_found": p3_found,
    "p3_new_text": p3_new_text,
    "p4_found": p4_found,
    "p4_copies": p4_copies,
    "p5_found": p5_found,
    "p5_repaired": p5_repaired,
    "p6_found": p6_found,
    "p6_redacted": p6_redacted,
    "p7_found": p7_found,
    "p7_pairs": p7_pairs,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p8_report": p8_report,
    "p9_mixture": p9_mixture,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

_P7 = """
WITH d AS (SELECT DISTINCT document_id, entity_id FROM mentions WHERE document_id IS NOT NULL AND entity_id IS NOT NULL),
t AS (SELECT count(DISTINCT document_id) AS n FROM mentions),
s AS (SELECT entity_id, count(*) AS k FROM d GROUP BY entity_id),
p AS (SELECT a.entity_id AS entity_id_1, b.entity_id AS entity_id_2, count(*) AS n12
      FROM d a JOIN d b ON a.document_id = b.document_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 5),
q AS (SELECT p.entity_id_1, p.entity_id_2, p.n12, s1.k AS n1, s2.k AS n2, t.n
      FROM p JOIN s s1 ON s1.entity_id = p.entity_id_1 JOIN s s2 ON s2.entity_id = p.entity_id_2 CROSS JOIN t
      WHERE p.n12 * t.n >= 3 * s1.k * s2.k)
"""

_LABEL = "|".join("\\s+".join(x.split()) for x in LABELS)
_FOLD = "lower(upper(regexp_replace({0}, '[^\\p{{L}}\\p{{N}}]+', '', 'g')))"
_P4 = f"""
WITH RECURSIVE h AS (SELECT id, regexp_replace(regexp_replace(lower(trim(file_hash)), '^(?:sha-?(?:1|256|512)|md5)\\s*[:\\-=]\\s*', ''), '[^0-9a-z]', '', 'g') AS k FROM archive_documents WHERE file_hash IS NOT NULL),
t AS (SELECT document_id AS id, full_text AS x, regexp_matches(full_text, '(?i)(?:^|[^\\p{{L}}\\p{{N}}])Bates\\s+Begin\\s*"?\\s*[:=\\-]') AS is_record FROM document_texts WHERE full_text IS NOT NULL),
f AS (SELECT id, list_filter(string_split(regexp_replace(x, '(?i)(^|[\\s|;,{{"])({_LABEL})\\s*"?\\s*(?:[:=]|-\\s)', chr(1) || '\\2' || chr(2), 'g'), chr(1)), lambda p: contains(p, chr(2))) AS parts FROM t WHERE is_record),
c AS (SELECT id, {_FOLD.format('x')} AS k FROM t WHERE NOT is_record UNION ALL SELECT id, 'record:' || array_to_string(list_sort(list_transform(parts, lambda p: {_FOLD.format("string_split(p, chr(2))[1]")} || chr(2) || {_FOLD.format("string_split(p, chr(2))[-1]")})), chr(1)) FROM f),
k AS (SELECT DISTINCT id, 'h' || k AS k FROM h WHERE length(k) >= 16 UNION SELECT id, 'c' || k FROM c WHERE k <> ''),
e AS (SELECT DISTINCT a.id AS x, b.id AS y FROM k a JOIN k b ON a.k = b.k AND a.id <> b.id),
r(id, m) AS (SELECT x, x FROM e UNION SELECT e.y, r.m FROM r JOIN e ON e.x = r.id)
SELECT min(m) AS first_id, id AS copy_id FROM r GROUP BY id HAVING min(m) <> id
"""

SQL: dict[str, str] = {
    "p4_found": _P4,
    "p7_found": _P7 + "SELECT entity_id_1, entity_id_2 FROM q",
    "p7_pairs": _P7
    + """SELECT *, llr >= 10.83 AS significant FROM (SELECT entity_id_1, entity_id_2, n12, n1, n2, n, round(n12 * n / (n1 * n2), 6) AS lift, round(greatest(0, 2 * ((CASE WHEN n::DOUBLE > 0 THEN n::DOUBLE * ln(n::DOUBLE) ELSE 0 END) - (CASE WHEN n1::DOUBLE > 0 THEN n1::DOUBLE * ln(n1::DOUBLE) ELSE 0 END) - (CASE WHEN (n - n1)::DOUBLE > 0 THEN (n - n1)::DOUBLE * ln((n - n1)::DOUBLE) ELSE 0 END) - (CASE WHEN n2::DOUBLE > 0 THEN n2::DOUBLE * ln(n2::DOUBLE) ELSE 0 END) - (CASE WHEN (n - n2)::DOUBLE > 0 THEN (n - n2)::DOUBLE * ln((n - n2)::DOUBLE) ELSE 0 END) + (CASE WHEN n12::DOUBLE > 0 THEN n12::DOUBLE * ln(n12::DOUBLE) ELSE 0 END) + (CASE WHEN (n1 - n12)::DOUBLE > 0 THEN (n1 - n12)::DOUBLE * ln((n1 - n12)::DOUBLE) ELSE 0 END) + (CASE WHEN (n2 - n12)::DOUBLE > 0 THEN (n2 - n12)::DOUBLE * ln((n2 - n12)::DOUBLE) ELSE 0 END) + (CASE WHEN (n - n1 - n2 + n12)::DOUBLE > 0 THEN (n - n1 - n2 + n12)::DOUBLE * ln((n - n1 - n2 + n12)::DOUBLE) ELSE 0 END))), 4) AS llr FROM q) x""",
}
