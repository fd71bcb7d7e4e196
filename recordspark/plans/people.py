"""Queries over entities and mentions: search, siblings, graph, upkeep."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.functions import names as N
from recordspark.operators import graph, resolve
from recordspark.operators.visibility import hidden_ids, parse_policy, without_hidden
from recordspark.plans.browsing import _HIDDEN, POLICY, TYPE_KEY
from recordspark.plans.registry import Tables, query

KIND = "(CASE WHEN lower({0}) IN ('org', 'organization', 'organisation') THEN 'organization' WHEN lower({0}) IN ('per', 'person') THEN 'person' WHEN lower({0}) IN ('loc', 'gpe', 'location') THEN 'location' ELSE coalesce(lower({0}), 'unknown') END)"
MERGE_KEY = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


def _merge_key_sql(column: str) -> str:
    x = f"trim(lower({column}))"
    for t in N.KEY_TITLES:
        x = f"replace({x}, '{t}', '')"
    for s in N.KEY_SUFFIXES:
        x = f"regexp_replace({x}, ' {s.replace('.', chr(92) + '.')}$', '')"
    return MERGE_KEY.format(x)


def _display_name_sql(column: str) -> str:
    x = rf"trim(regexp_replace({column}, '\s+', ' ', 'g'))"
    for t in N.NAME_TITLES:
        x = f"trim(regexp_replace({x}, '^{t.replace('.', chr(92) + '.')} ', ''))"
    for s in N.NAME_SUFFIXES:
        x = f"trim(regexp_replace({x}, ' {s.replace('.', chr(92) + '.')}$', ''))"
    return x


@query("SELECT m.id, m.document_id, d.title, m.role FROM mentions m JOIN archive_documents d ON d.id = m.document_id WHERE m.entity_id = 3")
def mentions_by_entity(t: Tables):
    d = t.archive_documents.select(F.col("id").alias("document_id"), "title")
    return t.mentions.filter("entity_id = 3").select("id", "document_id", "role").join(d, "document_id")


@query("SELECT id, document_id, lower(role) AS role, role_confidence FROM mentions WHERE entity_id = 1 AND lower(role) IN ('witness', 'associate', 'unknown') ORDER BY role_confidence DESC NULLS LAST, id LIMIT 100")
def entity_mentions_by_role(t: Tables):
    m = t.mentions.filter((F.col("entity_id") == 1) & F.lower("role").isin("witness", "associate", "unknown"))
    return m.orderBy(F.desc("role_confidence"), "id").limit(100).select("id", "document_id", F.lower("role").alias("role"), "role_confidence")


@query("SELECT entity_id, id, document_id FROM (SELECT entity_id, id, document_id, row_number() OVER (PARTITION BY entity_id ORDER BY id) AS rn FROM mentions) WHERE rn <= 5")
def entity_mentions_topk(t: Tables):
    m = t.mentions.select("entity_id", "id", "document_id")
    return m.withColumn("rn", F.row_number().over(W.partitionBy("entity_id").orderBy("id"))).filter("rn <= 5").drop("rn")


@query("SELECT m.id, m.name_as_appears, e.canonical_name FROM mentions m JOIN entities e ON e.id = m.entity_id WHERE m.document_id = 7 ORDER BY m.id LIMIT 100")
def document_entities(t: Tables):
    m = t.mentions.filter("document_id = 7").join(t.entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id")
    return m.orderBy("id").limit(100).select("id", "name_as_appears", "canonical_name")


@query(f"SELECT lower(canonical_name) AS name_key, {KIND.format('entity_type')} AS kind, arg_max(id, (coalesce(mention_count, 0), -id)) AS rep_id, arg_max(canonical_name, (coalesce(mention_count, 0), -id)) AS rep_name, sum(coalesce(mention_count, 0)) AS total, count(*) AS members FROM entities GROUP BY 1, 2")
def entity_search_merged(t: Tables):
    return resolve.groups(t.entities)


@query(f"SELECT count(*) AS total FROM (SELECT 1 FROM entities WHERE lower(canonical_name) LIKE '%trust%' GROUP BY lower(canonical_name), {KIND.format('entity_type')})")
def entity_search_total(t: Tables):
    return resolve.groups(t.entities.filter(F.lower("canonical_name").contains("trust"))).agg(F.count(F.lit(1)).alias("total"))


@query("SELECT document_id, arg_min(role, id) AS role, count(*) AS n FROM mentions WHERE entity_id = 1 GROUP BY 1 ORDER BY n DESC, document_id LIMIT 5")
def entity_documents_role(t: Tables):
    g = t.mentions.filter("entity_id = 1").groupBy("document_id").agg(F.get(F.array(F.min(F.struct("id", "role"))), F.lit(0))["role"].alias("role"), F.count(F.lit(1)).alias("n"))
    return g.orderBy(F.desc("n"), "document_id").limit(5)


@query(f"SELECT id AS entity_id, min(id) OVER (PARTITION BY lower(canonical_name), {KIND.format('entity_type')}) AS first_sibling, count(*) OVER (PARTITION BY lower(canonical_name), {KIND.format('entity_type')}) AS siblings FROM entities WHERE canonical_name IS NOT NULL")
def entity_siblings(t: Tables):
    return resolve.sibling_groups(t.entities)


@query(
    f"""WITH k AS (SELECT id, lower(canonical_name) AS n, {KIND.format('entity_type')} AS t, coalesce(mention_count, 0) AS c FROM entities WHERE canonical_name IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY n, t ORDER BY c DESC, id) AS rn FROM k)
    SELECT k.id AS entity_id, r.id AS sibling_id FROM k JOIN r ON r.n = k.n AND r.t = k.t AND r.rn <= 2"""
)
def entity_siblings_capped(t: Tables):
    return resolve.siblings(t.entities, cap=2)


@query(f"SELECT m.entity_id, e.canonical_name, count(*) AS n FROM mentions m JOIN archive_documents d ON d.id = m.document_id JOIN entities e ON e.id = m.entity_id WHERE {TYPE_KEY.format('d.document_type')} = 'email' AND lower(m.role) = 'witness' GROUP BY 1, 2")
def entity_search_role_filtered(t: Tables):
    from recordspark.functions.records import doc_type_key

    d = t.archive_documents.filter(doc_type_key(F.col("document_type")) == "email").select(F.col("id").alias("document_id"))
    m = t.mentions.filter("lower(role) = 'witness'").select("document_id", "entity_id").join(d, "document_id").groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return m.join(t.entities.select(F.col("id").alias("entity_id"), "canonical_name"), "entity_id").select("entity_id", "canonical_name", "n")


_COOC = """WITH de AS (SELECT DISTINCT document_id, entity_id FROM {0} WHERE document_id IS NOT NULL AND entity_id IS NOT NULL), sm AS (SELECT * FROM de WHERE document_id IN (SELECT document_id FROM de GROUP BY 1 HAVING count(*) <= {1})),
pc AS (SELECT a.entity_id AS e1, b.entity_id AS e2, count(*) AS s FROM sm a JOIN sm b ON a.document_id = b.document_id AND a.entity_id < b.entity_id GROUP BY 1, 2 HAVING count(*) >= 2),
bo AS (SELECT e1 AS entity_id, e2 AS other_entity_id, s AS shared_docs FROM pc UNION ALL SELECT e2, e1, s FROM pc),
top AS (SELECT entity_id, other_entity_id, shared_docs FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY shared_docs DESC, other_entity_id) AS rn FROM bo) WHERE rn <= 40)"""


@query(_COOC.format("mentions", 12) + " SELECT entity_id, other_entity_id, shared_docs FROM top")
def cooccurrence_top(t: Tables):
    return graph.cooccurrence_top(t.mentions, cap=12)


@query(_COOC.format("mentions", 200) + " SELECT t.other_entity_id, t.shared_docs, e.canonical_name, e.entity_type, e.mention_count FROM top t JOIN entities e ON e.id = t.other_entity_id WHERE t.entity_id = 3 AND lower(e.entity_type) = 'person'")
def cooccurrence_lookup(t: Tables):
    return graph.neighbours(graph.cooccurrence_top(t.mentions), t.entities, 3, "person")


@query(_COOC.format(f"(SELECT * FROM mentions WHERE document_id NOT IN (SELECT d.id FROM archive_documents d WHERE {_HIDDEN}))", 200) + " SELECT entity_id, other_entity_id, shared_docs FROM top")
def cooccurrence_visible_only(t: Tables):
    return graph.cooccurrence_top(without_hidden(t.mentions, hidden_ids(parse_policy(POLICY), t.archive_documents), fail_closed=True))


@query("SELECT e.id, coalesce(n.n, 0) AS mention_count FROM entities e LEFT JOIN (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1) n ON n.entity_id = e.id")
def mention_count_refresh(t: Tables):
    return resolve.refreshed_counts(t.entities, t.mentions)


_RULES = [("estate", "location"), ("harbour", "location"), ("trust", "organization")]


@query("SELECT id, CASE WHEN contains(lower(canonical_name), 'estate') THEN 'location' WHEN contains(lower(canonical_name), 'harbour') THEN 'location' WHEN contains(lower(canonical_name), 'trust') THEN 'organization' ELSE entity_type END AS entity_type FROM entities")
def dedup_type_override(t: Tables):
    return resolve.override_types(t.entities, t.spark.createDataFrame(_RULES, "pattern string, forced_type string")).select("id", "entity_type")


JUNK = ["the", "court", "office", "mr. benjamin", "prof. vinildrint"]


@query("SELECT (SELECT count(*) FROM k) AS entities, (SELECT count(*) FROM mentions m WHERE m.entity_id IN (SELECT id FROM k)) AS mentions FROM (SELECT 1) CROSS JOIN (SELECT 1)".replace("SELECT (", "WITH k AS (SELECT id FROM entities WHERE lower(trim(canonical_name)) NOT IN ('the', 'court', 'office', 'mr. benjamin', 'prof. vinildrint') AND length(trim(canonical_name)) >= 3) SELECT (", 1))
def dedup_junk_removed(t: Tables):
    kept, mentions = resolve.remove_junk(t.entities, t.mentions, JUNK)
    n = F.count(F.lit(1))
    return kept.agg(n.alias("entities")).crossJoin(mentions.agg(n.alias("mentions")))


@query(
    f"""WITH k AS (SELECT id, canonical_name, {_merge_key_sql('canonical_name')} AS key FROM entities WHERE canonical_name IS NOT NULL), r AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY length(canonical_name) DESC, id) AS new_id FROM k WHERE length(key) >= 2)
    SELECT id AS old_id, new_id FROM r WHERE id <> new_id"""
)
def dedup_exact_normalised(t: Tables):
    return resolve.merge_mapping(t.entities)


@query(
    f"""WITH k AS (SELECT id, canonical_name, {_merge_key_sql('canonical_name')} AS key FROM entities WHERE canonical_name IS NOT NULL), r AS (SELECT *, first_value(id) OVER (PARTITION BY key ORDER BY length(canonical_name) DESC, id) AS new_id FROM k WHERE length(key) >= 2),
    mp AS (SELECT id AS old_id, new_id FROM r WHERE id <> new_id) SELECT coalesce(mp.new_id, m.entity_id) AS entity_id, count(*) AS n FROM mentions m LEFT JOIN mp ON mp.old_id = m.entity_id GROUP BY 1"""
)
def dedup_mentions_repointed(t: Tables):
    return resolve.apply_mapping(t.mentions.select("entity_id"), resolve.merge_mapping(t.entities)).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    r"""WITH r(pattern, preferred_token, fallback_name, forced_type) AS (VALUES ('banabbes', 'adrian', 'A. Banabbes', 'person'), ('nasazlent', 'association', 'Nasazlent', 'organization')),
    h AS (SELECT e.id, e.canonical_name, r.*, CASE WHEN regexp_matches(e.canonical_name, '[^\p{L}\p{N} .,''\-]') THEN 0 ELSE 1 END AS c, CASE WHEN contains(lower(e.canonical_name), r.preferred_token) THEN 1 ELSE 0 END AS p, CASE WHEN contains(e.canonical_name, ' ') THEN 1 ELSE 0 END AS s FROM entities e JOIN r ON contains(lower(e.canonical_name), r.pattern)),
    b AS (SELECT pattern, first(id ORDER BY c DESC, p DESC, s DESC, id) AS new_id, first(p ORDER BY c DESC, p DESC, s DESC, id) AS pr, first(canonical_name ORDER BY c DESC, p DESC, s DESC, id) AS nm FROM h GROUP BY 1)
    SELECT h.id AS old_id, b.new_id, CASE WHEN b.pr = 1 THEN b.nm ELSE h.fallback_name END AS new_name, h.forced_type FROM h JOIN b ON b.pattern = h.pattern"""
)
def dedup_pattern_merge(t: Tables):
    rules = t.spark.createDataFrame([("banabbes", "adrian", "A. Banabbes", "person"), ("nasazlent", "association", "Nasazlent", "organization")], "pattern string, preferred_token string, fallback_name string, forced_type string")
    return resolve.pattern_merge(t.entities, rules)


def _split(t: Tables):
    e = t.entities.filter("canonical_name is not null").select("id", F.lower("canonical_name").alias("name_key"), N.type_key(F.col("entity_type")).alias("kind"))
    local = e.filter("id % 2 = 1").groupBy("name_key", "kind").agg(F.min("id").alias("local_id"))
    return local, e.filter("id % 2 = 0")


_MAP = f"""WITH e AS (SELECT id, lower(canonical_name) AS n, {KIND.format('entity_type')} AS k FROM entities WHERE canonical_name IS NOT NULL), l AS (SELECT n, k, min(id) AS local_id FROM e WHERE id % 2 = 1 GROUP BY 1, 2), x AS (SELECT * FROM e WHERE id % 2 = 0),
b AS (SELECT n, k, min(id) AS bid FROM x GROUP BY 1, 2), o AS (SELECT n, min(id) AS oid FROM x GROUP BY 1 HAVING count(*) = 1),
m AS (SELECT l.local_id, coalesce(b.bid, CASE WHEN l.k = 'unknown' THEN o.oid END) AS existing_id, CASE WHEN b.bid IS NOT NULL THEN 'name and type' WHEN l.k = 'unknown' AND o.oid IS NOT NULL THEN 'name' ELSE 'new' END AS how FROM l LEFT JOIN b ON b.n = l.n AND b.k = l.k LEFT JOIN o ON o.n = l.n)"""


@query(_MAP + " SELECT local_id, existing_id, how FROM m")
def entity_mapping_two_stage(t: Tables):
    return resolve.map_to_existing(*_split(t))


@query(_MAP + " SELECT local_id, existing_id AS entity_id FROM m WHERE existing_id IS NOT NULL UNION ALL SELECT local_id, (SELECT max(id) FROM x) + row_number() OVER (ORDER BY local_id) FROM m WHERE existing_id IS NULL")
def entity_mapping_new_ids(t: Tables):
    local, existing = _split(t)
    return resolve.new_ids(resolve.map_to_existing(local, existing), existing)


@query("SELECT lower(n.name_as_appears) AS name_key, max(e.id) AS entity_id FROM (SELECT DISTINCT name_as_appears FROM mentions) n LEFT JOIN entities e ON lower(e.canonical_name) = lower(n.name_as_appears) GROUP BY 1")
def match_existing_entities(t: Tables):
    n = t.mentions.select(F.lower("name_as_appears").alias("name_key")).distinct()
    e = t.entities.groupBy(F.lower("canonical_name").alias("name_key")).agg(F.max("id").alias("entity_id")).filter("name_key is not null")
    return n.join(e, "name_key", "left")


@query("SELECT entity_id, count(DISTINCT name_as_appears) AS variants, count(DISTINCT document_id) AS documents, count(*) AS n, first(name_as_appears ORDER BY length(name_as_appears) DESC, name_as_appears DESC) AS longest FROM mentions WHERE name_as_appears IS NOT NULL GROUP BY 1")
def canonical_longest_variant(t: Tables):
    top = F.max(F.struct(F.length("name_as_appears").alias("l"), F.col("name_as_appears").alias("n")))
    return t.mentions.filter("name_as_appears is not null").groupBy("entity_id").agg(F.count_distinct("name_as_appears").alias("variants"), F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("n"), top["n"].alias("longest"))


@query(f"SELECT kind, first(id ORDER BY c DESC, l DESC, id) AS rep_id FROM (SELECT id, {KIND.format('entity_type')} AS kind, coalesce(mention_count, 0) AS c, length(canonical_name) AS l FROM entities WHERE canonical_name IS NOT NULL) GROUP BY 1")
def snapshot_representative(t: Tables):
    e = t.entities.filter("canonical_name is not null").withColumn("kind", N.type_key(F.col("entity_type")))
    return e.groupBy("kind").agg((-F.max(F.struct(F.coalesce("mention_count", F.lit(0)), F.length("canonical_name"), (-F.col("id")).alias("i")))["i"]).alias("rep_id"))


@query(
    """SELECT (SELECT count(*) FROM archive_documents WHERE page_count > 0) AS records, (SELECT coalesce(sum(page_count), 0) FROM archive_documents) AS pages, (SELECT count(DISTINCT m.entity_id) FROM mentions m JOIN archive_documents d ON d.id = m.document_id WHERE d.page_count > 0) AS entities,
    (SELECT to_json(list({'entity_id': entity_id, 'n': n} ORDER BY n DESC, entity_id)) FROM (SELECT entity_id, count(*) AS n FROM mentions GROUP BY 1 ORDER BY n DESC, entity_id LIMIT 20)) AS top_entities"""
)
def records_dashboard(t: Tables):
    d = t.archive_documents
    a = d.agg(F.count_if(F.expr("page_count > 0")).alias("records"), F.coalesce(F.sum("page_count"), F.lit(0)).alias("pages"))
    paged = t.mentions.select("document_id", "entity_id").join(d.filter("page_count > 0").select(F.col("id").alias("document_id")), "document_id").agg(F.count_distinct("entity_id").alias("entities"))
    top = t.mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entity_id").limit(20)
    listed = top.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "entity_id", "n"))).alias("x")).select(F.to_json(F.transform("x", lambda r: F.struct(r["entity_id"].alias("entity_id"), r["n"].alias("n")))).alias("top_entities"))
    return a.crossJoin(paged).crossJoin(listed)


@query(f"SELECT id, {_display_name_sql('canonical_name')} AS name, {_merge_key_sql('canonical_name')} AS key FROM entities WHERE canonical_name IS NOT NULL")
def normalize_names(t: Tables):
    c = F.col("canonical_name")
    return t.entities.filter("canonical_name is not null").select("id", N.display_name(c).alias("name"), N.merge_key(c).alias("key"))


def _junk_sql(c: str) -> str:
    x = f"trim({c})"
    w = rf"list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> '')"
    letters = f"len(regexp_extract_all({x}, '[a-zA-Z]'))"
    shapes = " OR ".join("regexp_matches(" + x + ", '(?i)" + p.replace("'", "''") + "')" for p in N.JUNK_SHAPES)
    return (
        f"(length({x}) < 2 OR length({x}) > 80 OR {letters} = 0 OR {shapes} OR (NOT contains({x}, ' ') AND upper({x}) = {x} AND length({x}) > 5 AND {letters} > 0) OR regexp_matches({x}, '[*•\\[\\]{{}}|\\\\<>\\n]')"
        f" OR (len({w}) > 1 AND len(list_filter({w}, lambda w: length(w) > 2)) = 0) OR (len({w}) = 1 AND lower({x}) = {x} AND {letters} > 0) OR (len({w}) >= 2 AND list_sum(list_transform({w}, lambda w: length(w))) / len({w}) < 3))"
    )


@query(f"SELECT DISTINCT name_as_appears AS name, {_junk_sql('name_as_appears')} AS junk FROM mentions WHERE name_as_appears IS NOT NULL")
def junk_names(t: Tables):
    return t.mentions.filter("name_as_appears is not null").select(F.col("name_as_appears").alias("name")).distinct().withColumn("junk", N.is_junk_name(F.col("name"), backreference=False))


@query()
def casefold_keys(t: Tables):
    return t.entities.select("id", N.fold_key(F.col("canonical_name")).alias("key"))


@query("SELECT lower(role) AS role, count(*) AS n FROM mentions GROUP BY 1")
def roles(t: Tables):
    return t.mentions.groupBy(F.lower("role").alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query()
def ner_stub_mentions(t: Tables):
    from recordspark.operators.extract import capitalised_runs

    return capitalised_runs(t.document_texts)
