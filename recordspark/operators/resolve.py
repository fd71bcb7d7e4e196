"""Rule-based entity upkeep: type overrides, junk removal, merges, mappings, counters.

Rules are rows, not code: no names are compiled in. Every merge is a mapping table
(old_id, new_id), applied by joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.functions.names import merge_key, type_key
from recordspark.session import cut


def override_types(entities: DataFrame, rules: DataFrame, most_rules: int = 10_000) -> DataFrame:
    """Entities with the type of the first rule (pattern, forced_type) whose pattern their name contains.

    ``rules`` is a hand-written table of at most ``most_rules`` rows; it is matched as a list per entity.
    """
    if rules.limit(most_rules + 1).count() > most_rules:
        raise ValueError(f"more than {most_rules} rules")
    listed = rules.agg(F.sort_array(F.collect_list(F.struct(F.lower("pattern").alias("pattern"), "forced_type"))).alias("rules"))
    name = F.lower("canonical_name")
    out = entities.crossJoin(F.broadcast(listed))
    hit = F.filter("rules", lambda r: F.contains(name, r["pattern"]))
    return out.withColumn("entity_type", F.when(F.size(hit) > 0, F.get(hit, F.lit(0))["forced_type"]).otherwise(F.col("entity_type"))).drop("rules")


def remove_junk(entities: DataFrame, mentions: DataFrame, junk: list[str], least: int = 3) -> tuple[DataFrame, DataFrame]:
    """Entities without listed or too short names, and the mentions of those left."""
    bad = F.lower(F.trim("canonical_name")).isin([j.lower() for j in junk]) | (F.length(F.trim("canonical_name")) < least)
    kept = entities.filter(~F.coalesce(bad, F.lit(True)))
    return kept, mentions.join(kept.select(F.col("id").alias("entity_id")), "entity_id", "left_semi")


def merge_mapping(entities: DataFrame, least: int = 2) -> DataFrame:
    """Rows (old_id, new_id): entities of one merge key go to the one with the longest name, the least id of equals."""
    keyed = entities.select("id", "canonical_name", merge_key(F.col("canonical_name")).alias("key")).filter(F.length("key") >= least)
    best = keyed.groupBy("key").agg(F.max(F.struct(F.length("canonical_name").alias("l"), (-F.col("id")).alias("i"))).alias("m"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return keyed.join(best.select("key", (-F.col("m.i")).alias("new_id")), "key").filter("id <> new_id").select(F.col("id").alias("old_id"), "new_id")


def apply_mapping(mentions: DataFrame, mapping: DataFrame) -> DataFrame:
    """Mentions pointed to the entities that stay."""
    return mentions.join(mapping, mentions["entity_id"] == mapping["old_id"], "left").withColumn("entity_id", F.coalesce("new_id", "entity_id")).drop("old_id", "new_id")


def pattern_merge(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (old_id, new_id, new_name, forced_type) per rule (pattern, preferred_token, fallback_name, forced_type).

    Of the names that contain the pattern the best is clean of odd characters, has the
    preferred token, has a blank, and the least id; without a preferred token it takes the fallback name.
    """
    hit = entities.select("id", "canonical_name").join(rules, F.contains(F.lower("canonical_name"), F.lower("pattern")))
    clean = (~F.col("canonical_name").rlike(r"[^\p{L}\p{N} .,'\-]")).cast("int")
    preferred = F.contains(F.lower("canonical_name"), F.lower("preferred_token")).cast("int")
    ranked = hit.withColumn("q", F.struct(clean.alias("a"), preferred.alias("b"), F.contains("canonical_name", F.lit(" ")).cast("int").alias("c"), (-F.col("id")).alias("d")))
    best = ranked.groupBy("pattern").agg(F.max("q").alias("q"), F.max_by("canonical_name", "q").alias("name"))
    best = best.select("pattern", (-F.col("q.d")).alias("new_id"), F.col("q.b").alias("preferred"), "name")
    out = hit.join(best, "pattern").select(F.col("id").alias("old_id"), "new_id", F.when(F.col("preferred") == 1, F.col("name")).otherwise(F.col("fallback_name")).alias("new_name"), "forced_type")
    return out


def groups(entities: DataFrame) -> DataFrame:
    """Rows (group_key, rep_id, rep_name, kind, total, members): entities of one lower-cased name and type read as one."""
    keyed = entities.select("id", "canonical_name", "mention_count", F.lower("canonical_name").alias("name_key"), type_key(F.col("entity_type")).alias("kind"))
    top = F.max(F.struct(F.coalesce("mention_count", F.lit(0)).alias("m"), (-F.col("id")).alias("i"), F.col("canonical_name").alias("n")))
    g = keyed.groupBy("name_key", "kind").agg(top.alias("t"), F.sum(F.coalesce("mention_count", F.lit(0))).alias("total"), F.count(F.lit(1)).alias("members"))
    return g.select("name_key", "kind", (-F.col("t.i")).alias("rep_id"), F.col("t.n").alias("rep_name"), "total", "members")


def sibling_groups(entities: DataFrame) -> DataFrame:
    """Rows (entity_id, first_sibling, siblings): each entity with the least id of its name and type and their number; no pairs are made."""
    keyed = entities.select(F.col("id").alias("entity_id"), F.lower("canonical_name").alias("name_key"), type_key(F.col("entity_type")).alias("kind")).filter("name_key is not null")
    heads = keyed.groupBy("name_key", "kind").agg(F.min("entity_id").alias("first_sibling"), F.count(F.lit(1)).alias("siblings"))
    return keyed.join(heads, ["name_key", "kind"]).select("entity_id", "first_sibling", "siblings")


def siblings(entities: DataFrame, cap: int | None = None) -> DataFrame:
    """Rows (entity_id, sibling_id): entities of one lower-cased name and type, itself included, the ``cap`` most mentioned."""
    keyed = entities.select("id", F.coalesce("mention_count", F.lit(0)).alias("mention_count"), F.lower("canonical_name").alias("name_key"), type_key(F.col("entity_type")).alias("kind")).filter("name_key is not null")
    other = keyed
    if cap is not None:
        w = W.partitionBy("name_key", "kind").orderBy(F.desc("mention_count"), "id")
        other = keyed.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= cap)
    return keyed.select("name_key", "kind", F.col("id").alias("entity_id")).join(other.select("name_key", "kind", F.col("id").alias("sibling_id")), ["name_key", "kind"]).select("entity_id", "sibling_id")


def map_to_existing(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (local_id, existing_id, how) of local groups (local_id, name_key, kind) among existing rows of the same columns.

    First by name and type; a local group without a type by name, if one existing row has that name; else null.
    """
    both = existing.groupBy("name_key", "kind").agg(F.min("id").alias("by_both"))
    alone = existing.groupBy("name_key").agg(F.min("id").alias("by_name"), F.count(F.lit(1)).alias("n")).filter("n = 1")
    out = new.join(both, ["name_key", "kind"], "left").join(alone.select("name_key", "by_name"), "name_key", "left")
    found = F.coalesce("by_both", F.when(F.col("kind") == "unknown", F.col("by_name")))
    how = F.when(F.col("by_both").isNotNull(), "name and type").when(found.isNotNull(), "name").otherwise("new")
    return out.select("local_id", found.alias("existing_id"), how.alias("how"))


def new_ids(mapped: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows (local_id, entity_id): unmapped groups get ids above the greatest existing one, in order of local id.

    Numbers come from counts per range partition, fixed by a checkpoint, so no single task orders all rows.
    """
    top = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    fresh = cut(mapped.filter("existing_id is null").select("local_id").repartitionByRange("local_id").withColumn("part", F.spark_partition_id()))
    sizes = fresh.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    begin = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("begin"))
    numbered = fresh.join(begin, "part").withColumn("rn", F.row_number().over(W.partitionBy("part").orderBy("local_id")) + F.col("begin"))
    fresh = numbered.crossJoin(F.broadcast(top)).select("local_id", (F.col("top") + F.col("rn")).alias("entity_id"))
    return mapped.filter("existing_id is not null").select("local_id", F.col("existing_id").alias("entity_id")).unionByName(fresh)


def refreshed_counts(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows (id, mention_count) as the mentions have it."""
    n = mentions.groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return entities.select("id").join(n, F.col("id") == F.col("entity_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("mention_count"))


def extend_entities(found: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spans (document_id, name, kind) merged into existing entities: (links document_id, entity_id, n; entities to add).

    A name is an entity's if its lower-cased canonical name is equal, the greatest id of
    equals; the others become new entities with ids above the greatest existing one.
    """
    named = found.select("document_id", F.lower("name").alias("name_key"), "name", "kind").filter("name_key is not null")
    held = entities.groupBy(F.lower("canonical_name").alias("name_key")).agg(F.max("id").alias("existing_id")).filter("name_key is not null")
    groups_ = named.groupBy("name_key").agg(F.max(F.struct(F.length("name").alias("l"), "name"))["name"].alias("canonical_name"), F.min("kind").alias("entity_type"), F.xxhash64("name_key").alias("local_id"))
    mapped = groups_.join(held, "name_key", "left")
    ids = new_ids(mapped.select("local_id", "existing_id"), entities.select("id"))
    placed = mapped.join(ids, "local_id")
    links = named.join(placed.select("name_key", "entity_id"), "name_key").groupBy("document_id", "entity_id").agg(F.count(F.lit(1)).alias("n"))
    return links, placed.filter("existing_id is null").select(F.col("entity_id").alias("id"), "canonical_name", "entity_type")
