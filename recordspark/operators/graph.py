"""Entities that stand together in documents: build, look up, and rebuild on visible records.

Documents with more than ``cap`` entities are left out by definition of the operator
(it is a parameter of the result, not a guard of the engine). The edges are placed by
document once; making them distinct, counting them and the pair join all reuse that
placement, and the pairs' partial counts are combined before their shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.config import MAX_DOC_ENTITIES, MIN_SHARED, TOP_NEIGHBOURS


def cooccurrence_top(mentions: DataFrame, cap: int = MAX_DOC_ENTITIES, least: int = MIN_SHARED, top: int = TOP_NEIGHBOURS) -> DataFrame:
    """Rows (entity_id, other_entity_id, shared_docs): per entity its ``top`` neighbours with ``least`` shared documents."""
    edges = mentions.select("document_id", "entity_id").na.drop().repartition("document_id").distinct()
    kept = edges.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("document_id"))).filter(F.col("n") <= cap)
    a, b = kept.select("document_id", F.col("entity_id").alias("e1")), kept.select("document_id", F.col("entity_id").alias("e2"))
    pairs = a.join(b, "document_id").filter("e1 < e2").groupBy("e1", "e2").agg(F.count(F.lit(1)).alias("shared_docs")).filter(F.col("shared_docs") >= least)
    both = pairs.select(F.explode(F.array(F.struct(F.col("e1").alias("entity_id"), F.col("e2").alias("other_entity_id")), F.struct(F.col("e2").alias("entity_id"), F.col("e1").alias("other_entity_id")))).alias("p"), "shared_docs")
    both = both.select("p.entity_id", "p.other_entity_id", "shared_docs")
    rank = F.row_number().over(W.partitionBy("entity_id").orderBy(F.desc("shared_docs"), "other_entity_id"))
    return both.withColumn("rn", rank).filter(F.col("rn") <= top).drop("rn")


def neighbours(graph: DataFrame, entities: DataFrame, entity_id: int, entity_type: str | None = None) -> DataFrame:
    """An entity's neighbours with their names, most shared documents first."""
    hit = graph.filter(F.col("entity_id") == entity_id).join(entities.select(F.col("id").alias("other_entity_id"), "canonical_name", "entity_type", "mention_count"), "other_entity_id")
    if entity_type is not None:
        hit = hit.filter(F.lower("entity_type") == entity_type.lower())
    return hit.select("other_entity_id", "shared_docs", "canonical_name", "entity_type", "mention_count").orderBy(F.desc("shared_docs"), "other_entity_id")
