"""Full-text search over a derived postings table: build, sync, match, rank, snippet.

The index is two tables: postings (term, document_id, pos) and lengths (document_id,
tokens). Written, postings are partitioned by a hash bucket of the term and sorted by
term, so that a query reads only its terms' buckets; queries never explode the corpus
again. A query's phrases are matched in one pass over its terms' postings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.config import BM25_B, BM25_FLOOR, BM25_K1
from recordspark.functions.text import TOKEN, fold, tokens
from recordspark.session import cut

BUCKETS = 64  # of a log of batches, whose final size nobody knows
PER_BUCKET = 5_000_000  # tokens in a bucket of a written index


def build_postings(texts: DataFrame, key: str = "document_id", text: str = "full_text") -> DataFrame:
    """Rows (term, document_id, pos); blank texts are not indexed."""
    base = texts.select(F.col(key).alias("document_id"), F.col(text).alias("t")).filter("trim(t) <> ''")
    return base.select("document_id", F.posexplode(tokens(F.col("t"))).alias("pos", "term")).select("term", "document_id", "pos")


def lengths(texts: DataFrame, key: str = "document_id", text: str = "full_text") -> DataFrame:
    """Rows (document_id, tokens) of the indexed texts."""
    base = texts.select(F.col(key).alias("document_id"), F.col(text).alias("t")).filter("trim(t) <> ''")
    return base.select("document_id", F.size(tokens(F.col("t"))).alias("tokens"))


def _bucket(term, buckets: int):
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _write_postings(postings: DataFrame, path: str, buckets: int, dynamic: bool = False) -> None:
    p = postings.withColumns({"buckets": F.lit(buckets), "bucket": _bucket("term", buckets)})
    # ranged by document within a term, so that a long list lies in several files and tasks
    p = p.repartitionByRange("bucket", "term", "document_id").sortWithinPartitions("bucket", "term", "document_id", "pos")
    p.write.mode("overwrite").option("partitionOverwriteMode", "dynamic" if dynamic else "static").partitionBy("buckets", "bucket").parquet(f"{path}/postings")


def write_index(texts: DataFrame, path: str, key: str = "document_id", text: str = "full_text", per_bucket: int = PER_BUCKET) -> None:
    """Full rebuild of the index under ``path``; the number of buckets follows the number of tokens. Lengths come last."""
    base = texts.select(F.col(key).alias("document_id"), F.col(text).alias("t")).filter("trim(t) <> ''")
    held = cut(base.select("document_id", tokens(F.col("t")).alias("w")))  # texts are cut into tokens once
    sizes = held.select("document_id", F.size("w").alias("tokens"))
    buckets = max(1, -(-int(sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]) // per_bucket))
    _write_postings(held.select("document_id", F.posexplode("w").alias("pos", "term")).select("term", "document_id", "pos"), path, buckets)
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")


def read_postings(spark, path: str, terms: list[str] | None = None) -> DataFrame:
    p = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        row = p.select("buckets").first()
        listed = spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in terms])).alias("t")).select(_bucket("t", row["buckets"] if row else 1).alias("b")).distinct()
        p = p.filter(F.col("bucket").isin([r["b"] for r in listed.collect()]) & F.col("term").isin(terms))
    return p.select("term", "document_id", "pos")


def read_lengths(spark, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/lengths").select("document_id", "tokens")


def update_index(spark, path: str, changed: DataFrame, before: DataFrame, key: str = "document_id", text: str = "full_text") -> None:
    """Replace the changed documents' entries in a written index; only the buckets of their old and new terms are written again.

    ``before`` holds the texts that were indexed for them, whose terms tell the buckets that hold them.
    """
    held = spark.read.parquet(f"{path}/postings")
    buckets = held.select("buckets").first()["buckets"]
    ids = changed.select(F.col(key).alias("document_id")).distinct()
    new = build_postings(changed, key, text)
    touched = new.select("term").unionAll(build_postings(before, key, text).join(ids, "document_id", "left_semi").select("term")).select(_bucket("term", buckets).alias("bucket")).distinct()
    numbers = [r["bucket"] for r in touched.collect()]  # at most all buckets
    kept = held.filter(F.col("bucket").isin(numbers)).select("term", "document_id", "pos").join(ids, "document_id", "left_anti")
    _write_postings(cut(kept.select("term", "document_id", "pos").unionByName(new)), path, buckets, dynamic=True)
    sizes = cut(read_lengths(spark, path).join(ids, "document_id", "left_anti").unionByName(lengths(changed, key, text)))
    sizes.write.mode("overwrite").parquet(f"{path}/lengths")


def sync_postings(postings: DataFrame, changed: DataFrame, key: str = "document_id", text: str = "full_text") -> DataFrame:
    """Postings with the changed documents' entries replaced (or gone, where their text is blank)."""
    kept = postings.join(changed.select(F.col(key).alias("document_id")).distinct(), "document_id", "left_anti")
    return kept.unionByName(build_postings(changed, key, text))


def phrase_hits(postings: DataFrame, alternatives: list[list[tuple[str, ...]]]) -> DataFrame:
    """Rows (phrase, document_id, tf); a phrase counts once per starting place."""
    phrases = sorted({p for alt in alternatives for p in alt})
    places: dict[str, list[tuple[int, int]]] = {}
    for n, p in enumerate(phrases):
        for k, t in enumerate(p):
            places.setdefault(t, []).append((n, k))
    wanted = F.create_map(*[x for t, at in places.items() for x in (F.lit(t), F.array(*[F.struct(F.lit(n).alias("phrase"), F.lit(k).alias("offset")) for n, k in at]))])
    need = F.create_map(*[x for n, p in enumerate(phrases) for x in (F.lit(n), F.lit(len(p)))])
    hit = postings.filter(F.col("term").isin(list(places))).select("document_id", "pos", F.explode(F.element_at(wanted, F.col("term"))).alias("w"))
    starts = hit.groupBy(F.col("w.phrase").alias("phrase"), "document_id", (F.col("pos") - F.col("w.offset")).alias("start")).agg(F.count_distinct("w.offset").alias("k"))
    return starts.filter(F.col("k") == F.element_at(need, F.col("phrase"))).groupBy("phrase", "document_id").agg(F.count(F.lit(1)).alias("tf"))


def _satisfied(alternatives, phrases):
    number = {p: n for n, p in enumerate(phrases)}
    out = F.lit(False)
    for alt in alternatives:
        every = F.lit(True)
        for p in set(alt):
            every = every & F.array_contains("phrases", F.lit(number[p]))
        out = out | every
    return out


def match(postings: DataFrame, alternatives: list[list[tuple[str, ...]]]) -> DataFrame:
    """document_id of every document that fulfils one of the alternatives."""
    phrases = sorted({p for alt in alternatives for p in alt})
    held = phrase_hits(postings, alternatives).groupBy("document_id").agg(F.collect_set("phrase").alias("phrases"))
    return held.filter(_satisfied(alternatives, phrases)).select("document_id")


def bm25(postings: DataFrame, sizes: DataFrame, alternatives: list[list[tuple[str, ...]]]) -> DataFrame:
    """Rows (document_id, score) of the matches; the least score is the best.

    Inverse frequencies count phrases over all indexed documents; the three corpus
    figures come as one row, read by every task.
    """
    phrases = sorted({p for alt in alternatives for p in alt})
    hits = phrase_hits(postings, alternatives)
    figures = sizes.agg(F.count(F.lit(1)).alias("docs"), F.avg("tokens").alias("avg_tokens"))
    n = hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n"))
    idf = F.greatest(F.log((F.col("docs") - F.col("n") + 0.5) / (F.col("n") + 0.5)), F.lit(BM25_FLOOR))
    part = idf * F.col("tf") * (BM25_K1 + 1) / (F.col("tf") + BM25_K1 * (1 - BM25_B + BM25_B * F.col("tokens") / F.col("avg_tokens")))
    scored = hits.join(F.broadcast(n), "phrase").join(sizes, "document_id").crossJoin(F.broadcast(figures)).withColumn("part", part)
    out = scored.groupBy("document_id").agg(F.collect_set("phrase").alias("phrases"), (-F.sum("part")).alias("score"))
    return out.filter(_satisfied(alternatives, phrases)).select("document_id", "score")


def snippet_window(postings: DataFrame, alternatives: list[list[tuple[str, ...]]], size: int = 32) -> DataFrame:
    """Rows (document_id, first_pos, hits): the window of ``size`` tokens that holds most query terms, the earliest of equals."""
    terms = sorted({t for alt in alternatives for p in alt for t in p})
    at = postings.filter(F.col("term").isin(terms))
    spans = at.select("document_id", F.explode(F.sequence(F.greatest(F.col("pos") - size + 1, F.lit(0)), F.col("pos"))).alias("first_pos"))
    counted = spans.groupBy("document_id", "first_pos").agg(F.count(F.lit(1)).alias("hits"))
    return counted.groupBy("document_id").agg(F.max(F.struct(F.col("hits"), (-F.col("first_pos")).alias("back"))).alias("m")).select("document_id", (-F.col("m.back")).alias("first_pos"), F.col("m.hits").alias("hits"))


def snippet_text(texts: DataFrame, windows: DataFrame, alternatives: list[list[tuple[str, ...]]], size: int = 32, key: str = "document_id", text: str = "full_text") -> DataFrame:
    """Rows (document_id, snippet): each window's tokens as they stand, query terms marked >>>term<<<, dots where text was left out."""
    terms = sorted({t for alt in alternatives for p in alt for t in p})
    x = texts.select(F.col(key).alias("document_id"), F.regexp_extract_all(F.col(text), F.lit(TOKEN), F.lit(0)).alias("w")).join(windows.select("document_id", "first_pos"), "document_id")
    marked = F.transform(F.slice("w", F.col("first_pos") + 1, F.lit(size)), lambda t: F.when(fold(t).isin(terms), F.concat(F.lit(">>>"), t, F.lit("<<<"))).otherwise(t))
    return x.select("document_id", F.concat(F.when(F.col("first_pos") > 0, "...").otherwise(""), F.array_join(marked, " "), F.when(F.col("first_pos") + size < F.size("w"), "...").otherwise("")).alias("snippet"))


def index_consistency(texts: DataFrame, indexed: DataFrame) -> DataFrame:
    """One row: text rows, indexed rows, missing from the index, orphans in it, ok."""
    t = texts.filter("trim(full_text) <> ''").select("document_id").distinct()
    i = indexed.select("document_id").distinct()
    both = t.withColumn("t", F.lit(1)).join(i.withColumn("i", F.lit(1)), "document_id", "full_outer")
    row = both.agg(F.count("t").alias("text_rows"), F.count("i").alias("index_rows"), F.count_if(F.expr("t is not null and i is null")).alias("missing"), F.count_if(F.expr("t is null and i is not null")).alias("orphans"))
    return row.withColumn("ok", (F.col("missing") == 0) & (F.col("orphans") == 0))
