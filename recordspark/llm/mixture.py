"""Problem 9: mixing sources to target weights, as a time-varying curriculum.

Sizes are tokens of a public tokenizer (``tokenizer``: path of a tiktoken rank file,
the same on every executor). The mixture is as large as it can be while every source
gives its target share without exceeding its cap of repeats; shares of sources
without documents are spread over the others in proportion.

Each source has a weight schedule over training time 0..1, linear between knots.
Integrated, it gives the source's cumulative token demand; a document copy that
begins at the c-th token of its source is assigned the time at which the demand
reaches c. Copies are then range-sorted by that time.

Cumulative tokens of a source are prefix sums over hash buckets and, within a
bucket, over its documents, so that no source is summed up in one task. Only one row
per target source reaches the driver.

Null ids, and texts that are null, empty or without tokens, take no part. Repeated
rows of an id count once. Sources without a target take no part; a target without a
share or with a cap of 0 gets nothing. Empty tables give an empty mixture.
"""

from __future__ import annotations

import base64
from collections.abc import Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.session import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published split pattern of the byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, source, tokens), one per id, of documents with any token."""

    def count(batches):
        encode = encoding(tokenizer).encode_ordinary
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(t)) for t in pdf["text"].tolist()]})

    base = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text")).filter("doc_id is not null and source is not null and text <> ''")
    return base.mapInPandas(count, "doc_id bigint, source string, tokens bigint").filter("tokens > 0").groupBy("doc_id").agg(F.max(F.struct("tokens", "source")).alias("m")).select("doc_id", "m.source", "m.tokens")


def plan(targets: Sequence[tuple[str, float, int]], held: dict[str, int]) -> dict[str, tuple[float, int]]:
    """Per source with documents: (share within the mixture, tokens demanded)."""
    usable = {s: (w, r) for s, w, r in targets if s is not None and w and w > 0 and r and r > 0 and held.get(s, 0) > 0}
    total = sum(w for w, _ in usable.values())
    if not usable:
        return {}
    size = min(r * held[s] / (w / total) for s, (w, r) in usable.items())
    return {s: (w / total, int(w / total * size)) for s, (w, _) in usable.items()}


def tilted(shares: dict[str, float], tilt: float = 0.5) -> dict[str, list[tuple[float, float]]]:
    """A schedule (time, weight) per source that sums to 1 at all times: the larger half by share falls, the rest rises."""
    order = sorted(shares, key=lambda s: (-shares[s], s))
    falling, total = [], 0.0
    for s in order:
        if total + shares[s] > 0.5 and falling:
            break
        falling.append(s)
        total += shares[s]
    rest = 1 - total
    rise = tilt * total / rest if rest > 1e-9 else 0.0
    down = tilt if rest > 1e-9 else 0.0
    scale = min(1.0, 1.0 / rise) if rise > 1 else 1.0
    return {s: [(0.0, w * (1 + down * scale)), (1.0, w * (1 - down * scale))] if s in falling else [(0.0, w * (1 - rise * scale)), (1.0, w * (1 + rise * scale))] for s, w in shares.items()}


def _segments(knots: list[tuple[float, float]], demand: int) -> list[tuple[float, float, float, float, float]]:
    """(begin time, length, weight at begin, slope, tokens before), the integral scaled to the demand."""
    area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    scale = demand / area if area > 0 else 0.0
    out, done = [], 0.0
    for a, b in zip(knots, knots[1:]):
        h = b[0] - a[0]
        if h <= 0:
            continue
        out.append((a[0], h, a[1] * scale, (b[1] - a[1]) * scale / h, done))
        done += h * (a[1] + b[1]) / 2 * scale
    return out


def mixture(documents: DataFrame, targets: DataFrame, schedule: dict[str, list[tuple[float, float]]] | None = None, seed: int = 11, bucket_rows: int = 50_000, tokenizer: str = TOKENIZER) -> DataFrame:
    """Rows (doc_id, source, copy, tokens, position), range-sorted by position in 0..1.

    Documents are summed up in hash buckets of about ``bucket_rows``, whose number follows the corpus.
    """
    spark = documents.sparkSession
    sized = cut(token_counts(documents, tokenizer=tokenizer))
    bits = max(4, (sized.count() // bucket_rows).bit_length() + 2)
    wanted = [(r["source"], r["share"], r["repeats"]) for r in targets.groupBy("source").agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).collect()]
    held = {r["source"]: r["n"] for r in sized.join(targets.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    planned = plan(wanted, held)
    knots = schedule or tilted({s: w for s, (w, _) in planned.items()})
    rows = [(s, held[s], d, *seg) for s, (_, d) in planned.items() for seg in _segments(knots[s], d)]
    columns = "source string, held bigint, demand bigint, t0 double, h double, w0 double, slope double, before double"
    segments = spark.createDataFrame(rows, columns)
    sources = segments.groupBy("source", "held", "demand").agg(F.sort_array(F.collect_list(F.struct("before", "t0", "h", "w0", "slope"))).alias("segments"))

    order = F.xxhash64("doc_id", F.lit(seed))
    placed = sized.join(sources, "source").withColumns({"h": order, "bucket": F.shiftrightunsigned(order, 64 - bits)})
    sums = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("n"))
    base = sums.select("source", "bucket", (F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n")).alias("base"))
    within = W.partitionBy("source", "bucket").orderBy("h", "doc_id")
    begun = placed.join(base, ["source", "bucket"]).withColumn("begin", F.col("base") + F.sum("tokens").over(within) - F.col("tokens"))
    # of the copies, those that begin before the demand is met; the last is taken if most of it is wanted
    first = F.col("begin") + F.col("tokens") / 2
    copies = F.when(first < F.col("demand"), F.floor((F.col("demand") - first) / F.col("held")) + 1).otherwise(0).cast("int")
    taken = begun.withColumn("copies", copies).filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    taken = taken.withColumn("c", (F.col("begin") + (F.col("copy") - 1) * F.col("held")).cast("double"))
    seg = F.element_at(F.filter("segments", lambda s: s["before"] <= F.col("c")), -1)
    taken = taken.withColumn("s", seg)
    rest = F.col("c") - F.col("s.before")
    a, b = F.col("s.slope") / 2, F.col("s.w0")
    root = F.sqrt(F.greatest(F.lit(0.0), b * b + 4 * a * rest))
    x = F.when((b + root) > 0, 2 * rest / (b + root)).otherwise(0.0)
    out = taken.select("doc_id", "source", "copy", "tokens", F.round(F.least(F.lit(1.0), F.col("s.t0") + F.least(x, F.col("s.h"))), 9).alias("position"))
    return out.repartitionByRange("position", "source", "doc_id", "copy").sortWithinPartitions("position", "source", "doc_id", "copy")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target, tokens, actual share, distinct documents, copies, most copies of a document."""
    per = mixed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_distinct("doc_id").alias("documents"), F.count(F.lit(1)).alias("copies"), F.max("copy").alias("most_copies"))
    total = per.agg(F.sum("tokens").alias("all_tokens"))
    wanted = targets.groupBy("source").agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    joined = wanted.join(per, "source", "left").join(F.broadcast(total), F.lit(True), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "source", "target_share", "max_repeats", zero("tokens").alias("tokens"), F.round(zero(F.col("tokens") / F.col("all_tokens")), 6).alias("actual_share"), zero("documents").alias("documents"), zero("copies").alias("copies"), zero("most_copies").alias("most_copies")
    )
