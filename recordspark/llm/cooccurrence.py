"""Problem 7: items that appear together, by the stripes method.

``cooccurrence`` counts, for every pair of items, the records both stand in.
Each task keeps, per item, an associative array of its neighbours (a stripe) and
emits it once; the stripes of one item meet in one task, which merges them, and the
log-likelihood ratio tells which pairs are significant. Rows with a null
record or item are ignored; repeated rows count once; empty input gives no rows.

Scale: the (record, item) pairs are made distinct once, with map-side combine.
Two bounds prune items without losing a pair, because n12 <= min(n1, n2): an item
in fewer than ``min_support`` records, and, with ``min_lift`` L, an item in more
than n / L records (n12 * n >= L * n1 * n2 needs n >= L * n1). A record with more
than ``block`` surviving items is cut into blocks, and block pairs are counted
by different tasks. The stripes of a hot item, one with ``hot`` of all rows, are cut by
neighbour, and the cuts merged by different tasks; there are at most 1 / ``hot`` such items.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordspark.session import cut

FLUSH = 2_000_000


def _merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, weights=np.concatenate(counts)).astype(np.int64)


def _stripes(batches, cuts: dict[int, int]):
    """Rows (left items, right items or null) to rows (item, cut, neighbours, counts); ``cuts`` has the hot items' numbers of cuts."""
    index: dict[int, int] = {}
    ids: list[int] = []

    def number(values) -> np.ndarray:
        out = np.empty(len(values), np.int64)
        for k, v in enumerate(values):
            at = index.get(v)
            if at is None:
                at = index[v] = len(ids)
                ids.append(v)
            out[k] = at
        return out

    codes: list[np.ndarray] = []
    counts: list[np.ndarray] = []
    held = 0
    for pdf in batches:
        for left, right in zip(pdf["lefts"], pdf["rights"]):
            a = number(left.tolist())
            if right is None or len(right) == 0:
                i, j = np.triu_indices(len(a), 1)
                x, y = a[i], a[j]
            else:
                b = number(right.tolist())
                x, y = np.repeat(a, len(b)), np.tile(b, len(a))
            codes.append((x << 32) | y)
            counts.append(np.ones(len(x), np.int64))
            held += len(x)
            if held > FLUSH:
                code, count = _merge(codes, counts)
                if len(code) > FLUSH // 2:
                    yield _emit(code, count, ids, cuts)
                    codes, counts, held = [], [], 0
                else:
                    codes, counts, held = [code], [count], len(code)
    if codes:
        yield _emit(*_merge(codes, counts), ids, cuts)


def _emit(code: np.ndarray, count: np.ndarray, ids: list[int], cuts: dict[int, int]) -> pd.DataFrame:
    table = np.array(ids, np.int64)
    parts = np.array([cuts.get(v, 1) for v in ids], np.int64)
    x, y = code >> 32, code & 0xFFFFFFFF
    x, y = np.where(table[x] <= table[y], x, y), np.where(table[x] <= table[y], y, x)
    low, high = table[x], table[y]
    cut_no = high % parts[x] if len(x) else high
    order = np.lexsort((high, cut_no, low))
    low, high, count, cut_no = low[order], high[order], count[order], cut_no[order]
    ends = np.flatnonzero((np.diff(low) != 0) | (np.diff(cut_no) != 0)) + 1
    heads = np.concatenate([[0], ends]) if len(low) else np.array([], int)
    return pd.DataFrame({"item": low[heads], "cut": cut_no[heads], "neighbours": np.split(high, ends) if len(low) else [], "counts": np.split(count, ends) if len(low) else []})


def _merged(batches, least: int):
    """Stripes sorted by (item, cut) to pairs (item_1, item_2, n12) with n12 >= ``least``."""
    held: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    last = None

    def summed(item, other, n):
        order = np.lexsort((other, item))
        item, other, n = item[order], other[order], n[order]
        heads = np.concatenate([[0], np.flatnonzero((np.diff(item) != 0) | (np.diff(other) != 0)) + 1])
        return item[heads], other[heads], np.add.reduceat(n, heads)

    def pairs(item, other, n):
        keep = n >= least
        return pd.DataFrame({"item_1": item[keep], "item_2": other[keep], "n12": n[keep]})

    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf["neighbours"].str.len().to_numpy()
        item = np.repeat(pdf["item"].to_numpy(), sizes)
        other, n = np.concatenate(pdf["neighbours"].tolist()), np.concatenate(pdf["counts"].tolist())
        key = list(zip(pdf["item"].tolist(), pdf["cut"].tolist()))
        if held is not None and key[0] != last:
            yield pairs(*held)
            held = None
        # the last stripe may go on in the next batch
        last = key[-1]
        begin = len(key) - 1
        while begin and key[begin - 1] == last:
            begin -= 1
        at = int(sizes[:begin].sum())
        done = [(item[:at], other[:at], n[:at])] if at else []
        if held is not None and begin:
            done.append(held)
            held = None
        if done:
            yield pairs(*summed(*(np.concatenate(x) for x in zip(*done))))
        open_ = [(item[at:], other[at:], n[at:])] + ([held] if held is not None else [])
        held = summed(*(np.concatenate(x) for x in zip(*open_)))
    if held is not None:
        yield pairs(*held)


def _entropy(*cells: Column) -> Column:
    total = sum(cells[1:], cells[0])
    h = lambda x: F.when(x > 0, x * F.log(x)).otherwise(F.lit(0.0))
    return h(total) - sum((h(c) for c in cells[1:]), h(cells[0]))


def log_likelihood_ratio(n12: Column, n1: Column, n2: Column, n: Column) -> Column:
    """Dunning's G2 of the two-by-two table of a pair."""
    k11, k12, k21 = (x.cast("double") for x in (n12, n1 - n12, n2 - n12))
    k22 = (n - n1 - n2 + n12).cast("double")
    rows, columns = _entropy(k11 + k12, k21 + k22), _entropy(k11 + k21, k12 + k22)
    return F.greatest(F.lit(0.0), 2 * (rows + columns - _entropy(k11, k12, k21, k22)))


def cooccurrence(rows: DataFrame, record: str, item: str, min_support: int = 5, min_lift: float = 3.0, block: int = 512, min_llr: float = 10.83, hot: float = 1e-4) -> DataFrame:
    """Pairs (item_1 < item_2, n12, n1, n2, n, lift, llr, significant) with n12 >= min_support and n12 * n >= min_lift * n1 * n2.

    ``significant`` tells that llr is at least ``min_llr`` (10.83: one such pair in a thousand by chance).
    """
    pairs = cut(rows.select(F.col(record).cast("bigint").alias("record"), F.col(item).cast("bigint").alias("item")).filter("record is not null").distinct())
    n = pairs.agg(F.count_distinct("record")).first()[0]
    pairs = pairs.filter("item is not null")
    single = pairs.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).filter((F.col("n_item") >= min_support) & (F.col("n_item") * F.lit(float(min_lift)) <= F.lit(float(n))))
    kept = pairs.join(single.select("item"), "item")
    sizes = kept.groupBy("record").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    placed = kept.join(sizes.select("record", "blocks"), "record").withColumn("b", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")))
    placed = placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    own = F.col("b") <= F.col("p")
    baskets = placed.groupBy("record", F.least("b", "p").alias("b1"), F.greatest("b", "p").alias("b2")).agg(
        F.collect_list(F.when(own, F.col("item"))).alias("lefts"), F.collect_list(F.when(~own, F.col("item"))).alias("rights")
    )
    # of two different blocks only pairs across are counted here; one that has no partner has none
    baskets = baskets.filter((F.col("b1") == F.col("b2")) | ((F.size("lefts") > 0) & (F.size("rights") > 0)))
    # items with `hot` of all rows, at most 1 / hot of them, are cut so that each cut has about so much
    many = max(1.0, hot * float(pairs.count()))
    cuts = {r["item"]: int(r["cuts"]) for r in single.withColumn("cuts", F.ceil(F.col("n_item") / F.lit(many))).filter("cuts > 1").select("item", "cuts").collect()}
    sent = rows.sparkSession.sparkContext.broadcast(cuts)
    stripes = baskets.select("lefts", "rights").mapInPandas(lambda it: _stripes(it, sent.value), "item bigint, cut bigint, neighbours array<bigint>, counts array<bigint>")
    merged = stripes.repartition("item", "cut").sortWithinPartitions("item", "cut").mapInPandas(lambda it: _merged(it, min_support), "item_1 bigint, item_2 bigint, n12 bigint")
    out = merged.join(single.select(F.col("item").alias("item_1"), F.col("n_item").alias("n1")), "item_1")
    out = out.join(single.select(F.col("item").alias("item_2"), F.col("n_item").alias("n2")), "item_2").withColumn("n", F.lit(n).cast("bigint"))
    out = out.filter(F.col("n12") * F.col("n") >= F.lit(float(min_lift)) * F.col("n1") * F.col("n2"))
    return out.select(
        "item_1", "item_2", "n12", "n1", "n2", "n",
        (F.col("n12") * F.col("n") / (F.col("n1") * F.col("n2"))).alias("lift"),
        log_likelihood_ratio(F.col("n12"), F.col("n1"), F.col("n2"), F.col("n")).alias("llr"),
    ).withColumn("significant", F.col("llr") >= F.lit(float(min_llr)))
