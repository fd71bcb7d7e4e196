"""Problem 8: evaluation texts leaking into training text, by winnowing.

Test items are the stated query set; they are taken in blocks of bounded size
(``block_chars`` of item text, measured first), each block against all documents.
Both sides keep the least hash of every window of ``window`` consecutive k-grams
of ``k`` words, so every shared run of window + k - 1 words yields a common
fingerprint. With k = 4 and window = 3 a span of 20 words in which two differ
still holds a run of 6 words, which is the guarantee needed here. Every diagonal with
such a run, or with two common fingerprints, is extended to a word alignment; a document counts
if ``min_words`` consecutive words of the item stand in it with at most one word
in ten different.

Words are runs of letters and digits, lower-cased; apostrophes and quote marks are
dropped. Leading sentences that several items share (instructions) are left out
of the items. Null or empty texts match nothing; repeated rows give one row.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
MARKS = "'’‘`´\u00ad"
CHUNK = 256
BASE = np.uint64(0x9E3779B97F4A7C15)
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def words(text: str) -> list[str]:
    text = text.lower()
    for mark in MARKS:
        if mark in text:
            text = text.replace(mark, "")
    return WORD.findall(text)


def shared_openings(texts: list[str], least_words: int = 5) -> set[tuple[str, ...]]:
    """First sentences, as words, that open two or more items."""
    firsts = Counter(tuple(words(re.split(r"(?<=[.:?!])\s", t.strip(), maxsplit=1)[0])) for t in texts)
    return {f for f, n in firsts.items() if n > 1 and len(f) >= least_words}


def without_opening(item_words: list[str], openings: set[tuple[str, ...]]) -> list[str]:
    for f in openings:
        if tuple(item_words[: len(f)]) == f:
            return item_words[len(f) :]
    return item_words


def _grams(ids: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash per k-gram; TOP where a word is unknown (id -1)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    for j in range(k):
        part = ids[j : j + n]
        bad |= part < 0
        h = (h ^ part.astype(np.uint64)) * BASE
        h ^= h >> np.uint64(29)
    h[bad] = TOP
    return h


def winnow(h: np.ndarray, window: int) -> np.ndarray:
    """Positions of the least hash of each window (the rightmost of equals)."""
    if len(h) == 0:
        return np.empty(0, np.int64)
    if len(h) < window:
        return np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    view = np.lib.stride_tricks.sliding_window_view(h, window)
    at = np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)
    keep = np.ones(len(at), bool)
    keep[1:] = at[1:] != at[:-1]
    return at[keep]


def _span(equal: np.ndarray, least: int) -> int:
    """Length of the longest window of at least ``least`` whose share of hits is 0.9 or more; 0 if none."""
    n = len(equal)
    if n < least:
        return 0
    total = np.concatenate([[0], np.cumsum(equal)])
    best = 0
    if total[-1] * 10 < 9 * least:
        return 0
    for length in range(least, min(n, 2 * least - 1) + 1):
        if int((total[length:] - total[:-length]).max()) * 10 >= 9 * length:
            best = length
    if best == 0:
        return 0
    for length in range(n, best, -1):  # the longest, for the report
        if int((total[length:] - total[:-length]).max()) * 10 >= 9 * length:
            return length
    return best


class Index:
    """Fingerprints of one block of items."""

    def __init__(self, items: list[tuple[int, list[str]]], k: int, window: int):
        self.vocabulary: dict[str, int] = {}
        self.k, self.window = k, window
        self.items: list[tuple[int, np.ndarray]] = []
        hashes, owner, at = [], [], []
        for n, (item, item_words) in enumerate(items):
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in item_words], np.int64)
            self.items.append((item, ids))
            h = _grams(ids, k)
            p = winnow(h, window)
            hashes.append(h[p])
            owner.append(np.full(len(p), n))
            at.append(p)
        # the items laid end to end, apart by a mark that no text has
        apart = np.full(k + window, -2, np.int64)
        self.flat = np.concatenate([apart, *(x for _, ids in self.items for x in (ids, apart))])
        self.begins = len(apart) + np.concatenate([[0], np.cumsum([len(ids) + len(apart) for _, ids in self.items])[:-1]]).astype(np.int64) if self.items else np.empty(0, np.int64)
        h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.hashes = h[order]
        self.owner = np.concatenate(owner)[order] if owner else np.empty(0, np.int64)
        self.at = np.concatenate(at)[order] if at else np.empty(0, np.int64)

    def search(self, texts: list[str], least: int) -> list[tuple[int, int, int, int]]:
        """(place of the text, item, matched span in words, item length) of every item found in some texts.

        The texts are laid end to end, apart by unknown words, so that hashing,
        winnowing and the lookup run once over all their words.
        """
        get, apart = self.vocabulary.get, [-1] * (self.k + self.window)
        flat: list[int] = []
        begins = np.empty(len(texts) + 1, np.int64)
        for n, t in enumerate(texts):
            begins[n] = len(flat)
            flat += [get(w, -1) for w in words(t)]
            flat += apart
        begins[-1] = len(flat)
        ids = np.array(flat, np.int64)
        h = _grams(ids, self.k)
        p = winnow(h, self.window)
        p = p[h[p] != TOP]
        low = np.searchsorted(self.hashes, h[p], "left")
        high = np.searchsorted(self.hashes, h[p], "right")
        hit = high > low
        p, low, high = p[hit], low[hit], high[hit]
        if len(p) == 0:
            return []
        count = high - low
        where = np.repeat(p, count)
        rows = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, at = self.owner[rows], self.at[rows]
        # one text and one diagonal of one item have one key: the text is told by the hit's own place
        longest = max(len(i) for _, i in self.items) + 1
        reach = len(ids) + 1 + longest
        key = ((np.searchsorted(begins, where, "right") - 1) * len(self.items) + owner) * reach + (where - at + longest)
        diagonals, n = np.unique(key, return_counts=True)
        # one hit is enough where it stands in a run of window + k - 1 words, as every span sought has one
        place, run = self.begins[owner] + at, np.full(len(where), self.k)
        for step in (-1, 1):
            ok = np.ones(len(where), bool)
            for j in range(1, self.window):
                far = j if step > 0 else -j
                edge = self.k - 1 if step > 0 else 0
                ok &= self.flat[place + edge + far] == ids[where + edge + far]
                run += ok
        keep = (n >= 2) | np.isin(diagonals, key[run >= self.window + self.k - 1])
        found: dict[tuple[int, int], int] = {}
        for one in diagonals[keep].tolist():
            pair, d = divmod(one, reach)
            t, o = divmod(pair, len(self.items))
            d -= longest
            item_ids = self.items[o][1]
            if found.get((t, o), 0) == len(item_ids):
                continue
            start, end = int(begins[t]), int(begins[t + 1])
            span = self._align(ids[start:end], item_ids, d - start, least)
            if span > found.get((t, o), 0):
                found[t, o] = span
        return [(t, self.items[o][0], s, len(self.items[o][1])) for (t, o), s in found.items()]

    @staticmethod
    def _align(ids: np.ndarray, item: np.ndarray, d: int, least: int) -> int:
        low, high = max(0, -d), min(len(item), len(ids) - d)
        equal = np.zeros(len(item), bool)
        if high > low:
            equal[low:high] = ids[low + d : high + d] == item[low:high]
        span = _span(equal, least)
        if span:
            return span
        if equal.sum() * 10 < 3 * least:
            return 0
        # a word lost or added shifts the diagonal: align the neighbourhood
        a, b = max(0, d - 8), min(len(ids), d + len(item) + 8)
        if not _span(np.isin(item, ids[a:b]), least):  # words that stand there at all, whatever their order
            return 0
        equal = np.zeros(len(item), bool)
        for m in SequenceMatcher(None, ids[a:b].tolist(), item.tolist(), autojunk=False).get_matching_blocks():
            if m.size >= 2:
                equal[m.b : m.b + m.size] = True
        return _span(equal, least)


def leaked(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 4, window: int = 3, min_words: int = 20, block_chars: int = 8_000_000) -> DataFrame:
    """Rows (doc_id, item_id, span, item_words) of every document that holds a passage of an item."""
    spark = documents.sparkSession
    held = items.select(F.col(item_id).cast("bigint").alias("item"), F.col(item_text).alias("t")).filter("item is not null and t is not null")
    blocks = max(1, -(-int(held.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // block_chars))
    source = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("t")).filter("doc_id is not null and t is not null")
    # openings shared by several items, over all items: compared by sentence, not gathered
    first = F.lower(F.regexp_replace(F.regexp_extract("t", r"(?s)^\s*(.*?[.:?!])\s", 1), r"[^\p{L}\p{N}]+", " "))
    shared = held.select("item", "t", first.alias("opening")).withColumn("many", F.col("opening") != "").alias("h")
    repeats = shared.filter("opening <> ''").groupBy("opening").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    held = shared.join(repeats, "opening", "left").select("item", "t", (F.col("n") > 1).alias("opens"))
    out = None
    for b in range(blocks):
        rows = held.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        openings = shared_openings([r["t"] for r in rows if r["opens"]] * 2)
        by_item = defaultdict(list)
        for r in rows:
            by_item[r["item"]].append(without_opening(words(r["t"]), openings) if r["opens"] else words(r["t"]))
        block = spark.sparkContext.broadcast([(i, w) for i, texts in sorted(by_item.items()) for w in texts])

        def search(batches, block=block):
            index = Index(block.value, k, window)
            for pdf in batches:
                docs, texts, got = pdf["doc_id"].tolist(), pdf["t"].tolist(), []
                for at in range(0, len(texts), CHUNK):
                    got += [(docs[at + t], *m) for t, *m in index.search(texts[at : at + CHUNK], min_words)]
                yield pd.DataFrame(got, columns=["doc_id", "item_id", "span", "item_words"])

        part = source.mapInPandas(search, "doc_id bigint, item_id bigint, span int, item_words int")
        out = part if out is None else out.unionAll(part)
    return out.groupBy("doc_id", "item_id").agg(F.max("span").alias("span"), F.max("item_words").alias("item_words"))


def leak_report(leaks: DataFrame, items: DataFrame, item_id: str = "item_id") -> DataFrame:
    """Every item with the number of documents it leaked into and its longest span; 0 where none."""
    n = leaks.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("span").alias("longest_span"))
    every = items.select(F.col(item_id).cast("bigint").alias("item_id")).filter("item_id is not null").distinct()
    return every.join(n, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest_span", F.lit(0)).alias("longest_span"))
