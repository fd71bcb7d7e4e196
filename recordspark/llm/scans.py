"""Problem 5: noise in text from scanned pages, by noisy-channel correction.

Three steps over pages (``pages_text``, or ``full_text`` between form feeds):

1. Corpus counts: every task counts words and word pairs of all texts in memory and
   emits partial sums, which are added up by key. None is left out, however rare.
2. The channel: every known word is turned into the forms one or two character
   confusions make of it; joined with the words that occur, this gives each odd word its
   candidates. Ratios of counts, not counts, admit a candidate, so
   the rule is the same at every corpus size. Misread names must be told from other
   names, so for words that are mostly capitalised the right form has to stand in
   the same document, or outweigh by far.
3. Per line the candidates form a lattice: a node for every reading of a word, weighed by
   channel times word count, and an edge for every reading of the next word, weighed by
   the smoothed count of the pair. Viterbi finds the best path, so that neighbouring odd
   words decide each other. Words split over two lines are joined with or without
   their hyphen, whichever the corpus knows better; running headers and page numbers
   are lines at a page's edge that recur, page numbers aside, over the pages.

The list of frequent words without any candidate (at most ``known_words``) only keeps
these words from being looked up: results are equal for every length of it.

Null, empty and blank pages give no rows. Texts of one page show no furniture and are
not taken for scans. Repeated rows of one id give each case once.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.nicknames import formal_names
from recordspark.session import cut

# What scanners make of characters, as right form and misread form, with its share.
CONFUSIONS = (
    ("l", "1"), ("l", "i"), ("i", "l"), ("i", "1"), ("i", "j"), ("o", "0"), ("s", "5"), ("g", "9"), ("g", "q"), ("b", "6"), ("b", "h"), ("h", "b"), ("z", "2"), ("e", "c"), ("c", "e"), ("e", "o"), ("o", "e"),
    ("t", "f"), ("f", "t"), ("t", "l"), ("l", "t"), ("m", "rn"), ("rn", "m"), ("m", "nn"), ("n", "ri"), ("n", "u"), ("u", "n"), ("n", "r"), ("d", "cl"), ("cl", "d"), ("w", "vv"), ("vv", "w"), ("w", "uu"), ("in", "m"), ("ni", "m"), ("m", "in"),
    ("h", "li"), ("li", "h"), ("k", "lc"), ("a", "o"), ("o", "a"), ("v", "y"), ("y", "v"), ("u", "ii"), ("ll", "11"), ("a", "u"), ("u", "v"), ("v", "u"), ("r", "i"), ("b", "lo"), ("p", "jo"), ("d", "ol"), ("q", "g"), ("s", "8"), ("b", "8"), ("t", "7"), ("e", "6"), ("a", "4"), ("a", "s"), ("nn", "rin"), ("n", "h"), ("h", "n"),
    ("l", "ǀ"), ("i", "ǀ"), ("a", "à"), ("e", "è"), ("o", "ò"), ("u", "ù"), ("i", "í"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("e", "f"), ("c", "("), ("b", "ǀo"),
)
SHARE = 1 / 60  # odds of one confusion in a word against none
TOKEN = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
CAPITAL = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]+")
BAR = re.compile(r"(?<=[^\W_])\||\|(?=[^\W_])")
BAR_LETTER = "ǀ"  # a letter that looks like the bar scanners put for l
BREAK = re.compile(r"([^\W\d_])[-‐‑­] ?\n(?:[>|][>|\s]*)?(?=[a-zß-ÿ])")
END_HYPHEN = re.compile(r"([^\W_]+(?:['’\-][^\W_]+)*)[-‐‑­]\s*$")
FIRST_WORD = re.compile(r"\s*([^\W\d_][^\W_]*(?:['’\-][^\W_]+)*)")
NUMBER = r"(?:[\doOlIiSBZ|]{1,5}|[ivxlc]{1,7})"
PAGE_NUMBER = re.compile(rf"^(?:[-–—~(\[{{]\s*)?(?:(?:page|pg|p|seite|folio|f)\s*[.:]?\s*)?{NUMBER}(?:\s*(?:of|/|von|de)\s*{NUMBER})?(?:\s*[-–—~)\]}}])?$", re.I)
TRAILING_NUMBER = re.compile(rf"(?:[\s|·,]*(?:[-–—(\[]\s*)?(?:page|pg|p)\.?\s*{NUMBER}(?:\s*(?:of|/)\s*{NUMBER})?(?:\s*[-–—)\]])?|\s{{2,}}(?:[-–—(\[]\s*)?{NUMBER}(?:\s*[-–—)\]])?|\s[-–—]\s*{NUMBER}\s*[-–—]|\s\[{NUMBER}\])\s*$", re.I)
LEADING_NUMBER = re.compile(rf"^(?:(?:[-–—(\[]\s*)?(?:(?:page|pg|p)\.?\s*){NUMBER}(?:\s*(?:of|/)\s*{NUMBER})?(?:\s*[-–—)\]])?[\s|·,]+|{NUMBER}\s{{2,}}|[-–—]\s*{NUMBER}\s*[-–—]\s+|\[{NUMBER}\]\s+)", re.I)
# shapes of running lines that may be left on one page only
LONE_HEADER = re.compile(r"^(?:vol[.u]?[a-z]*\.?\s*[\dlIO]+\s*[-–—:]\s*\S.*|exhibit\s+\S+|(?-i:C[O0]NF[A-Z0-9]+ [A-Z0-9 \-–|]+)|[^.,]+\((?:19|20)\d\d\)|[A-Z][^.,/]+\s/\s[^.,/]+)$", re.I)
CAPITALS = re.compile(r"^(?=.*[A-ZÀ-Þ]{3})[A-ZÀ-Þ0-9][A-ZÀ-Þ0-9 '’&\-]{6,}[A-ZÀ-Þ0-9]$")
FOLD = str.maketrans("0|1568!ǀ", "oilsbbii")
DASHES = frozenset("-‐‑\u00ad")
ENDS = ("-\n", "- \n", "‐\n", "‑\n", "\u00ad\n", "‐ \n", "\u00ad \n")


def _barred(text: str) -> str:
    return BAR.sub(BAR_LETTER, text) if "|" in text else text


def _unbroken(text: str) -> str:
    return BREAK.sub(r"\1", text) if any(x in text for x in ENDS) else text


FLUSH = 2_000_000  # words held by a task before it emits its sums


def _count(batches):
    """Rows (a, b, n, capital): counts of words (b null) and of pairs of words next to each other."""
    places: defaultdict[str, int] = defaultdict()
    places.default_factory = places.__len__
    held: list[list[int]] = []
    size = 0

    def flush():
        forms = list(places)
        ids = np.concatenate([np.array(x, np.int64) for x in held]) if held else np.empty(0, np.int64)
        low: defaultdict[str, int] = defaultdict()
        low.default_factory = low.__len__
        fold = np.array([low[w.lower()] for w in forms], np.int64)
        capital = np.array([w[:1].isupper() and w[1:2].islower() for w in forms], bool)
        words = np.array(list(low), object)
        apart = low.get("", -1)
        single = np.bincount(fold[ids], minlength=len(words)) if len(ids) else np.zeros(len(words), np.int64)
        first = np.bincount(fold[ids], capital[ids], minlength=len(words)).astype(np.int64) if len(ids) else single
        small = fold[ids]
        left, right = small[:-1], small[1:]
        inside = (left != apart) & (right != apart)
        code, n = np.unique((left[inside] << 32) | right[inside], return_counts=True)
        keep = (single > 0) & (np.arange(len(words)) != apart)
        places.clear(), held.clear()
        return pd.DataFrame(
            {
                "a": np.concatenate([words[keep], words[code >> 32]]), "b": np.concatenate([np.full(keep.sum(), None, object), words[code & 0xFFFFFFFF]]),
                "n": np.concatenate([single[keep], n]), "capital": np.concatenate([first[keep], np.zeros(len(n), np.int64)]),
            }
        )

    for pdf in batches:
        for text in pdf["full_text"].tolist():
            ids = list(map(places.__getitem__, [*TOKEN.findall(_unbroken(_barred(text))), ""]))
            held.append(ids)
            size += len(ids)
            if size > FLUSH:
                yield flush()
                size = 0
    yield flush()


def corpus_counts(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(words: word, n, capital) and (pairs: a, b, n) of all texts."""
    both = texts.select("full_text").filter("full_text is not null").mapInPandas(_count, "a string, b string, n bigint, capital bigint")
    both = cut(both.groupBy("a", "b").agg(F.sum("n").alias("n"), F.sum("capital").alias("capital")))
    return both.filter("b is null").select(F.col("a").alias("word"), "n", "capital"), both.filter("b is not null").select("a", "b", "n")


def variants(word: str) -> set[tuple[str, int]]:
    """(misread form, confusions) for one confusion anywhere, and one repeated wherever it fits."""
    out = {}
    for right, wrong in CONFUSIONS:
        i = word.find(right)
        if i < 0:
            continue
        while i >= 0:
            out.setdefault(word[:i] + wrong + word[i + len(right) :], 1)
            i = word.find(right, i + 1)
        if word.count(right) > 1:
            out.setdefault(word.replace(right, wrong), 2)
    out.pop(word, None)
    return set(out.items())


def _spread(batches):
    for pdf in batches:
        rows = [(v, w, k, n, c) for w, n, c in zip(pdf["word"].tolist(), pdf["n"].tolist(), pdf["capital"].tolist()) for v, k in variants(w)]
        yield pd.DataFrame(rows, columns=["seen", "right", "changes", "n_right", "capital_right"])


def channel(words: DataFrame, times: float = 4.0) -> DataFrame:
    """Rows (seen, right, weight, weight_seen, name, far): the candidates of odd words.

    A form with digits or other foreign signs has every more frequent word as candidate, another form
    those ``times`` as frequent. ``weight`` is the log of channel share times word count; ``name`` tells that the
    right form is mostly capitalised, ``far`` that its odds are beyond doubt.
    """
    # a right form stands more often than an odd one, which stands at least once
    known = words.filter((F.col("n") > 1) & F.col("word").rlike(r"^[\p{L}'\-]{3,40}$"))
    forms = known.mapInPandas(_spread, "seen string, right string, changes int, n_right bigint, capital_right bigint")
    seen = words.select(F.col("word").alias("seen"), F.col("n").alias("n_seen"))
    digit = F.col("seen").rlike(r"[\dǀﬁﬂ]")
    pairs = forms.join(seen, "seen").filter((digit & (F.col("n_right") > F.col("n_seen"))) | (F.col("n_right") >= F.lit(times) * F.col("n_seen")))
    return pairs.select(
        "seen", "right", (F.log("n_right") + F.log(F.lit(SHARE)) * F.col("changes")).alias("weight"), (F.log("n_seen") + F.when(digit, F.log(F.lit(SHARE))).otherwise(0.0)).alias("weight_seen"),
        ((F.col("capital_right") >= 0.8 * F.col("n_right")) & ~digit).alias("name"), (F.col("n_right") * F.lit(SHARE) >= 2 * F.col("n_seen")).alias("far"),
    )


def _key(line: str) -> str:
    bare = LEADING_NUMBER.sub("", TRAILING_NUMBER.sub("", line.strip()))
    return re.sub(r"[\W_]+", " ", bare.translate(FOLD).lower()).strip()


class _Running:
    """The edge lines of a document's pages, by key."""

    def __init__(self, edges: list[list[str]]):
        self.keys: Counter = Counter()
        for lines in edges:
            self.keys.update({k for k in map(_key, (x for x in lines if not PAGE_NUMBER.match(x.strip()))) if len(k) >= 4})
        self.near: defaultdict[str, list[str]] = defaultdict(list)
        for k in self.keys:
            self.near["^" + k[:5]].append(k)
            self.near["$" + k[-5:]].append(k)
            for w in set(k.split()):
                self.near[w].append(k)

    def __contains__(self, line: str) -> bool:
        k = _key(line)
        if len(k) < 4:
            return False
        ended = line.rstrip()[-1:] in ".,;!?"
        if self.keys[k] >= 2 + ended:
            return True
        if ended:
            return False
        # a misread one: like another page's, of which it shares half of the words or the beginning or end
        mine = sorted(set(k.split()), key=lambda w: len(self.near[w]))
        posts = ["^" + k[:5], "$" + k[-5:], *mine[: len(mine) // 2 + 1]]  # half the words hold one of these at least
        for c in {c for post in posts for c in self.near[post] if c != k and abs(len(k) - len(c)) <= 3}:
            if c[:5] == k[:5] or c[-5:] == k[-5:] or 2 * len(set(mine) & set(c.split())) >= len(mine):
                m = SequenceMatcher(None, k, c, autojunk=False)
                if m.quick_ratio() >= 0.86 and m.ratio() >= 0.86:
                    return True
        return False


def furniture(pages: list[str]) -> list[dict[int, str]]:
    """Per page: line number (from 0) to 'header' or 'page_number'."""
    split = [(p or "").split("\n") for p in pages]
    full = [[i for i, x in enumerate(lines) if x.strip()] for lines in split]
    scanned = any(x.rstrip()[-1:] in DASHES and END_HYPHEN.search(x) for lines in split for x in lines if x)
    deep = 3
    while True:
        edges = [(at[:deep], at[::-1][:deep]) for at in full]
        running = _Running([[split[n][i] for i in {*top, *bottom}] for n, (top, bottom) in enumerate(edges)])
        out: list[dict[int, str]] = []
        more = False
        for n, both in enumerate(edges):
            got: dict[int, str] = {}
            for edge in both:
                for i in edge:
                    s = split[n][i].strip()
                    if PAGE_NUMBER.match(s) and any(c.isdigit() or c in "ivxlcOlI" for c in s) and not re.fullmatch(r"[A-Za-z]{6,}", s):
                        got[i] = "page_number"
                    elif split[n][i] in running or (scanned and len(s) < 70 and (LONE_HEADER.match(s) or (n > 0 and CAPITALS.match(s) and not any(w in formal_names() for w in s.lower().split())))):
                        got[i] = "header"
                    else:
                        break
                else:
                    more = more or len(edge) < len(full[n])
            out.append(got)
        if not more:
            return out
        deep *= 2  # all lines looked at are furniture: look further


def _pages(pages, text: str | None) -> list[str]:
    if pages is not None:
        return [p if p is not None else "" for p in pages]
    return text.split("\f") if text else []


def _extract(batches, known):
    """One row per scanned document: its furniture, split words, body (words by blank, lines, pages) and the words to look up."""
    skip = known.value
    for pdf in batches:
        rows = []
        for doc, pages, text in zip(pdf["document_id"].tolist(), pdf["pages_text"], pdf["full_text"].tolist()):
            parts = _pages(pages, text)
            if len(parts) < 2:
                continue
            marks = furniture(parts)
            edges, hyphens, bodies, asked = [], [], [], set()
            for n, (page, got) in enumerate(zip(parts, marks), 1):
                lines = page.split("\n")
                edges += [(n, kind, " ".join(lines[i].split()) if kind == "header" else lines[i].strip()) for i, kind in got.items()]
                body = [i for i, x in enumerate(lines) if x.strip() and i not in got]
                head = None  # right part of a word split before
                out = []
                for k, i in enumerate(body):
                    line = _barred(lines[i].rstrip())
                    m = END_HYPHEN.search(line) if line[-1:] in DASHES else None
                    split = None
                    if m and k + 1 < len(body) and m[1][-1:].isalpha():
                        f = FIRST_WORD.match(lines[body[k + 1]])
                        if f and (f[1][0].islower() or (f[1][:2].isupper() and m[1][-1].isupper())):
                            split = (m[1], f[1])
                    found = TOKEN.findall(line)
                    if head is not None and found:
                        found[0] = head
                    if split and found:
                        head = split[0] + split[1]
                        hyphens.append((n, split[0] + split[1], split[0] + "-" + split[1]))
                        found[-1] = head
                    else:
                        head = None
                    low = " ".join(found).lower().replace("’", "'")
                    asked.update(low.split(" "))
                    out.append(low)
                bodies.append("\n".join(out))
            body = "\f".join(bodies)
            asked = [w for w in asked - skip if len(w) > 2 and (w.isalpha() or (any(c.isalpha() for c in w) and sum(c.isdigit() for c in w) < 3))]
            rows.append((doc, int.from_bytes(hashlib.blake2b(body.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True), edges, hyphens, body, asked))
        yield pd.DataFrame(rows, columns=["document_id", "row", "edges", "hyphens", "body", "asked"])


EXTRACT = "document_id bigint, row bigint, edges array<struct<page_no: int, kind: string, value: string>>, hyphens array<struct<page_no: int, a: string, b: string>>, body string, asked array<string>"


def lattice(body: str, options: dict[str, list[tuple]]):
    """Edges (page_no, run, at, a, weight_a, changed_a, b, weight_b, changed_b, own) of every run of odd words.

    ``options`` has (right, weight, weight_seen, name, far) of odd words. A run is a stretch of neighbouring odd words
    of one line with the plain word, or '', on either side; ``own`` tells whether the pair's count tells anything:
    an odd word's own neighbours are copies of one page as likely as usage, so beyond doubt they don't count.
    """
    here = set(body.split())
    nodes: dict[str, list[tuple[str, float, bool, bool]]] = {}
    for seen, found in options.items():
        kept = [o for o in found if not o[3] or o[4] or o[0] in here]
        if kept:
            nodes[seen] = [(seen, kept[0][2], False, not any(o[4] for o in kept)), *((o[0], o[1], True, True) for o in kept)]
    run = 0
    for page_no, page in enumerate(body.split("\f"), 1):
        for line in page.split("\n"):
            words = line.split(" ")
            prior: list | None = None
            for at, w in enumerate(words):
                mine = nodes.get(w)
                if mine is None and prior is None:
                    continue
                if prior is None:
                    run += 1
                    prior = [(words[at - 1] if at else "", 0.0, False, True)]
                step = mine or [(w, 0.0, False, True)]
                for a, wa, ca, oa in prior:
                    for b, wb, cb, ob in step:
                        yield page_no, run, at, a, wa, ca, b, wb, cb, oa and ob
                prior = step if mine else None
            if prior is not None:
                for a, wa, ca, oa in prior:
                    yield page_no, run, len(words), a, wa, ca, "", 0.0, False, oa


def _edges(batches):
    for pdf in batches:
        rows = []
        for doc, row, body, odd in zip(pdf["document_id"].tolist(), pdf["row"].tolist(), pdf["body"].tolist(), pdf["odd"]):
            options = defaultdict(list)
            for o in odd:
                options[o["seen"]].append((o["right"], o["weight"], o["weight_seen"], o["name"], o["far"]))
            rows += [(doc, row, *e) for e in lattice(body, options)]
        yield pd.DataFrame(rows, columns=["document_id", "row", "page_no", "run", "at", "a", "weight_a", "changed_a", "b", "weight_b", "changed_b", "own"])


EDGES = "document_id bigint, row bigint, page_no int, run int, at int, a string, weight_a double, changed_a boolean, b string, weight_b double, changed_b boolean, own boolean"


def best_path(edges) -> list[tuple[str, str]]:
    """Viterbi over one run's edges (at, a, changed_a, b, weight_b, changed_b, n): (seen, right) of every word put right."""
    steps = defaultdict(list)
    for e in edges:
        steps[e["at"]].append(e)
    states: dict[tuple[str, bool], tuple[float, tuple]] = {}
    for at in sorted(steps):
        seen = next((e["b"] for e in steps[at] if not e["changed_b"]), "")
        new: dict[tuple[str, bool], tuple[float, tuple]] = {}
        for e in sorted(steps[at], key=lambda e: (e["changed_b"], e["b"], e["changed_a"], e["a"])):
            score, path = states.get((e["a"], e["changed_a"]), (0.0, ()))
            score += e["weight_b"] + math.log1p(e["n"])
            state = (e["b"], e["changed_b"])
            if state not in new or score > new[state][0]:
                new[state] = (score, (*path, (seen, e["b"])) if e["changed_b"] else path)
        states = new
    return list(max(states.values(), key=lambda x: x[0])[1]) if states else []


def _decode(batches):
    """Rows (document_id, page_no, seen, right)."""
    for pdf in batches:
        rows = [(doc, page, *x) for doc, page, edges in zip(pdf["document_id"].tolist(), pdf["page_no"].tolist(), pdf["edges"]) for x in best_path(edges)]
        yield pd.DataFrame(rows, columns=["document_id", "page_no", "seen", "right"]).astype({"page_no": "int32"})


def _several_pages():
    return F.coalesce(F.size("pages_text") > 1, F.lit(False)) | (F.col("pages_text").isNull() & F.col("full_text").contains("\f"))


def scan_cases(texts: DataFrame, known_words: int = 4000) -> tuple[DataFrame, DataFrame]:
    """(cases: document_id, page_no, kind, value; corrections: document_id, page_no, seen, right)."""
    spark = texts.sparkSession
    base = texts.select(F.col("document_id").cast("bigint").alias("document_id"), "pages_text", "full_text").filter("document_id is not null")
    words, pairs = corpus_counts(base)
    odd = cut(channel(words))
    plain = words.join(odd.select(F.col("seen").alias("word")).distinct(), "word", "left_anti").orderBy(F.desc("n"), "word").limit(known_words)
    known = spark.sparkContext.broadcast(frozenset(r["word"] for r in plain.select("word").collect()))
    found = cut(base.filter(_several_pages()).mapInPandas(lambda it: _extract(it, known), EXTRACT))

    edge = found.select("document_id", F.explode("edges").alias("e")).select("document_id", "e.page_no", "e.kind", "e.value")
    odd_here = found.select("document_id", F.explode("asked").alias("seen")).distinct().join(odd, "seen").groupBy("document_id").agg(F.collect_list(F.struct("seen", "right", "weight", "weight_seen", "name", "far")).alias("odd"))
    edges = found.select("document_id", "row", "body").join(odd_here, "document_id").mapInPandas(_edges, EDGES)
    edges = edges.join(pairs, ["a", "b"], "left").withColumn("n", F.when(F.col("own"), F.coalesce("n", F.lit(0))).otherwise(0))
    runs = edges.groupBy("document_id", "row", "page_no", "run").agg(F.collect_list(F.struct("at", "a", "changed_a", "b", "weight_b", "changed_b", "n")).alias("edges"))
    corrections = cut(runs.mapInPandas(_decode, "document_id bigint, page_no int, seen string, right string").distinct())

    n = words.select("word", "n")
    broken = found.select("document_id", F.explode("hyphens").alias("h")).select("document_id", "h.page_no", "h.a", "h.b").distinct()
    broken = broken.join(n.select(F.col("word").alias("wa"), F.col("n").alias("na")), F.lower("a") == F.col("wa"), "left").join(n.select(F.col("word").alias("wb"), F.col("n").alias("nb")), F.lower("b") == F.col("wb"), "left")
    whole = F.when(F.coalesce("nb", F.lit(0)) > F.coalesce("na", F.lit(0)), F.col("b")).otherwise(F.col("a"))
    broken = broken.select("document_id", "page_no", F.lower("a").alias("seen"), whole.alias("value"), F.col("a").alias("joined"))
    broken = broken.join(corrections, ["document_id", "page_no", "seen"], "left")
    mended = F.when(F.col("right").isNull(), F.col("value")).when(F.substring("joined", 1, 1) != F.lower(F.substring("joined", 1, 1)), F.concat(F.upper(F.substring("right", 1, 1)), F.expr("substring(right, 2)"))).otherwise(F.col("right"))
    hyphens = broken.select("document_id", "page_no", F.lit("hyphen").alias("kind"), mended.alias("value"))
    misread = corrections.select("document_id", "page_no", F.lit("misread").alias("kind"), F.col("right").alias("value"))
    return edge.unionAll(hyphens).unionAll(misread).distinct(), corrections


def repair_pages(pages: list[str], wrong: dict[int, dict[str, str]], joined: dict[str, str]) -> str:
    """Continuous paragraphs of some pages: furniture gone, split words joined, misread words put right."""
    marks = furniture(pages) if len(pages) > 1 else [{} for _ in pages]
    paragraphs: list[str] = []
    for n, (page, got) in enumerate(zip(pages, marks), 1):
        fixes = wrong.get(n, {})

        def right(m, fixes=fixes):
            w = m.group()
            to = fixes.get(w.lower().replace("’", "'"))
            if to is None:
                return w
            return to.upper() if w.isupper() and len(w) > 1 else to[:1].upper() + to[1:] if w[:1].isupper() else to

        lines = ["" if i in got else x for i, x in enumerate(page.split("\n"))]
        body = "\n".join(lines).strip("\n")
        body = re.sub(r"([^\W\d_][^\W_]*(?:['’\-][^\W_]+)*)[-‐‑­]\s*\n\s*([^\W\d_][^\W_]*(?:['’\-][^\W_]+)*)", lambda m: joined.get((m[1] + m[2]).lower(), m[1] + m[2]) if m[2][0].islower() or m[1].isupper() else m.group(), body)
        for k, p in enumerate(x for x in re.split(r"\n\s*\n", body) if x.strip()):
            flat = TOKEN.sub(right, " ".join(_barred(p).split())).replace(BAR_LETTER, "|")
            if k == 0 and n > 1 and paragraphs and not re.search(r"[.!?:;]['\")\]]*$", paragraphs[-1]):
                paragraphs[-1] += " " + flat
            else:
                paragraphs.append(flat)
    return "\n\n".join(paragraphs)


def repaired(texts: DataFrame, known_words: int = 4000) -> DataFrame:
    """Rows (document_id, text) of every scanned document, repaired into continuous paragraphs."""
    cases, corrections = scan_cases(texts, known_words)
    fixes = corrections.groupBy("document_id").agg(F.collect_list(F.struct("page_no", "seen", "right")).alias("fixes"))
    splits = cases.filter("kind = 'hyphen'").groupBy("document_id").agg(F.collect_set("value").alias("splits"))
    base = texts.select(F.col("document_id").cast("bigint").alias("document_id"), "pages_text", "full_text").filter("document_id is not null")
    scans = base.filter(_several_pages()).dropDuplicates(["document_id"])

    def run(batches):
        for pdf in batches:
            out = []
            for pages, text, fix, split in zip(pdf["pages_text"], pdf["full_text"].tolist(), pdf["fixes"], pdf["splits"]):
                wrong: dict[int, dict[str, str]] = {}
                for x in fix if fix is not None else ():
                    wrong.setdefault(x["page_no"], {})[x["seen"]] = x["right"]
                out.append(repair_pages(_pages(pages, text), wrong, {v.replace("-", "").lower(): v for v in (split if split is not None else ())}))
            yield pd.DataFrame({"document_id": pdf["document_id"], "text": out})

    return scans.join(fixes, "document_id", "left").join(splits, "document_id", "left").mapInPandas(run, "document_id bigint, text string")
