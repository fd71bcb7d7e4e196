"""Problem 6: personal information inside free text, by candidate gradient boosting.

High-recall generators propose overlapping spans (email, phone, id number, address,
name); boosted trees score each by its format and its surroundings; thresholds, one
per kind, and a precedence among overlaps select what is redacted.

What the generators know of words (which are common, which open sentences) is counted
over all texts and snippets, and decided by shares and ratios. Only the trees are fitted on a
bounded sample (``sample_texts`` texts and as many snippets, those of least hash). Their
labels come from evidence that the trees do not see:

* names from a join with the whole entities table: persons, organisations or places bear the words;
* phone and id numbers from the label words before them, which the trees of the format do
  not see; trees of the surroundings are fitted in turn to what the format alone makes
  certain, and the odds of both are added;
* emails and addresses from other records: a domain with several users or a user named as
  a person is, a street or a town of several addresses; and, as texts may hold few, from
  sentences written here: some true ones, and decoys such as prices, versions and numbered rules.

Every fifth row is held out: it calibrates the odds and sets each kind's threshold, the
least at which the stated ``precision`` is reached there (``Detector.report``).

Line ends with the quotation marks of emails count as spaces inside a value.
Null, empty and blank texts give no spans and stay as they are. Equal values of one
record are one row.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_right, insort
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.boosting import BoostedTrees
from recordspark.llm.names import trade_words
from recordspark.llm.nicknames import TITLES, formal_names
from recordspark.session import cut

KINDS = ("email", "phone", "id_number", "address", "name")
S = r"(?:[^\S\n]|\n[>|\s]*)"
AT_RIGHT = re.compile(r"[\w\-]+(?:\.[\w\-]+)+")
DIGITS = re.compile(r"\d+")
# matched at the head of a number that stands apart
PHONE = re.compile(rf"(?:\+\d{{1,3}}(?:{S}|[.\-/])?)?(?:\(\d{{2,5}}\){S}?|\d{{2,5}}[ .\-/])?(?:\d{{3,4}}[ .\-/])?\d{{3,4}}[ .\-/]\d{{3,6}}(?![\w\-/]|\.\d)|\+?\d{{10,13}}(?![\w\-/]|\.\d)")
SSN = re.compile(r"\d{3}([\- ]?)\d{2}\1\d{4}(?![\w\-/]|\.\d)")
NINO = re.compile(r"(?<![\w\-])[A-Z]{2} ?\d{2} ?\d{2} ?\d{2} ?[A-D](?![\w\-])", re.I)
LABEL = re.compile(r"[Pp](?:assport|ASSPORT)|[Ll](?:icen[cs]e|ICEN[CS]E)|[Pp]ermit|[Tt](?:ax|AX)|[Ss](?:sn|SN|oc|OC)|[Ii](?:nsurance|NSURANCE|dentity|D\b|dentification)")
LABELLED = re.compile(rf"(?:{S}(?:id|card)|(?:ial|\.){S}sec(?:urity|\.))?(?:{S}?(?:number|no\.?|nr\.?|num\.?|\#|:))*{S}*[:#]?{S}*(?P<v>[A-Z]{{0,3}}[ \-]?\d[\dA-Z]*(?:[\- ]\d[\dA-Z]*)*(?:[ \-]?[A-Z](?![\w]))?)", re.I)
STREET = r"(?:street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|drive|dr\.?|court|ct\.?|terrace|boulevard|blvd\.?|way|place|square|crescent|close|row|hill|gardens)"
NO_TOWN = r"(?!(?:and|was|as|said|the|that|who|which|in|on|at|by|for|to|with|from|call|apt|flat|but|or|of|copy|see|there|no|her|his|q|a|we|they|had|has)\b)"
TOWN = rf"{NO_TOWN}[^\W\d_]{{3,}}"
CODE = rf"(?:,?{S}+(?:[A-Z]{{1,2}}\d{{1,2}}[A-Z]?{S}\d[A-Z]{{2}}|[A-Z]{{2}}{S}\d{{5}}|\d{{5}}(?:-\d{{4}})?)\b)"
NAME_OF_STREET = rf"(?:[A-Z][\w'’]+{S}+){{1,3}}"


def _addresses(flags: int) -> tuple[re.Pattern, re.Pattern, re.Pattern, re.Pattern]:
    """Number before street; number, code and town after a street, and the street before these; a box."""
    town = TOWN if flags else rf"{NO_TOWN}[A-Z][^\W\d_]{{2,}}"
    street = f"(?i:{STREET})"
    return (
        re.compile(rf"[1-9]\d{{0,4}}{S}+{NAME_OF_STREET}{street}(?![\w])(?:,{S}+(?i:apt|flat|unit|suite)\.?{S}+\w{{1,5}})?(?:,{S}+{town}{CODE}?)?", flags),
        re.compile(rf"\d{{1,4}},{S}+\d{{5}}{S}+{town}", flags),
        re.compile(rf"(?<![\w]){NAME_OF_STREET}{street}{S}+$", flags),
        re.compile(rf"[Pp]\.?{S}?[Oo]\.?{S}?[Bb](?:ox|OX){S}+\d+(?:,{S}+{town}{CODE}?)?", flags),
    )


ADDRESSES, ADDRESSES_FOLDED = _addresses(0), _addresses(re.I)
FLAT = re.compile(rf"\b(?:flat|apt|unit|suite)\.?{S}+\d+\w?,{S}+$", re.I)
QUESTION = re.compile(r"(?:^|\n)[\s>|]*Q\. ")
CAPITAL = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]*(?:['’][^\W\d_]+)*")
ANY_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
GAP = re.compile(r"[.!]?(?:\s?\.\.\.)?(,?)((?:[^\S\n]|\n[>|\s]*)+)$")
PHONE_WORDS = re.compile(r"(?:tel|phone|mobile|call|reach|office|fax|cell|contact|messages|again at|ring|\bt|\bo|\bm|direct|details were)\W{0,12}(?:at\W+)?$|@[\w.\-]+\W{1,4}$", re.I)
ID_WORDS = re.compile(r"(?:ssn|soc(?:ial|\.)\s*sec\S*(?:\s*no\.?)?|tax\s*id|insurance\s*(?:no\.?|number)|passport(?:\s*number|\s*no\.?)?|licen[cs]e(?:\s*no\.?|\s*number)?|identity\s*\S*)\W*$", re.I)
OTHER_WORDS = re.compile(r"(?:bates(?:\s+range)?|invoice|docket|meter\s+reading|part\s+no\.?|lot|box|folder|size|pages|\bno\.|usd|eur|[$£€]|(?<![\w@])(?:on|dated?|sent|since|until|between|taken))\W*$", re.I)
COUNTERS = re.compile(r"\b(?:chapter|rule|section|page|pages|exhibit|figure|table|article|room|part|volume|vol|no|item|clause|paragraph|act|psalm|heat|lane|top|the|these|those|all|about|some)\.?\s$", re.I)
ORG_WORDS = frozenset(
    "department dept holdings hldgs trust tr international intl company co limited ltd partners ptnrs cooperative co-op foundation fdn association assn corporation corp incorporated inc services svcs institute inst brothers bros group grp".split()
)
PLACE_WORDS = frozenset("airfield county island estate point harbour valley terminal street road avenue lane drive court terrace box flat apt north south east west old upper lower".split())
CALENDAR = frozenset("january february march april may june july august september october november december jan feb mar apr jun jul aug sep sept oct nov dec monday tuesday wednesday thursday friday saturday sunday mon tue wed thu fri sat sun am pm re fwd fw from to cc bcc sent date subject".split())
FEATURES = 20


class Vocabulary:
    """Bounded word lists learned from the sample."""

    def __init__(self, common: frozenset[str] = frozenset(), trades: frozenset[str] = frozenset()):
        self.common, self.trades = common, trades

    @lru_cache(maxsize=100_000)  # noqa: B019
    def kind(self, word: str) -> str:
        """G given name, T title, I initial, O firm word, P place word, C calendar or header word, W common word, X other."""
        w = word.lower().rstrip(".")
        if len(w) == 1:
            return "I"
        if w in TITLES:
            return "T"
        if w in formal_names() and (w not in self.common or w in formal_names()[w]):
            return "G"
        if w in ORG_WORDS or w in self.trades:
            return "O"
        if w in PLACE_WORDS:
            return "P"
        if w in CALENDAR:
            return "C"
        return "W" if w in self.common or len(w) < 3 or "'" in w or "’" in w else "X"


def _value(text: str) -> str:
    return re.sub(r"\s*\n[>|\s]*|\s+", " ", text).strip()


PATTERNS = ("GX", "GIX", "IX", "X,G", "XG", "X,I", "TX", "G", "X", "GG")


def _names(text: str, vocabulary: Vocabulary, folded: bool):
    """Proposed names: (begin, end, pattern, titled, word after, word before, words)."""
    words = [(m.start(), m.end(), m.group()) for m in (ANY_WORD if folded else CAPITAL).finditer(text)]
    kind = vocabulary.kind
    kinds = [kind(w[2]) for w in words]
    n = len(words)
    links = []  # how word i is joined to i + 1: ' ' , ',' or None
    for i in range(n - 1):
        gap = text[words[i][1] : words[i + 1][0]]
        if gap == " ":
            links.append(" ")
            continue
        m = None if gap.strip(" \t\r\n\f\v\u00a0>|.,!") or gap.count("\n") > 1 else GAP.match(gap)
        if not m:
            links.append(None)
        elif m[1]:
            links.append(",")
        elif gap[0] in ".!" and (kinds[i] not in "ITG" or (kinds[i] == "G" and words[i][2].lower() in formal_names()[words[i][2].lower()])):
            links.append(None)  # the end of a sentence, not of a short form
        elif "\n" in gap and text[text.rfind("\n", 0, words[i][0]) + 1 : words[i][0]].strip(" >|") == "" and len(text[words[i][0] : words[i][1] + 1].split("\n")[0]) < 30 and gap.strip(" ")[:1] == "\n" and kinds[i] == "G":
            links.append(None)  # a name alone on its line
        else:
            links.append(" ")
    links.append(None)
    families = set()
    out = []
    i = 0
    asked = QUESTION.search(text) is not None
    while i < n:
        k = kinds[i]
        if k not in "GXIT" or (k == "I" and ((asked and words[i][2] in "AQ" and text[text.rfind("\n", 0, words[i][0]) + 1 : words[i][0]].strip(" >|\t") == "" or text[words[i][0] - 1 : words[i][0]] == "."))):
            i += 1
            continue
        titled = False
        start = i
        if k == "T":
            if links[i] != " ":
                i += 1
                continue
            titled = True
            i += 1
            k = kinds[i]
            if k not in "GXI":
                continue
        a, b = links[i], links[i + 1] if i + 1 < n else None
        k1 = kinds[i + 1] if i + 1 < n and a else ""
        k2 = kinds[i + 2] if i + 2 < n and a and b else ""
        after = kinds[i + 2] if i + 2 < n and a == " " and b == " " else ""
        used, pattern = 0, ""
        if k == "G" and a == " " and k1 == "I" and b == " " and k2 in ("X", "G"):
            used, pattern = 3, "GIX"
        elif k == "G" and a == " " and k1 == "X":
            used, pattern = 2, "GX"
        elif k == "G" and a == " " and k1 == "G":
            used, pattern = 2, "GG"
        elif k == "I" and a == " " and k1 == "X" and len(words[i][2]) == 1:
            used, pattern = 2, "IX"
        elif k == "I" and a == " " and k1 == "I" and b == " " and k2 == "X":
            used, pattern = 3, "IX"
        elif k == "X" and a == "," and k1 == "G" and not titled:
            used, pattern = 2, "X,G"
        elif k == "X" and a == "," and k1 == "I" and not titled and len(words[i + 1][2]) == 1:
            used, pattern = 2, "X,I"
        elif k == "X" and a == " " and k1 == "G" and after not in ("X", "I", "G") and not folded:
            used, pattern = 2, "XG"
        elif k == "X" and titled:
            used, pattern = 1, "TX"
        elif k == "G":
            used, pattern = 1, "G"
        elif k == "X" and not folded:
            used, pattern = 1, "X"
        if not used:
            i += 1
            continue
        last = i + used - 1
        if pattern == "X,G" and last + 1 < n and links[last] == " " and kinds[last + 1] == "X" and not titled:
            used, pattern, last = 1, "X", i
        end = words[last][1]
        if pattern == "X,I" or (pattern in ("G", "X,G") and text[end : end + 1] == "." and words[last][2].lower() in ("thos", "wm", "chas", "jas", "robt", "edw", "benj", "saml", "nathl", "margt", "eliz", "fredk", "alex")):
            end += text[end : end + 1] == "."
        if pattern == "X,G" and last + 1 < n and links[last] == " " and kinds[last + 1] == "I" and text[words[last + 1][1] : words[last + 1][1] + 1] == ".":
            last += 1
            end = words[last][1] + 1
        following = kinds[last + 1] if last + 1 < n and links[last] == " " else ""
        if following and used > 1 and "\n" in text[words[last][1] : words[last + 1][0]]:
            following = ""  # a name at the end of its line, as in signatures
        before = kinds[start - 1] if start and links[start - 1] == " " else ""
        if pattern in ("GX", "GIX", "IX", "XG", "X,G", "X,I", "TX") and following != "O":
            families |= {words[j][2].lower() for j in range(i, last + 1) if kinds[j] == "X"}
        out.append((words[i][0], end, pattern, titled, following, before, [words[j][2] for j in range(i, last + 1)]))
        i = last + 1
        if following == "O":
            while i < n and links[i - 1] == " " and kinds[i] in "OXW":
                i += 1
    return out, families


def _words_back(text: str, at: int, n: int) -> int:
    """Where the n-th word before a place begins."""
    for _ in range(n):
        while at and not text[at - 1].isalnum():
            at -= 1
        while at and text[at - 1].isalnum():
            at -= 1
    return at


def propose(text: str, vocabulary: Vocabulary):
    """Overlapping candidates: (kind, begin, end, features)."""
    out = []
    folded = text.lower() == text or text.upper() == text
    taken = []

    def add(kind, b, e, **more):
        value = text[b:e]
        before, after = text[max(0, b - 48) : b], text[e : e + 12]
        digits = sum(c.isdigit() for c in value)
        line = text[text.rfind("\n", 0, b) + 1 : b].strip(" >|\t")
        f = [0] * FEATURES
        f[0] = KINDS.index(kind)
        f[1] = min(digits, 15)
        f[2] = 1 if "+" in value else 2 if "(" in value else 0
        f[3] = 0 if kind == "name" else 3 * bool(PHONE_WORDS.search(before)) + (1 if ID_WORDS.search(before) else 0)
        f[4] = 0 if kind == "name" else int(bool(OTHER_WORDS.search(before)))
        f[5] = int(bool(re.match(r"(?:19|20)\d\d[\-/.]|\d{1,2}[\-/.]\d{1,2}[\-/.](?:19|20)\d\d", value))) if digits else 0
        f[6] = more.get("shape", 0)
        f[7] = 1 + min(14, len(re.findall(r"\d+", value))) if digits else 0
        f[8] = more.get("pattern", 0)
        f[9] = int(more.get("titled", False))
        f[10] = " GXIOPCWT".find(more.get("following") or " ")
        f[11] = " GXIOPCWT".find(more.get("before") or " ")
        f[12] = int(not line) + 2 * int(after[:1] in ("\n", ""))
        f[13] = 1 if after[:1] in ",:" else 2 if after[:1] in ">|<" else 3 if after[:1] == "." else 0
        f[14] = int(more.get("family", False))
        f[15] = int(value.isupper())
        f[16] = min(15, len(value) // 2)
        f[17] = 1 if before[-1:] in "@<\\/_" and before else 2 if before.rstrip()[-1:] == "," else 3 if before.rstrip()[-1:] in ".!?:" else 0
        f[18] = int(bool(re.search(r"\b(?:at|in|to|from|near|of|via)\s$", before)))
        f[19] = int(after[:4] == " to " or after[:1] in "-/")
        out.append((kind, b, e, f))

    at = text.find("@")
    while at >= 0:
        begin, right = at, AT_RIGHT.match(text, at + 1)
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.+-"):
            begin -= 1
        if begin < at and right:
            top = right.group().rpartition(".")[2]
            add("email", begin, right.end(), shape=1 + any(c.isalpha() for c in text[begin:at]) + 2 * top.isalpha() + 4 * (len(top) > 1) + 8 * any(c.isalpha() for c in right.group()))
            taken.append((begin, right.end()))
        at = text.find("@", at + 1)
    numbered, placed, street, box = ADDRESSES_FOLDED if folded else ADDRESSES
    spans = []
    for number in DIGITS.finditer(text):
        p = number.start()
        before = text[p - 1 : p]
        nino = NINO.match(text, p - 3) if before == " " and p >= 3 else NINO.match(text, p - 2) if before.isalpha() and p >= 2 else None
        if nino:
            add("id_number", nino.start(), nino.end(), shape=5)
        begin = p
        while begin and text[begin - 1] in "(+":
            begin -= 1
        outer = text[begin - 1 : begin]
        if outer and (outer.isalnum() or outer in "_.-/#"):
            continue
        m = PHONE.match(text, begin)
        if m and 7 <= sum(c.isdigit() for c in m.group()) <= 13:
            n = sum(c.isdigit() for c in m.group())
            add("phone", m.start(), m.end(), shape=min(15, m.group().count("-") + 4 * m.group().count(".") + 8 * (n == 7)))
        if begin != p:
            continue
        m = SSN.match(text, p)
        if m:
            add("id_number", m.start(), m.end(), shape=1 + (m[1] == "-") + 2 * (m[1] == " "))
        m = numbered.match(text, p) if not (p > 1 and text[p - 1] in " )" and text[p - 2].isdigit()) else None
        if m:
            flat = FLAT.search(text, max(0, p - 24), p)
            spans.append((flat.start() if flat else p, m.end()))
        else:
            m = placed.match(text, p)
            # a street begins its line, unless it goes on from the line before
            if m and (lead := street.search(text, max(_words_back(text, p, 5), text.rfind("\n", 0, p) + 1), p) or street.search(text, _words_back(text, p, 5), p)):
                spans.append((lead.start(), m.end()))
    if "ox " in text or "OX " in text or "ox\n" in text:
        spans += [(m.start(), m.end()) for m in box.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    for b, e in spans:
        add("address", b, e, shape=1 + int("," in text[b:e]) + 2 * int("ox" in text[b:e].lower()) + 4 * int(bool(COUNTERS.search(text[max(0, b - 12) : b]))), pattern=min(9, len(text[b:e].split())))
        taken.append((b, e))
    for head in LABEL.finditer(text):
        if text[head.start() - 1 : head.start()].isalpha():
            continue
        m = LABELLED.match(text, head.end())
        if m and m["v"][:1].islower() and not folded:
            continue
        if m and sum(c.isdigit() for c in m["v"]) >= 5 and not re.match(r"(?:no|nr|id|num|sec)\b", m["v"], re.I):
            add("id_number", m.start("v"), m.end("v"), shape=6)
    names, families = _names(text, vocabulary, folded)
    taken.sort()
    begins, reach = [x for x, _ in taken], []
    for _, y in taken:
        reach.append(max(y, reach[-1]) if reach else y)
    for b, e, pattern, titled, following, before, words in names:
        k = bisect_right(begins, b)
        if k and reach[k - 1] > b:
            continue
        known = pattern in ("X", "TX") and words[-1].lower() in families
        add("name", b, e, pattern=PATTERNS.index(pattern), titled=titled, following=following, before=before, family=known)
    return out


# Where spans overlap, the kind that comes first stands.
PRECEDENCE = {"email": 0, "address": 1, "id_number": 2, "phone": 3, "name": 4}


LABELLED_BY = (3, 4)  # the columns of label words, which name the kind of a number
AROUND = (0, 3, 4, 12, 13, 17, 18, 19)  # the columns of a number's surroundings
MOST_AROUND = 3.0  # both views share evidence, so the surroundings alone never turn what the format makes certain
NUMBERS = [KINDS.index("phone"), KINDS.index("id_number")]


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class Scorer:
    """Odds by format, of all kinds, and by surroundings, of numbers."""

    def __init__(self):
        self.format, self.around, self.prior = BoostedTrees(), None, 0.0

    @staticmethod
    def _bare(x: np.ndarray) -> np.ndarray:
        x = x.copy()
        x[:, LABELLED_BY] = 0
        return x

    def fit(self, x: np.ndarray, y: np.ndarray, every: np.ndarray) -> Scorer:
        """``x`` and ``y``: labelled rows; ``every``: all candidates of the sample."""
        self.format.fit(self._bare(x), y)
        numbers = every[np.isin(every[:, 0], NUMBERS)] if len(every) else every
        if len(numbers):
            p = self.format.predict(self._bare(numbers))
            sure = (p >= 0.9) | (p <= 0.1)
            if sure.sum() >= 20 and 0 < (p[sure] >= 0.9).mean() < 1:
                self.around = BoostedTrees().fit(numbers[sure][:, AROUND], p[sure] >= 0.9)
                self.prior = float(_logit(np.array([(p[sure] >= 0.9).mean()]))[0])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = _logit(self.format.predict(self._bare(x)))
        if self.around is not None:
            number = np.isin(x[:, 0], NUMBERS)
            z[number] += np.clip(_logit(self.around.predict(x[number][:, AROUND])) - self.prior, -MOST_AROUND, MOST_AROUND)
        return 1 / (1 + np.exp(-z))


class Detector:
    def __init__(self, vocabulary: Vocabulary, model, thresholds: dict[str, float], report: dict[str, tuple[int, float, float]] | None = None):
        self.vocabulary, self.model, self.thresholds = vocabulary, model, thresholds
        #: per kind: held-out rows, precision and recall there
        self.report = report or {}

    def spans(self, texts: list[str | None]) -> list[list[tuple[str, int, int]]]:
        """Selected (kind, begin, end) of each text, in order."""
        proposed = [propose(t, self.vocabulary) if t and t.strip() else [] for t in texts]
        rows = [c[3] for p in proposed for c in p]
        chance = self.model.predict(np.array(rows, np.int64)) if rows else np.empty(0)
        out, at = [], 0
        for p in proposed:
            scored = [(PRECEDENCE[c[0]], -(c[2] - c[1]), c) for c, q in zip(p, chance[at : at + len(p)]) if q >= self.thresholds[c[0]]]
            at += len(p)
            kept: list[tuple[int, int, str]] = []
            for _, _, (kind, b, e, _) in sorted(scored, key=lambda x: (x[0], x[1], x[2][1])):
                k = bisect_right(kept, (b, e, ""))
                if (k == 0 or kept[k - 1][1] <= b) and (k == len(kept) or kept[k][0] >= e):
                    insort(kept, (b, e, kind))
            out.append([(kind, b, e) for b, e, kind in kept])
        return out


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with typed placeholders in place of the spans."""
    out, at = [], 0
    for kind, b, e in spans:
        out += [text[at:b], f"[{kind.upper()}]"]
        at = e
    return "".join([*out, text[at:]])


BROKEN_WORD = re.compile(r"[-‐\u00ad]\s*\n[>|\s]*")
SMALL = re.compile(r"(?<![\w@.\-+])[a-zß-ÿ]{3,}(?![\w@])")
BIG = re.compile(r"\b[A-ZÀ-Þ][^\W\d_]*(?:['’][^\W\d_]+)*")
HEAD = re.compile(r"[.!?:;\n](?<!\b[A-Z]\.)(?<!\bM[rs]\.)(?<!\bDr\.)(?<!\bMrs\.)(?<!\bProf\.)(?<!\bCapt\.)[\s>|\-]*([A-ZÀ-Þ][^\W\d_]*(?:['’][^\W\d_]+)*)")


def _word_counts(batches):
    """Partial sums (word, small, heads, capitals, upper): texts that have it in small letters, and occurrences with a capital, at a sentence's head, in all, and all in capitals."""
    small: Counter = Counter()
    heads: Counter = Counter()
    capitals: Counter = Counter()

    def flush():
        sums: dict[str, list[int]] = {}
        for k, counts in enumerate((small, heads, capitals)):
            for w, n in counts.items():
                row = sums.setdefault(w.lower(), [0, 0, 0, 0])
                row[k] += n
                if k == 2 and len(w) > 1 and w.isupper():
                    row[3] += n
            counts.clear()
        return pd.DataFrame([(w, *n) for w, n in sums.items()], columns=["word", "small", "heads", "capitals", "upper"])

    for pdf in batches:
        for text in pdf["text"].tolist():
            big = BIG.findall(text)
            capitals.update(big)
            heads.update(HEAD.findall("\n" + text))
            if 50 * len(big) > text.count(" ") + text.count("\n"):
                small.update(set(SMALL.findall(BROKEN_WORD.sub("", text) if "\n" in text else text)))
        if len(small) + len(capitals) > 400_000:
            yield flush()
    yield flush()


def corpus_vocabulary(texts: DataFrame, entities: DataFrame, share: float = 2e-6, plain: float = 0.2) -> Vocabulary:
    """Word lists counted over all texts.

    A word is common if it makes up ``share`` of all words counted (so there are at most 1 / ``share``)
    and stands in small letters, in texts that have capitals at all, ``plain`` times as often as, inside sentences, with a capital, a given name five times as often as with a capital anywhere; or
    if it stands with a capital four times as often at the head of a sentence as inside; or if it is nearly always
    written all in capitals, as words of headlines are.
    """
    words = texts.select("text").mapInPandas(_word_counts, "word string, small bigint, heads bigint, capitals bigint, upper bigint").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("small", "heads", "capitals", "upper")))
    words = cut(words)
    least = share * (words.agg(F.sum(F.col("small") + F.col("capitals"))).first()[0] or 0)
    inner = F.col("capitals") - F.col("heads")
    common = words.filter((F.col("small") > least) & (F.col("small") >= F.when(F.col("word").isin(sorted(formal_names())), 5 * F.col("capitals")).otherwise(plain * inner))).select("word", F.lit(False).alias("opens"))
    opening = words.filter((F.col("heads") > least) & (F.col("heads") >= 4 * inner)).select("word", F.lit(True).alias("opens"))
    shouted = words.filter((F.col("capitals") > least) & (F.col("upper") >= 0.9 * F.col("capitals"))).select("word", F.lit(True).alias("opens"))
    listed = common.unionAll(opening).unionAll(shouted).collect()
    return Vocabulary(frozenset(r["word"] for r in listed if not r["opens"] or r["word"] not in formal_names()), trade_words(entities))


# What looks like an email or an address and is none; # is a number.
DECOYS = {
    "email": ("They sold apples 12@#.50 and pears 6@#.25 at the fair.", "Install core-tools@#.4.1 before the update.", "The rate was 3@#.75 a box.", "We bought 40@1.#9 and no more.", "See build x@#.0.2 for the fix."),
    "address": ("We read Rule # Motion Court again.", "See Chapter # Summary Way of the book.", "All # Kings Court players were there.", "The # Great Way signs were old.", "It stood in Section # Upper Hill of the map.", "Some # Long Drive tests were run.", "Page # Open Road was torn."),
}
# True ones, for texts that hold hardly any.
SEEDS = {
    "email": ("Write to j.miller#@post.example.", "Her address is ann#@mail.example, as before.", "From: K. Moss <kmoss#@office.example>"),
    "address": ("He lived at # Mill Lane, Ashby.", "Send it to # Upper Grove Street, Apt #, Ashby QX# 4BF, by noon.", "The shop stood in # Park Road.", "Write to P.O. Box #, Ashby 01#34.", "Moss & Sons\n# Station Road, Ashby 0#345\n"),
}


def _written(templates: dict[str, tuple[str, ...]], copies: int = 12) -> list[tuple[str, str]]:
    rng = random.Random(6)
    return [(kind, re.sub("#", lambda m: str(rng.randrange(1, 90)), t)) for kind, listed in templates.items() for t in listed for _ in range(copies)]


def _threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least threshold from 0.3 on with that precision on held-out rows, one wrong row aside; if none, that with the best."""
    options = []
    for t in np.arange(0.3, 0.96, 0.05):
        chosen = p >= t
        wrong = int((chosen & ~y).sum())
        if chosen.any() and wrong <= max(1.0, (1 - precision) * chosen.sum()):
            return float(round(t, 2))
        options.append((1 - wrong / max(1, chosen.sum()) if chosen.any() else 0.0, -t))
    return float(round(-max(options)[1], 2))


def _address_parts(value: str) -> list[str]:
    """The street without its number, and the town of an address."""
    parts = [x.strip().lower() for x in _value(value).split(",")]
    return [re.sub(r"^\d+\s*", "", parts[0]) or parts[0], *parts[-1:] * (len(parts) > 1)]


def fit_detector(texts: DataFrame, snippets: DataFrame, entities: DataFrame, sample_texts: int = 1000, precision: float = 0.98) -> Detector:
    """Fit on about ``sample_texts`` texts and as many snippets, those whose id has the least hash.

    ``texts`` and ``snippets`` have (id, text). See the module for where labels come from.
    """
    spark = texts.sparkSession
    vocabulary = corpus_vocabulary(texts.select("text").unionAll(snippets.select("text")).filter("text is not null"), entities)

    def least(df):
        part = min(1.0, sample_texts / max(1, df.select("id").count()))
        chosen = df.filter((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) < F.lit(int(part * (1 << 40)))) & F.col("text").isNotNull())
        return [r["text"] for r in chosen.select("id", "text").orderBy("id").collect()]

    sample = least(texts) + least(snippets)
    candidates = [(t, *c) for t in sample for c in propose(t, vocabulary)]
    after = lambda t, e: (m.group().lower() if (m := re.match(r" ([^\W\d_]+)", t[e : e + 40])) else "").strip()
    words = {w.lower() for t, kind, b, e, _ in candidates if kind in ("name", "email") for w in ANY_WORD.findall(t[b:e])} | {after(t, e) for t, kind, b, e, _ in candidates if kind == "name"}
    names = entities.select(F.lower("entity_type").alias("type"), F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    person = F.col("type").startswith("per")
    tokens = names.filter("type is not null").select(person.alias("person"), F.explode(F.expr(r"regexp_extract_all(lower(name), '[\\p{L}]+', 0)")).alias("word"))
    asked = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    known = {r["word"]: (r["p"], r["o"]) for r in tokens.join(F.broadcast(asked), "word").groupBy("word").agg(F.sum(F.col("person").cast("int")).alias("p"), F.sum((~F.col("person")).cast("int")).alias("o")).collect()}
    users, towns = defaultdict(set), defaultdict(set)
    for t, kind, b, e, _ in candidates:
        if kind == "email":
            user, _, domain = t[b:e].lower().partition("@")
            users[domain].add(user)
        elif kind == "address":
            for part in _address_parts(t[b:e]):
                towns[part].add(_value(t[b:e]).lower())
    x, y = [], []
    for t, kind, b, e, f in candidates:
        before, value = t[max(0, b - 48) : b], t[b:e]
        if kind == "name":
            found = [known.get(w.lower(), (0, 0)) for w in ANY_WORD.findall(value) if len(w) > 1]
            if not found:
                continue
            p, o = known.get(after(t, e), (0, 0))
            if o > p or any(o > p for p, o in found):
                label = False  # part of an organisation's or a place's name
            elif all(p > o for p, o in found):
                label = True
            elif f[8] == PATTERNS.index("X") and all(p == o for p, o in found):
                label = False  # a lone word that no person bears
            else:
                continue
        elif kind == "email":
            user, _, domain = value.lower().partition("@")
            if len(users[domain]) < 2 and not any(p > o for p, o in (known.get(w, (0, 0)) for w in ANY_WORD.findall(user))):
                continue
            label = True
        elif kind == "address":
            if max(len(towns[part]) for part in _address_parts(value)) < 2:
                continue
            label = True
        elif (ID_WORDS if kind == "id_number" else PHONE_WORDS).search(before):
            label = True
        elif OTHER_WORDS.search(before) or (PHONE_WORDS if kind == "id_number" else ID_WORDS).search(before):
            label = False
        else:
            continue
        x.append(f)
        y.append(label)
    for templates in (SEEDS, DECOYS):
        for kind, t in _written(templates):
            for c in propose(t, vocabulary):
                if c[0] == kind:
                    x.append(c[3])
                    y.append(templates is SEEDS)
    x, y = np.array(x, np.int64).reshape(-1, FEATURES), np.array(y, bool)
    mixed = np.random.default_rng(6).permutation(len(y))
    x, y = x[mixed], y[mixed]
    model = Scorer().fit(x, y, np.array([c[4] for c in candidates], np.int64).reshape(-1, FEATURES))
    held = np.arange(len(y)) % 5 == 4
    hx, hy = x[held], y[held]
    # of numbers the held-out labels judge the format alone, as label words made them
    p = model.format.predict(model._bare(hx)) if len(hx) else np.empty(0)
    thresholds, report = {}, {}
    for n, kind in enumerate(KINDS):
        mine = hx[:, 0] == n
        t = _threshold(p[mine], hy[mine], precision) if mine.sum() >= 20 else 0.5
        chosen = p[mine] >= t
        thresholds[kind] = t
        report[kind] = (int(mine.sum()), float(hy[mine][chosen].mean()) if chosen.any() else 0.0, float(chosen[hy[mine]].mean()) if hy[mine].any() else 0.0)
    return Detector(vocabulary, model, thresholds, report)


def _places(own: str, text: str) -> list[tuple[int, int]]:
    """Where a mention's own name stands in its snippet."""
    out, at = [], text.find(own)
    while at >= 0:
        out.append((at, at + len(own)))
        at = text.find(own, at + 1)
    return out


def _chunks(texts: list[str], chars: int):
    """(first, texts) of stretches of about so many characters: the trees run once for each."""
    begin, held = 0, 0
    for k, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or k == len(texts) - 1:
            yield begin, texts[begin : k + 1]
            begin, held = k + 1, 0


def _found(detector, table_name, chunk_chars=1_000_000):
    def run(batches):
        d = detector.value
        for pdf in batches:
            ids, texts = pdf["id"].tolist(), pdf["text"].tolist()
            own = pdf["own"].tolist() if "own" in pdf else [None] * len(ids)
            rows = []
            for at, part in _chunks(texts, chunk_chars):
                for k, spans in enumerate(d.spans(part)):
                    mine = _places(own[at + k], part[k]) if own[at + k] and spans else ()
                    for kind, b, e in spans:
                        if kind == "name" and any(b < y and e > x for x, y in mine):
                            continue
                        v = _value(part[k][b:e])
                        rows.append((table_name, ids[at + k], kind, v))
            yield pd.DataFrame(list(dict.fromkeys(rows)), columns=["source_table", "row_id", "pii_kind", "value"])

    return run


ROWS = "source_table string, row_id bigint, pii_kind string, value string"


def personal_data(texts: DataFrame, mentions: DataFrame, entities: DataFrame, sample_texts: int = 1000) -> DataFrame:
    """Rows (source_table, row_id, pii_kind, value), distinct, of both tables."""
    t = texts.select(F.col("document_id").cast("bigint").alias("id"), F.col("full_text").alias("text")).filter("id is not null")
    m = mentions.select(F.col("id").cast("bigint").alias("id"), F.col("context_snippet").alias("text"), F.col("name_as_appears").alias("own")).filter("id is not null and text is not null")
    detector = texts.sparkSession.sparkContext.broadcast(fit_detector(t, m, entities, sample_texts))
    a = t.filter("text is not null").mapInPandas(_found(detector, "document_texts"), ROWS)
    b = m.mapInPandas(_found(detector, "mentions"), ROWS)
    # a record is one row, so its values are distinct already; repeated rows of an id need the rest
    return a.unionAll(b).dropDuplicates(["source_table", "row_id", "pii_kind", "value"])


def _redacting(detector, table_name):
    """Rows (source_table, row_id, text, redactions) of one table's (id, text) and, for mentions, own."""

    def run(batches):
        for pdf in batches:
            texts = pdf["text"].tolist()
            own = pdf["own"].tolist() if "own" in pdf else [None] * len(texts)
            out, counts = [], []
            found = [s for _, part in _chunks(texts, 1_000_000) for s in detector.value.spans(part)]
            for t, o, spans in zip(texts, own, found):
                mine = _places(o, t) if o and spans else ()
                spans = [x for x in spans if not (x[0] == "name" and any(x[1] < e and x[2] > b for b, e in mine))]
                out.append(redact(t, spans) if t else t)
                counts.append(len(spans))
            yield pd.DataFrame({"source_table": table_name, "row_id": pdf["id"], "text": out, "redactions": counts}).astype({"redactions": "int32"})

    return run


REDACTED = "source_table string, row_id bigint, text string, redactions int"


def redacted(texts: DataFrame, snippets: DataFrame, entities: DataFrame, sample_texts: int = 1000) -> DataFrame:
    """``texts`` (id, text) with typed placeholders: rows (id, text, redactions)."""
    detector = texts.sparkSession.sparkContext.broadcast(fit_detector(texts, snippets, entities, sample_texts))
    out = texts.select(F.col("id").cast("bigint").alias("id"), "text").mapInPandas(_redacting(detector, "document_texts"), REDACTED)
    return out.select(F.col("row_id").alias("id"), "text", "redactions")


def redacted_tables(texts: DataFrame, mentions: DataFrame, entities: DataFrame, sample_texts: int = 1000) -> DataFrame:
    """Every row of both tables with typed placeholders: rows (source_table, row_id, text, redactions).

    A mention's own name stays in its snippet, as in ``personal_data``.
    """
    t = texts.select(F.col("document_id").cast("bigint").alias("id"), F.col("full_text").alias("text"))
    m = mentions.select(F.col("id").cast("bigint").alias("id"), F.col("context_snippet").alias("text"), F.col("name_as_appears").alias("own"))
    detector = texts.sparkSession.sparkContext.broadcast(fit_detector(t.filter("id is not null"), m.filter("id is not null and text is not null"), entities, sample_texts))
    return t.mapInPandas(_redacting(detector, "document_texts"), REDACTED).unionAll(m.mapInPandas(_redacting(detector, "mentions"), REDACTED))
