"""Problem 10: abusive, hateful or sexual content, by a weighted finite-state pattern grammar.

Transducers in a cascade, each reading what the one before it writes:

1. words to word classes (``lexicon.py``: stems of four languages and rules that inflect
   them), disguises undone: separators inside a word, digits and signs for letters,
   repeated letters, masked letters, letters spelled out one by one. A class symbol
   carries the word's own weight;
2. class symbols to phrases: address, insulting noun phrase, threatened person or
   thing, group, exclusion, bodily and sexual words (``NETWORKS``);
3. phrases to clauses of one kind: insult, threat, hate, sexual (``CLAUSES``). The
   weight of a path is the product of its arcs: the clause's, those of the scored words
   in it, and one for each word skipped in a gap;
4. the context of a matched clause: negation and indirect report lower its weight, so
   that a sober account of abuse is not abuse, while words quoted as they were said are.

Phrases and clauses are composed by substitution into one automaton per clause, which
runs over a text's symbols; no path crosses the end of a sentence. A clause weighs as its
best path in its best context. A text's score is the greatest clause weight, with a
little for further clauses.

Null, empty and blank texts score 0. Repeated rows give one row per id. Very long
texts are read whole.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.lexicon import compound, lexicon

# Phrases over classes. A part is a class, A|B for several, <NAME> for another phrase, ~n for up to n words skipped;
# ? and * make a part optional or repeat it, ! makes the word's own weight count.
NETWORKS: dict[str, str] = {
    "SLUR_NP": "DET? ADV* ADJ!* INSULT! ADJ!*",  # an insulting noun phrase, adjectives on either side
    "COARSE_NP": "DET? ADV* ADJ! ADJ!* INSULT!",  # one with a derogatory adjective
    "ARE": "ADV* BE NEG? ADV*",
    "INTENT": "<SELF_WILL> ADV*",
    "SELF_WILL": "I ~1 WILL|GOING GOING? TO?",
    "GOODS": "YOUR ~2 BODY|KIN",
    "PERSON": "OBJ|HIM",
    "GROUP_NP": "THESE|ALL|DET? ADJ* GROUP|SLUR",
    "CAST_OUT": "SHOULD ALL|ADV* TO? BE? ALL|ADV* OUTS|THROW",
    "WHOLE": "~2 EACHONE|ONE",
    "LOW": "DET? ADJ* DEHUMAN|INSULT",
}

# Kind, weight and path of every clause. A rule whose NEG or NOBODY is its own meaning is not lowered for it.
CLAUSES: tuple[tuple[str, float, str], ...] = (
    # insults: address and predicate, address and name, name calling, orders to be silent or to crawl, curses
    ("insult", 0.95, "YOU <ARE> <SLUR_NP>"),
    ("insult", 0.95, "YOU ~1 <SLUR_NP>"),
    ("insult", 0.9, "YOU <ARE> ~1 INSULT!"),
    ("insult", 0.9, "INSULT! LIKE YOU"),
    ("insult", 0.9, "ERES ADV* <SLUR_NP>"),
    ("insult", 0.9, "YOU ~1 BE DET ADV* ADJ!* INSULT!"),
    ("insult", 0.85, "WHAT DET ADV* ADJ!* INSULT!"),
    ("insult", 0.9, "YOUR KIN <ARE> <SLUR_NP>"),
    ("insult", 0.9, "KINDOF ~2 INSULT!"),
    ("insult", 0.9, "YOU BE DET ADJ* CON"),
    ("insult", 0.9, "<COARSE_NP>"),
    ("insult", 0.85, "INSULT! ADJ!"),
    ("insult", 0.85, "INSULT! ~1 SHIT"),
    ("insult", 0.95, "SHUT ADV* YOUR|DET|UP ADV* MOUTH|UP ~1 <SLUR_NP>"),
    ("insult", 0.75, "SHUT ADV* YOUR|DET? MOUTH"),
    ("insult", 0.55, "SHUT UP"),
    ("insult", 0.95, "SHUT ~3 <SLUR_NP>"),
    ("insult", 0.8, "SHUT ~4 SHIT"),
    ("insult", 0.8, "CRAWL BACK UNDER"),
    ("insult", 0.9, "TYPICAL ~1 INSULT!"),
    ("insult", 0.95, "FUCKYOU|FUCK OFFYOU|SELF"),
    ("insult", 0.9, "GO ~3 FUCK|FUCKYOU SELF|OFFYOU"),
    ("insult", 0.9, "GO ~2 SHIT|HELL|FOUTRE"),
    ("insult", 0.9, "OBJ FOUTRE"),
    ("insult", 0.9, "CURSE YOU"),
    ("insult", 0.85, "CRUDE"),
    ("insult", 0.6, "SLUR"),
    # threats: intent, act and person or thing; harm foretold, wished or urged
    ("threat", 0.95, "<INTENT> NEG? ~1 KILL ~2 <PERSON>"),
    ("threat", 0.95, "<INTENT> NEG? ~1 VIOLENT|KILL ~1 <GOODS>"),
    ("threat", 0.9, "<INTENT> ~1 PUT|KILL <PERSON> IN DET? GRAVE"),
    ("threat", 0.9, "VOY TO? VIOLENT|KILL ~1 <GOODS>"),
    ("threat", 0.9, "VOY TO? ~1 KILL_YOU"),
    ("threat", 0.85, "NEG YOU ADV* KILL|JUMP SELF"),
    ("threat", 0.9, "I NEG? OBJ WILL|GOING TO? KILL"),
    ("threat", 0.9, "NEG? OBJ WILL TO KILL"),
    ("threat", 0.9, "I WILL ~1 OBJ ~2 KILL"),
    ("threat", 0.9, "I WILL ~1 <GOODS> ~1 VIOLENT|KILL"),
    ("threat", 0.85, "I OBJ KILL"),
    ("threat", 0.85, "OBJ KILL ~2 INSULT!|ADJ!"),
    ("threat", 0.9, "I? BRING OBJ UM"),
    ("threat", 0.9, "BRING I OBJ UM"),
    ("threat", 0.85, "YOU WILL ~1 SUFFER"),
    ("threat", 0.85, "YOU ADV* BE ADV* DEAD"),
    ("threat", 0.7, "I KNOW WHERE YOU LIVE"),
    ("threat", 0.7, "WATCH YOUR BACK"),
    ("threat", 0.9, "HOPE ~1 YOU|OBJ ~2 SUFFER"),
    ("threat", 0.9, "I ~2 MAKE OBJ PAIN"),
    ("threat", 0.85, "HOPE YOUR ~2 KIN ~1 SUFFER"),
    ("threat", 0.85, "YOU DESERVE ~1 SUFFER"),
    ("threat", 0.9, "HOPE ~2 DIEYOU"),
    ("threat", 0.85, "SUFFER IN HELL"),
    ("threat", 0.8, "DIEYOU ADV* YOU|INSULT!|ADJ!"),
    ("threat", 0.75, "DIEYOU ADV"),
    ("threat", 0.9, "GO ADV* SUFFER"),
    ("threat", 0.9, "KILL|JUMP SELF"),
    ("threat", 0.9, "GO AND? JUMP ~3 HIGH"),
    ("threat", 0.9, "NOBODY ~2 MISS YOU"),
    ("threat", 0.9, "NOBODY OBJ MISS"),
    # hatred of a group: lowered to beasts, made criminals by birth, to be cast out, shut out or put to death
    ("hate", 0.9, "BE ADV* <LOW> AND ~1 <CAST_OUT>"),
    ("hate", 0.9, "BE NEG HUMAN AND ~1 <CAST_OUT>"),
    ("hate", 0.9, "BE ADV* CRIME BY BLOOD"),
    ("hate", 0.85, "BE NEG HUMAN"),
    ("hate", 0.85, "<CAST_OUT> <WHOLE>"),
    ("hate", 0.9, "<GROUP_NP> ~2 BE ADV* <LOW>"),
    ("hate", 0.9, "<GROUP_NP> ~2 <CAST_OUT>"),
    ("hate", 0.9, "THESE DET? ADJ* INSULT! ADJ* ~3 <CAST_OUT>"),
    ("hate", 0.9, "TO? THESE ADJ* INSULT!|GROUP ADJ* ~1 SHOULD ~6 THROW"),
    ("hate", 0.85, "BREED LIKE PEST"),
    ("hate", 0.85, "OBJ BREED LIKE PEST"),
    ("hate", 0.9, "NEG ~2 SHOULD ~1 BE ALLOWED ~9 TOO STUPID"),
    ("hate", 0.9, "GROUP ~3 BE CAPACITY ~1 GOODFOR"),
    ("hate", 0.85, "GROUP ~3 GOODFOR|SHOULD ~3 PLACE"),
    ("hate", 0.85, "GO ~1 BACK TO|WHERE YOUR|YOU ~1 COUNTRY|LIVE"),
    ("hate", 0.85, "GROUP RAUS"),
    ("hate", 0.85, "RAUS ~2 GROUP"),
    ("hate", 0.9, "DEATH TO|DET|BY? DET|ALL? GROUP"),
    ("hate", 0.85, "I ADV* HATE ~1 GROUP"),
    ("hate", 0.9, "KILL ALL ~1 GROUP"),
    ("hate", 0.85, "KILL THESE|DET ADJ* GROUP"),
    # sexually explicit: likenesses asked for, bodies imagined, acts told or wanted
    ("sexual", 0.9, "SEND ME ~2 NUDE LIKENESS"),
    ("sexual", 0.9, "SEND ME ~3 LIKENESS ~2 NUDE"),
    ("sexual", 0.9, "SENDME ~2 LIKENESS ~2 NUDE"),
    ("sexual", 0.9, "SEND|SENDME ~2 NUDES"),
    ("sexual", 0.9, "VOY TO? FUCK_YOU"),
    ("sexual", 0.85, "TOUCHING SELF"),
    ("sexual", 0.9, "THINK ABOUT? YOU ~2 NUDE"),
    ("sexual", 0.9, "MOAN UNDER|IN ME|HIM"),
    ("sexual", 0.9, "HIM|ME ONTO DET BEDROOM ~3 NUDE"),
    ("sexual", 0.85, "PULL HIM|ME ONTO DET BEDROOM ~2 SWEAT"),
    ("sexual", 0.85, "HAVE ROUGH SEX"),
    ("sexual", 0.9, "SPREAD YOUR LEGS"),
    ("sexual", 0.85, "SPREAD OFF AND TOUCHING"),
    ("sexual", 0.9, "I ~2 GOING|WILL TO? FUCK OBJ"),
    ("sexual", 0.9, "I ~1 GOING|WILL ~3 FUCK"),
    ("sexual", 0.9, "SUCK|SUCKME ~1 MY|YOUR|HIS ~1 GENITAL"),
    ("sexual", 0.85, "I GOING OBJ|YOU NUDE"),
    ("sexual", 0.85, "MY|YOUR ~1 GENITAL"),
)
GAP, NEGATED, TOLD, MORE = 0.95, 0.3, 0.4, 0.02

LEET = str.maketrans("013457@$!|€+", "oieastasiiet")
OUTER = "\"'“”‘’«»()[]{}<>,;:.!?…—–-¡¿"
BREAKS = re.compile(r"\n[\s>|]*\n[\s>|]*|(?<=[^\W_][^\W_])[.!?…]+[\"'”’»)*]*(?=\s+[^a-zß-ÿ\s])|(?<=[*\"'”’)])[.!?]+(?=\s)|[.!?]+[\"”»](?=\s)")
QUOTES = re.compile(r"[\"“”„«»]")
LINE = re.compile(r"\n[\s>|]*")
CONTRACTED = (("'ll ", " will "), ("'re ", " are "), ("i'm ", "i am "), ("n't ", " not "))
END, QUOTE, OTHER = "¶", "”", "x"


def _squeeze(w: str) -> str:
    return re.sub(r"(.)\1+", r"\1", w)


class Symbols(dict):
    """The first transducer: a word, disguised or not, to the symbol of its classes and weight; learns words as they come."""

    def __init__(self):
        super().__init__({END: END, QUOTE: QUOTE})
        self.words = lexicon()
        strong = {w for w, (k, _) in self.words.items() if k & {"INSULT", "ADJ", "NUDE", "VIOLENT", "SUFFER", "SLUR", "CRUDE", "FUCK"} and len(w) > 2}
        self.squeezed: dict[str, str] = {}
        self.masked: dict[tuple[int, str], list[str]] = {}
        for w in sorted(strong, reverse=True):
            self.squeezed[_squeeze(w.replace("-", ""))] = w
            if self.words[w][0] & {"INSULT", "ADJ", "SLUR", "FUCK"}:
                self.masked.setdefault((len(w), w[0]), []).append(w)
        kinds = sorted({k for c, _ in self.words.values() for k in c})
        self.bit = {k: 1 << i for i, k in enumerate(kinds)}
        self.mask: dict[str, int] = {END: 0, QUOTE: 0, OTHER: 0}
        self.weight: dict[str, float] = {}
        self._named: dict[tuple[frozenset[str], float], str] = {}
        for c, w in sorted({(c, v) for c, w in self.words.values() for v in (w, 1.0)} | {(frozenset(["INSULT"]), 1.0)}, key=lambda x: (sorted(x[0]), x[1])):
            s = self._named[c, w] = chr(0xE000 + len(self._named))
            self.mask[s], self.weight[s] = sum(self.bit[k] for k in c), w

    def symbol(self, word: str, disguised: bool = False) -> str:
        c, w = self.words[word]
        return self._named[c, 1.0 if disguised else w]

    def bare(self, token: str) -> str:
        """The symbol of a word; a disguise is evidence, so that a disguised word has full weight."""
        w = token.replace("’", "'").strip(OUTER)
        if w in self.words:
            return self.symbol(w)
        if not w:
            return OTHER
        if "*" in w or "#" in w or "_" in w:
            shape = re.compile("".join("." if c in "*#_" else re.escape(c) for c in w) + "$")
            for x in self.masked.get((len(w), w[0]), ()):
                if shape.match(x):
                    return self.symbol(x, True)
        letters = re.search(r"[^\W\d_]", w)
        plain = re.sub(r"[^\w]|_", "", w.translate(LEET) if letters else w)
        if len(plain) > 2 and plain != w and plain in self.words and self.words[plain][0] & {"INSULT", "ADJ", "NUDE", "SLUR", "FUCK", "VIOLENT"}:
            return self.symbol(plain, True)
        for form in (plain, re.sub(r"[^\w]|_", "", w.replace("1", "l").translate(LEET)) if "1" in w else ""):
            s = _squeeze(form)
            if s in self.squeezed and (form != w or re.search(r"(.)\1\1", form) or len(form) - len(s) > 1):
                return self.symbol(self.squeezed[s], True)
        return self._named[frozenset(["INSULT"]), 1.0] if compound(w) else OTHER

    def __missing__(self, token: str) -> str:
        if len(self) > 300_000:  # a memory of words seen, no more
            self.clear()
            self.update({END: END, QUOTE: QUOTE})
        s = self[token] = self.bare(token)
        return s


def _spelled(tokens: list[str]) -> list[str]:
    """Letters spelled out one by one become one word."""
    out: list[str] = []
    i = 0
    while i < len(tokens):
        j = i
        while j < len(tokens) and len(x := tokens[j].strip(OUTER)) == 1 and x.isalpha():
            j += 1
        if j - i >= 3:
            out.append("_".join(x.strip(OUTER) for x in tokens[i:j]))
            i = j
        else:
            out.append(tokens[i])
            i += 1
    return out


class Clause:
    """One clause's automaton over symbols, composed of its phrases."""

    def __init__(self, kind: str, weight: float, path: str, symbols: Symbols):
        self.kind, self.weight = kind, weight
        self.of = {k: "".join(re.escape(s) for s, m in symbols.mask.items() if m & b) for k, b in symbols.bit.items()}
        self.needs = self._needs(path, symbols)
        self.gaps: list[str] = []
        self.scored: list[str] = []
        self.negatable = not re.search(r"\b(?:NEG|NOBODY)\b(?!\?)", path)
        self.pattern = re.compile(self._compile(path))

    def _parts(self, path: str) -> list[str]:
        out: list[str] = []
        for part in path.split():
            m = re.fullmatch(r"<(\w+)>", part)
            out += self._parts(NETWORKS[m[1]]) if m else [part]
        return out

    def _needs(self, path: str, symbols: Symbols) -> list[int]:
        """Of every part that must be there, the classes of which one must be."""
        return [sum(symbols.bit.get(k, 0) for k in part.replace("!", "").split("|")) for part in self._parts(path) if part[0] != "~" and part[-1] not in "?*"]

    def _compile(self, path: str) -> str:
        out = ""
        for n, part in enumerate(self._parts(path)):
            if part[0] == "~":
                name = f"g{len(self.gaps)}"
                self.gaps.append(name)
                out += f"(?P<{name}>[^{END}]{{0,{part[1:]}}}?)"
                continue
            mode = part[-1] if part[-1] in "?*" else ""
            bare = part.rstrip("?*")
            step = f"{QUOTE}?" if n else ""
            chars = "".join(self.of.get(k, "") for k in bare.replace("!", "").split("|")) or END + "x"
            one = f"[{chars}]" if chars != END + "x" else "(?!)"
            if "!" in bare and mode != "*":
                name = f"s{len(self.scored)}"
                self.scored.append(name)
                one = f"(?P<{name}>{one})"
            elif "!" in bare:
                name = f"s{len(self.scored)}"
                self.scored.append(name)
                out += f"(?P<{name}>(?:{step}{one})*)"
                continue
            out += f"(?:{step}{one}){mode}" if mode else step + one
        return out

    def weigh(self, m: re.Match, symbols: Symbols) -> float:
        """Product of a path's arcs."""
        w = self.weight
        for g in self.gaps:
            w *= GAP ** len(m[g])
        for g in self.scored:
            for s in m[g] or ():
                w *= symbols.weight.get(s, 1.0)
        return w


@lru_cache(maxsize=1)
def grammar() -> tuple[Symbols, list[Clause], re.Pattern, re.Pattern]:
    symbols = Symbols()
    clauses = [Clause(*c, symbols) for c in CLAUSES]
    of = clauses[0].of
    negated = re.compile(f"[{of['NEG']}][^{END}]{{0,2}}$")
    told = re.compile(f"[{of['REPORT']}][^{END}{QUOTE}]{{0,6}}[{of['THAT']}][^{END}{QUOTE}]*$")
    return symbols, clauses, negated, told


def symbols_of(text: str, symbols: Symbols) -> str:
    low = LINE.sub(" ", QUOTES.sub(f" {QUOTE} ", BREAKS.sub(f" {END} ", text)).lower().replace("’", "'")).replace(" d'", " de ")
    for short, full in CONTRACTED:
        low = low.replace(short, full)
    tokens = low.split()
    if any(len(t) == 1 for t in tokens):
        tokens = _spelled(tokens)
    return "".join(map(symbols.__getitem__, tokens))


def clauses_of(text: str) -> list[tuple[int, str, float]]:
    """(sentence, kind, weight) of every sentence with an accepted path, its best one."""
    symbols, clauses, negated, told = grammar()
    line = symbols_of(text, symbols)
    every = 0
    for s in set(line):
        every |= symbols.mask[s]
    best: dict[int, tuple[float, str]] = {}
    for clause in clauses:
        if any(not every & need for need in clause.needs):
            continue
        at = 0
        while (m := clause.pattern.search(line, at)) is not None:
            at = m.start() + 1
            w = clause.weigh(m, symbols)
            begin = line.rfind(END, 0, m.start()) + 1
            if clause.negatable and (negated.search(line, begin, m.start()) or any(symbols.mask[s] & symbols.bit["NEG"] for s in m.group())):
                w *= NEGATED
            if told.search(line, begin, m.start()):
                w *= TOLD
            if w > best.get(begin, (0.0, ""))[0]:
                best[begin] = (w, clause.kind)
    return [(b, kind, w) for b, (w, kind) in sorted(best.items())]


def score_text(text: str) -> tuple[float, str, int]:
    """(score, kind of the heaviest clause, number of abusive clauses)."""
    if not text or not text.strip():
        return 0.0, "", 0
    found = clauses_of(text)
    _, what, best = max(found, key=lambda x: x[2], default=(0, "", 0.0))
    n = sum(w >= 0.5 for _, _, w in found)
    return min(1.0, best + MORE * max(0, n - 1)), what, n


def scored(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Rows (doc_id, source, score, kind, clauses), one per document id."""
    base = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(source).alias("source")).filter("doc_id is not null")

    def run(batches):
        for pdf in batches:
            got = [score_text(t) for t in pdf["text"].tolist()]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": [g[0] for g in got], "kind": [g[1] for g in got], "clauses": [g[2] for g in got]}).astype({"clauses": "int32"})

    return base.mapInPandas(run, "doc_id bigint, source string, score double, kind string, clauses int").dropDuplicates(["doc_id"])


def abuse_rates(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per source: documents, flagged documents and their share; a null source is one of its own."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.sum((F.col("score") >= threshold).cast("bigint")).alias("flagged"), F.avg((F.col("score") >= threshold).cast("double")).alias("share"), F.round(F.avg("score"), 6).alias("mean_score")
    )
