"""Problem 1: variant spellings of names, linked by blocking, comparison and components.

Every name of an entity row (canonical, aliases, names of its mentions) is parsed into
a form: family and given name of a person, rare word, trade and legal form of an
organisation, rare word and kind of a place. Titles, order, case, accents, initials,
written abbreviations and nicknames are taken into account there. Then

1. rows with one and the same full form are linked (stars around the least id);
2. full forms are blocked by the phonetic codes of their sorted tokens, the rare
   token's code also with any one letter left out, and compared token by token: Jaro-Winkler
   decides, given names that the nickname table makes equal being equal; large blocks are
   cut, and their parts compared by different tasks;
3. a row that has weak forms only (initials, family name alone, shortened firm) is
   linked if exactly one cluster fits;
and accepted links are clustered by connected components.

People who only share a family name and organisations that only share the rare word
are not linked: given name or trade must agree as well. How many rows bear a form plays no
part. Null and empty names and rows without any
parsed name link nothing. Repeated rows of an id count once.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordspark.llm.nicknames import TITLES, formal_names
from recordspark.operators.components import connected_components
from recordspark.session import cut

# Legal forms and kinds of place with their written abbreviations.
LEGAL = {
    "department": "dept", "holdings": "hldgs", "trust": "tr", "international": "intl", "company": "co", "limited": "ltd", "partners": "ptnrs", "cooperative": "co-op coop", "foundation": "fdn", "association": "assn assoc",
    "corporation": "corp", "incorporated": "inc", "services": "svcs svc", "institute": "inst", "brothers": "bros", "group": "grp", "agency": "agcy", "bureau": "bur", "society": "soc", "university": "univ", "committee": "cttee",
}
PLACES = {"airfield": "afd airf", "county": "co cty", "island": "isl is", "point": "pt", "estate": "est", "valley": "vly", "harbour": "hbr harb harbor", "terminal": "term tml", "airport": "apt", "bay": "", "beach": "bch", "ranch": "", "street": "st", "square": "sq", "city": "", "river": "", "mountain": "mt"}
LITTLE = frozenset("the of and de la le uk us usa plc llc gmbh".split())
WORD = re.compile(r"[a-z]+(?:['’][a-z]+)*")
LIKE = 0.88  # likeness from which two forms are one name


def distance_one(a: str, b: str) -> bool:
    """Whether two words differ by at most one letter changed, lost, added or swapped with its neighbour."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def jaro_winkler(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in range(len(b)) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


SOUNDS = str.maketrans({"b": "B", "p": "B", "f": "F", "v": "F", "c": "K", "k": "K", "q": "K", "g": "K", "x": "K", "j": "K", "s": "S", "z": "S", "d": "T", "t": "T", "l": "L", "m": "M", "n": "M", "r": "R", **dict.fromkeys("aeiouyhw", "")})


@lru_cache(maxsize=200_000)
def phonetic(word: str) -> str:
    """Consonants of a word by sound, runs once, with its first letter's sound."""
    code = re.sub(r"(.)\1+", r"\1", word.replace("ph", "f").replace("ck", "k").translate(SOUNDS))
    return ("A" if word[:1] in "aeiou" else "") + code


def plain(name: str) -> str:
    """Without accents; ligatures and widths folded."""
    return "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))


@lru_cache(maxsize=1)
def _forms() -> tuple[dict[str, str], dict[str, str]]:
    def spread(table):
        return {x: full for full, short in table.items() for x in (full, *short.split())}

    return spread(LEGAL), spread(PLACES)


@lru_cache(maxsize=100_000)
def given_names(word: str) -> frozenset[str]:
    """The full given names a word may stand for, one slip of the pen allowed; empty if none."""
    known = formal_names()
    if word in known:
        return known[word]
    if len(word) < 4:
        return frozenset()
    near = {f for w, full in known.items() if len(w) >= 4 and w in full and distance_one(w, word) for f in full}
    if not near and len(word) >= 4:
        near = {f for w, full in known.items() if len(w) >= 4 and w not in full and w[0] == word[0] and distance_one(w, word) for f in full}
    return frozenset(near) if len(near) == 1 else frozenset()


def _joined(name: str) -> str:
    """A word torn by a blank put together again: after a double blank, or before a small letter."""
    parts = re.split(r"\s{2,}", name.strip())
    if len(parts) == 2 and len(parts[1].split()) == 2:
        name = parts[0] + " " + parts[1].replace(" ", "")
    return re.sub(r"\b([A-Z][a-z]{0,4}) ([a-z]{2,})\b", lambda m: m.group() if m[2] in LITTLE or m[1].lower() in LITTLE else m[1] + m[2], name) if re.search(r"[A-Z]", name) and not name.islower() else name


def parse_person(name: str) -> tuple[str, str, str] | None:
    """(family, full given names apart by |, initial); a part that is not told is ''."""
    name = _joined(plain(name))
    comma = re.match(r"^\s*([^,]+),\s*([^,]+?)\s*$", name)
    words = re.findall(r"[A-Za-z]+(?:['’\-][A-Za-z]+)*\.?", name)
    while words and (words[0].lower().rstrip(".") in TITLES or (words[0].endswith(".") and 2 <= len(words[0].rstrip(".")) <= 5 and len(words) > 1 and not given_names(words[0].lower().rstrip(".")) and len(words[0]) > 2)):
        words = words[1:]
    words = [w for w in words if w.lower().rstrip(".") not in ("jr", "sr", "esq", "phd", "md", "ii", "iii")]
    if not words:
        return None
    low = [w.lower().rstrip(".") for w in words]
    long = [i for i, w in enumerate(low) if len(w) > 1]
    if not long:
        return None
    if comma and len(low) >= 2:
        family, rest = low[0], low[1:]
        if given_names(family) and not any(given_names(r) for r in rest if len(r) > 1) and any(len(r) > 1 for r in rest):
            family, rest = next(r for r in rest if len(r) > 1), [family]
    elif len(long) == 1:
        family, rest = low[long[0]], [w for i, w in enumerate(low) if i != long[0]]
        if not rest and family in formal_names():
            return None  # a lone given name
    else:
        first, last = long[0], long[-1]
        exact_first, exact_last = low[first] in formal_names(), low[last] in formal_names()
        capital_first = words[first].isupper() and not words[last].isupper()
        swap = capital_first or (exact_last and not exact_first) or (not exact_first and not exact_last and bool(given_names(low[last])) and not given_names(low[first]))
        family, rest = (low[first], [w for i, w in enumerate(low) if i != first]) if swap else (low[last], [w for i, w in enumerate(low) if i != last])
    given = next((w for w in rest if len(w) > 1), None)
    if given is None:
        initial = next((w for w in rest if len(w) == 1), "")
        return family, "", initial
    full = given_names(given) or frozenset([given])
    return family, "|".join(sorted(full)), min(full)[0] if len({f[0] for f in full}) == 1 else ""


def parse_firm(name: str, trades: frozenset[str]) -> tuple[str, str, str] | None:
    """(rare word, trade, legal form). A shortened trade ends with '.', initials are 't.f.'; '' where not told."""
    legal, _ = _forms()
    name = plain(name)
    name = re.sub(r"\([^)]*\)", " ", name)
    initials = re.search(r"\b([A-Za-z])\.\s?([A-Za-z])\.?(?:\s|$)", name)
    if initials:
        name = name[: initials.start()] + " " + name[initials.end() :]
    name = re.sub(r"(?i)\bco-op\b", "cooperative", name)
    words = re.findall(r"[a-z]+\.?", _joined(name).lower().replace("'", ""))
    core, trade, form = [], "", ""
    for w in words:
        bare = w.rstrip(".")
        if bare in LITTLE or not bare:
            continue
        if bare in legal and not form:
            form = legal[bare]
        elif bare in trades and not trade:
            trade = bare
        else:
            core.append(w)
    if len(core) > 1:  # slips in common words
        rest = []
        for w in core:
            bare = w.rstrip(".")
            near = next((f for f in LEGAL if not form and len(bare) >= 5 and distance_one(bare, f)), None)
            trade_near = [t for t in trades if not trade and len(bare) >= 4 and distance_one(bare, t)]
            if near and len(rest) + 1 <= len(core):
                form = near
            elif len(trade_near) == 1:
                trade = trade_near[0]
            else:
                rest.append(w)
        core = rest or core
    if len(core) > 1 and not trade:
        short = [w for w in core if 3 <= len(w.rstrip(".")) <= 6 and w.endswith(".")] or [w for w in core[1:] if len(w) <= 5 and any(t.startswith(w.rstrip(".")[:3]) for t in trades)]
        if short:
            trade = short[0].rstrip(".") + "."
            core = [w for w in core if w != short[0]]
    if not core:
        return None
    core = [w.rstrip(".") for w in core]
    word = max(core, key=len) if len(core) > 1 and not trade else core[0]
    if len(core) > 1 and not trade:
        others = [w for w in core if w != word]
        trade = others[0] if others else ""
    if initials and not trade and not form:
        trade, form = "", f"{initials[1].lower()}.{initials[2].lower()}."
    return word, trade, form


def parse_place(name: str) -> tuple[str, str, str] | None:
    _, places = _forms()
    words = [w for w in re.findall(r"[a-z]+", _joined(plain(name)).lower()) if w not in LITTLE]
    kind, core = "", []
    for w in words:
        if w in places and not kind:
            kind = places[w]
        else:
            core.append(w)
    if len(core) > 1 and not kind:
        for w in core[:]:
            near = [p for p in PLACES if len(w) >= 4 and distance_one(w, p)]
            if near and len(core) > 1:
                kind = near[0]
                core.remove(w)
    return ("".join(core), kind, "") if core else None


def _class(kind: str | None, name: str, trades: frozenset[str]) -> str:
    k = (kind or "").lower()
    if k.startswith("per"):
        return "P"
    if k.startswith("org") or k in ("company", "corporation"):
        return "O"
    if k in ("location", "loc", "gpe", "fac", "place"):
        return "L"
    legal, places = _forms()
    words = re.findall(r"[a-z]+", plain(name).lower())
    if any(w in legal and (len(w) > 3 or w in ("inc", "ltd")) for w in words) or (any(w in trades for w in words) and not any(w in formal_names() for w in words)):
        return "O"
    if any(w in PLACES for w in words):
        return "L"
    return "P"


def _parse(batches, trades: frozenset[str]):
    for pdf in batches:
        rows = []
        for entity, name, kind, first in zip(pdf["entity_id"].tolist(), pdf["name"].tolist(), pdf["kind"].tolist(), pdf["first"].tolist()):
            cls = _class(kind, name, trades)
            if cls == "P":
                got = parse_person(name)
                if not got:
                    continue
                family, given, initial = got
                if not given and first and (not initial or plain(first).lower().startswith(initial)):
                    given = "|".join(sorted(given_names(plain(first).lower()) or {plain(first).lower()}))
                    initial = given[0]
                full = bool(given) and "|" not in given and len(family) > 1
                rows.append((entity, cls, family, given, initial, full))
            else:
                got = parse_firm(name, trades) if cls == "O" else parse_place(name)
                if not got:
                    continue
                word, trade, form = got
                full = bool(trade) and not trade.endswith(".")
                rows.append((entity, cls, word, trade, form, full))
        yield pd.DataFrame(rows, columns=["entity_id", "cls", "rare", "other", "third", "full"]).drop_duplicates()


FORMS = "entity_id bigint, cls string, rare string, other string, third string, full boolean"


def names_of(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows (entity_id, name, kind, first), distinct."""
    own = entities.select(F.col("id").cast("bigint").alias("entity_id"), F.col("entity_type").alias("kind"), F.col("first_name").alias("first"), "canonical_name", "aliases").filter("entity_id is not null")
    listed = own.select("entity_id", F.explode(F.array_distinct(F.concat(F.array("canonical_name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"))
    seen = mentions.select(F.col("entity_id").cast("bigint").alias("entity_id"), F.col("name_as_appears").alias("name")).filter("entity_id is not null").distinct()
    every = listed.unionAll(seen).filter(F.col("name").rlike(r"\p{L}")).distinct()
    about = own.groupBy("entity_id").agg(F.max("kind").alias("kind"), F.max("first").alias("first"))
    return every.join(about, "entity_id")


def trade_words(entities: DataFrame, share: float = 1 / 1000, least: int = 3) -> frozenset[str]:
    """Words that stand in organisation names beside many different rare words.

    At most a few thousand, as each takes ``share`` of all organisation names. A rare
    word of several firms stands beside many trades, so words that are frequent
    neighbours themselves do not count the second time; shortened words never do.
    """
    firms = entities.filter(F.lower("entity_type").startswith("org") & F.col("canonical_name").isNotNull())
    tokens = firms.select(F.expr(r"array_distinct(regexp_extract_all(lower(canonical_name), '[a-z]{4,}(?![a-z.])', 0))").alias("w"))
    listed = sorted({x for full, short in LEGAL.items() for x in (full, *short.split())})
    pairs = tokens.select(F.explode("w").alias("word"), "w").select("word", F.explode("w").alias("beside")).filter("word <> beside").distinct()
    pairs = pairs.filter(~F.col("beside").isin(listed) & ~F.col("word").isin(listed))
    needed = max(least, int(share * tokens.count()))
    often = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= needed).select("word")
    rare = pairs.join(often.withColumnRenamed("word", "beside"), "beside", "left_anti")
    words = rare.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= needed)
    return frozenset(r["word"] for r in words.collect())


def slips(a: str, b: str, most: int) -> int:
    """Letters changed, lost, added or swapped with their neighbour between two words; ``most`` + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            n = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if before and j > 1 and x == b[j - 2] and y == a[i - 2]:
                n = min(n, before[j - 2] + 1)
            new.append(n)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def likeness(rare: str, other: str, rare2: str, other2: str, known: frozenset[str] = frozenset()) -> float:
    """Likeness of two full forms from 0 to 1: the lesser of that of their tokens, aligned.

    Jaro-Winkler counts what two words begin with most, so words of one beginning and other endings, with more than a slip
    for every four letters, are different. Two different words that are known both (given names, trades) are different. A word of under five letters has
    hardly anything to tell a slip by, so its likeness counts half as much short of 1 again.
    """
    out = 1.0
    for a, b, listed in ((other, other2, True), (rare, rare2, False)):
        if a == b:
            continue
        if listed and all(w in known or w in formal_names() for w in (a, b)):
            return 0.0
        j = jaro_winkler(a, b)
        out = min(out, j if min(len(a), len(b)) >= 5 else 1 - 1.5 * (1 - j))
        if out < LIKE:
            break
        most = max(1, min(len(a), len(b)) // 4)
        if slips(a, b, most) > most:
            return 0.0
    return out


def _blocks(batches):
    for pdf in batches:
        rows = []
        for key, cls, rare, other in zip(pdf["key"].tolist(), pdf["cls"].tolist(), pdf["rare"].tolist(), pdf["other"].tolist()):
            code = phonetic(rare)
            for c in {code, *(code[:i] + code[i + 1 :] for i in range(len(code)))} if len(code) > 2 else {code}:
                rows.append(("|".join([cls, *sorted([c, phonetic(other)])]), key, rare, other))
        yield pd.DataFrame(rows, columns=["block", "key", "rare", "other"])


def _compare(batches, known: frozenset[str]):
    """Accepted pairs (a, b) of the keys of each block."""
    for pdf in batches:
        rows = set()
        for left, right in zip(pdf["lefts"], pdf["rights"]):
            left = [x for x in left]
            pairs = ((x, y) for i, x in enumerate(left) for y in left[i + 1 :]) if right is None or not len(right) else ((x, y) for x in left for y in right)
            for x, y in pairs:
                if x["key"] != y["key"] and likeness(x["rare"], x["other"], y["rare"], y["other"], known) >= LIKE:
                    rows.add((min(x["key"], y["key"]), max(x["key"], y["key"])))
        yield pd.DataFrame(sorted(rows), columns=["a", "b"])


def like_keys(keys: DataFrame, block_size: int = 300, known: frozenset[str] = frozenset()) -> DataFrame:
    """Accepted pairs (a, b) among full forms (key, cls, rare, other); ``known`` are the trades."""
    placed = cut(keys.mapInPandas(_blocks, "block string, key string, rare string, other string"))
    sizes = placed.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(block_size)).cast("int").alias("parts"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    placed = placed.join(sizes.select("block", "parts"), "block").withColumn("p", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    placed = placed.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own, item = F.col("p") <= F.col("q"), F.struct("key", "rare", "other")
    parts = placed.groupBy("block", F.least("p", "q").alias("p1"), F.greatest("p", "q").alias("p2")).agg(F.collect_list(F.when(own, item)).alias("lefts"), F.collect_list(F.when(~own, item)).alias("rights"))
    parts = parts.filter((F.col("p1") == F.col("p2")) | ((F.size("lefts") > 0) & (F.size("rights") > 0)))
    return parts.select("lefts", "rights").mapInPandas(lambda it: _compare(it, known), "a string, b string").distinct()


def _fits(other: F.Column, third: F.Column, o: F.Column, t: F.Column) -> F.Column:
    """Whether a weak form (other, third) of a firm or place fits a full one (o, t)."""
    short = F.when(other == "", True).otherwise(o.startswith(F.regexp_replace(other, r"\.$", "")))
    letters = (F.length(third) == 4) & third.endswith(".") & (F.substring(third, 2, 1) == ".")
    same = F.when(letters, (F.substring(third, 1, 1) == F.substring(o, 1, 1)) & ((t == "") | (F.substring(third, 3, 1) == F.substring(t, 1, 1)))).otherwise((third == "") | (t == "") | (third == t))
    return short & same


def same_entities(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """Rows (entity_id, cluster): every row that has another row of the same real entity; cluster is the least id."""
    trades = trade_words(entities)
    forms = cut(names_of(entities, mentions).mapInPandas(lambda it: _parse(it, trades), FORMS).distinct())
    # of a firm's full form the legal form only keeps different firms apart; one without it takes its trade's
    key = F.concat_ws("|", "cls", "rare", "other")
    full = forms.filter("full").select("entity_id", "cls", "rare", "other", "third", key.alias("key"))
    stars = full.groupBy("key").agg(F.min("entity_id").alias("first"))
    exact = full.select("key", "entity_id").distinct().join(stars, "key").filter("entity_id <> first").select(F.col("first").alias("src"), F.col("entity_id").alias("dst"))
    keys = full.select("key", "cls", "rare", "other").distinct()
    near = like_keys(keys, known=trades).join(stars.select(F.col("key").alias("a"), F.col("first").alias("src")), "a").join(stars.select(F.col("key").alias("b"), F.col("first").alias("dst")), "b").select("src", "dst")
    strong = exact.unionAll(near).filter("src <> dst")  # the clustering makes it distinct and cuts its lineage
    clusters = connected_components(strong).withColumnsRenamed({"node": "entity_id", "component": "cluster"})

    # rows whose full forms, if any, linked to nothing: the one cluster that fits a weak form, and no own full form denies
    own = full.groupBy("entity_id").agg(F.collect_set("other").alias("own"))
    weak = forms.filter("not full").join(clusters.select("entity_id"), "entity_id", "left_anti").join(own, "entity_id", "left")
    target = full.join(clusters, "entity_id", "left").select("cls", F.col("rare").alias("rare"), F.col("other").alias("o"), F.col("third").alias("t"), F.coalesce("cluster", "entity_id").alias("cluster")).distinct()
    # targets are counted per key first, so a family name of many people joins as few rows
    size = (F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count_distinct("cluster").alias("k"))
    told = F.when(F.col("other") != "", F.split("other", r"\|"))
    options = F.when(F.col("own").isNull(), told).when(told.isNotNull(), F.array_intersect("own", told)).when(F.col("third") != "", F.filter("own", lambda x: F.substring(x, 1, 1) == F.col("third"))).otherwise(F.col("own"))
    # one key per way to name a person: in full, by initial, by family name alone; one per rare word of a firm or place
    full_key = lambda x: F.concat(F.lit("n|"), F.col("rare"), F.lit("|"), x)
    keys_of = F.when(F.col("cls") == "P", F.array(full_key(F.col("o")), F.concat(F.lit("i|"), F.col("rare"), F.lit("|"), F.substring("o", 1, 1)), F.concat(F.lit("f|"), F.col("rare")))).otherwise(F.array(F.concat_ws("|", "cls", "rare")))
    firm = F.col("cls") != "P"
    counted = target.select(F.explode(keys_of).alias("key"), F.when(firm, F.col("o")).alias("o"), F.when(firm, F.col("t")).alias("t"), "cluster").groupBy("key", "o", "t").agg(*size)
    asked = F.when(firm, F.array(F.concat_ws("|", "cls", "rare"))).when(options.isNotNull(), F.transform(options, full_key)).when(F.col("third") != "", F.array(F.concat(F.lit("i|"), F.col("rare"), F.lit("|"), F.col("third")))).otherwise(F.array(F.concat(F.lit("f|"), F.col("rare"))))
    met = weak.select("entity_id", "cls", "other", "third", "own", F.explode(asked).alias("key")).join(counted, "key")
    met = met.filter(~firm | (_fits(F.col("other"), F.col("third"), F.col("o"), F.col("t")) & (F.col("own").isNull() | F.expr("array_contains(own, o)"))))
    # a row's own forms are among the targets; without them one cluster is left, or several
    me = F.col("entity_id")
    other = F.when((F.col("k") == 1) & (F.col("low") != me), F.col("low")).when((F.col("k") == 2) & (F.col("low") == me), F.col("high")).when((F.col("k") == 2) & (F.col("high") == me), F.col("low"))
    fits = met.filter("not (k = 1 and low = entity_id)").select("entity_id", other.alias("cluster"))
    only = fits.groupBy("entity_id").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high"), F.count_if(F.col("cluster").isNull()).alias("open")).filter("low = high and open = 0").select(F.col("low").alias("src"), F.col("entity_id").alias("dst"))
    # weak rows of one form that no cluster fits are one another's
    lone = weak.filter("own is null").join(fits.select("entity_id").distinct(), "entity_id", "left_anti").filter("(cls = 'P' and (third <> '' or other <> '')) or cls <> 'P'")
    lone = lone.select("entity_id", F.concat_ws("|", "cls", "rare", F.when(F.col("cls") == "P", F.col("third")).otherwise(F.concat("other", F.lit("|"), "third"))).alias("key"))
    heads = lone.groupBy("key").agg(F.min("entity_id").alias("src"))
    alone = lone.join(heads, "key").filter("entity_id <> src").select("src", F.col("entity_id").alias("dst"))
    # the clusters found above are stars already, so that few rounds are left
    stars_ = clusters.filter("entity_id <> cluster").select(F.col("cluster").alias("src"), F.col("entity_id").alias("dst"))
    linked = connected_components(stars_.unionAll(only).unionAll(alone))
    return linked.select(F.col("node").alias("entity_id"), F.col("component").alias("cluster"))


def same_pairs(clusters: DataFrame) -> DataFrame:
    """Every pair (entity_id_1 < entity_id_2) within a cluster."""
    a, b = clusters.select("cluster", F.col("entity_id").alias("entity_id_1")), clusters.select("cluster", F.col("entity_id").alias("entity_id_2"))
    return a.join(b, "cluster").filter("entity_id_1 < entity_id_2").select("entity_id_1", "entity_id_2")
