"""Problem 2: texts cut off by field limits.

Each text goes once through a structural check: a stack automaton over the whole text
(quotation marks by language, brackets, tags, records with their strings and escapes),
broken byte sequences and escapes, marks left by a cut, and the last lines, from which page
furniture is taken away. What single texts cannot show comes from the corpus, by
aggregations only:

* field limits: lengths, in characters or bytes, that several different texts of
  a source share, far more than share the lengths near by, and most of which lack their end;
* per-source baselines: where most texts of a source lack a terminator, its
  absence is no evidence; where texts that are otherwise complete leave a kind of mark
  open, neither is that;
* longer states: a text that is a true beginning of another text (neighbours in
  sort order), of its own pages_text, or that has fewer words than were counted;
* cut words: a last word that the corpus, by all words of all texts, knows only as
  the beginning of words.

Null, empty and blank texts are no cases. Repeated rows of an id count once. A null
source is a source of its own.
"""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.llm.emails import CONTACT, HEADER, INITIALS, MOBILE, SIGN_OFF, WROTE
from recordspark.llm.formdup import normalise
from recordspark.session import cut

WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
JVM_WORD = r"\p{L}+(?:['’\-]\p{L}+)*"
LAST_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*\Z")
QUOTE_MARKS = re.compile(r"^(?:\s*[>|])+\s?")
TRACE = re.compile(r"(?:\.{3,}|…|\[\s*(?:text|message|content|rest|remainder|output)?\s*(?:has been\s+)?(?:shortened|truncated|cut(?:\s+off)?|clipped|trimmed|incomplete|snip(?:ped)?|more|continued|\.{3}|…)\s*[^\]]{0,20}\]|<\s*(?:snip|truncated|more|cut)\s*>|\((?:truncated|cut off|continued|more|cont'?d)\)|--\s*more\s*--)\s*$", re.I)
BROKEN = re.compile(r"(?:�|[\ud800-\udfff]|Ã|â€?|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|\\|&(?:[a-z]{2,7}|#\d{0,5})|=[0-9A-F]?|%[0-9A-F]?)\s*$")
TERMINATED = re.compile(r"[.!?。]['\"”’»)\]}*_;]*\s*$")
ABBREVIATED = re.compile(r"(?:\b(?i:no|nos|dr|mr|mrs|ms|prof|capt|mme|vs|cf|fig|sgt|lt|hon|rev)|(?<=[a-z,] )[A-Z])\.$")
PAGE_NUMBER = re.compile(r"^[\[(\-–— ]*(?:page|pg\.?|p\.?|seite|s\.)?\s*(?:[\divxlcoOIl]{1,5}|0\d+)(?:\s*(?:of|/|von)\s*[\divxlcoOIl]{1,5})?[\])\-–— ]*$", re.I)
FURNITURE = re.compile(r"^(?:exhibit\s+\S+|vol\.?\s*\d+\b.*|confidential\b.*|.*\(\d{4}\)|.*\s/\s.*)$", re.I)
CLOSING = re.compile(r"^(?:cc\s*:.*|enclosures?\b.*|encl\.?.*|enc\.?.*|dated\s*:.*|sheet\s+total.*|legs|attachments?\b.*|copy\s+to\b.*|end\s+of\s+\w+|-+\s*end\s*-+|\*+)$", re.I)
FIELD = re.compile(r"^(?:bates (?:begin|end)|custodian|date created|original filename|pages|file size|document title|box|comment)\s*[:=\-]", re.I)
HALF_ADDRESS = re.compile(r"@[\w\-]*$|@[\w\-]+\.$")
FUNCTION = frozenset("the a an of was were by and to that had been in at for from which not is has or although because since while until before after as with on this there no under between if so who whom also whether".split() + "el la los las de del y que por para con una un le les des et une du dans pour der die das und den dem ein eine von mit im auf nach".split())
NOT_WORDS = re.compile(r"\S*@\S*|\S*\d\S*")
SIGNED = re.compile(r"\b(?:sincerely|regards|faithfully|respectfully(?: submitted)?|thanks|wishes|cheers)\b,?\s+[^.!?]{0,60}$|\bcc: \w+$|\benclosures? \(\d\)$|\bsheet total \d+\s+legs$|\bdated: [\w ,/\-]{6,20}$|\bsent (?:from my|via) [\w ]{3,40}$", re.I)
MARK = re.compile(r'["“”„«»()\[\]{}]|</?([a-zA-Z][a-zA-Z0-9]{0,10})(?:\s[^<>]*)?(/?)>|<[a-zA-Z/][^<>]*$')
OPENER = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
VOID = frozenset("br hr img meta input link wbr".split())


def _last(stack: list[tuple[str, str]], mark: str) -> int:
    return next((k for k in range(len(stack) - 1, -1, -1) if stack[k][1] == mark), -1)


def left_open(text: str) -> list[str]:
    """What a stack automaton over the whole text finds open at its end: quote, bracket, tag or record.

    A mark closes the last one of its kind; closing marks without an opening one, as after the numbers of a
    list, close nothing. In a record (a text that begins with a brace) strings hide all marks and a backslash the next sign.
    """
    if text.lstrip()[:1] == "{":
        return ["record"] if _record_open(text) else []
    stack: list[tuple[str, str]] = []
    for m in MARK.finditer(text):
        mark, before = m.group(), text[m.start() - 1 : m.start()]
        if m[1] is not None:
            name = m[1].lower()
            if mark[1] == "/":
                k = _last(stack, "<" + name)
                if k >= 0:
                    del stack[k:]  # with what was left open inside
            elif not m[2] and name not in VOID:
                stack.append(("tag", "<" + name))
        elif mark[0] == "<":
            if "@" not in mark and (m.end() - m.start() < 3 or "=" in mark or mark[1] == "/"):
                stack.append(("tag", mark))
        elif mark == '"':
            k = _last(stack, mark)
            if k >= 0:
                del stack[k]
            elif not before.isdigit():  # an inch mark opens nothing
                stack.append(("quote", mark))
        elif mark in "“„«":
            k = _last(stack, "„") if mark == "“" else -1
            if k >= 0:
                del stack[k]
            else:
                stack.append(("quote", mark))
        elif mark in "([{":
            if mark != "(" or before not in (":", ";", "="):  # a face opens nothing
                stack.append(("bracket", mark))
        else:
            k = _last(stack, OPENER[mark])
            if k >= 0:
                del stack[k]
    return sorted({kind for kind, _ in stack})


def _record_open(text: str) -> bool:
    """Whether a record of braces, brackets and quoted strings ends while open."""
    stack: list[str] = []
    string = escape = False
    for c in text:
        if string:
            if escape:
                escape = False
            elif c == "\\":
                escape = True
            elif c == '"':
                string = False
        elif c == '"':
            string = True
        elif c in "{[":
            stack.append(c)
        elif c in "}]" and stack and stack[-1] == OPENER[c]:
            stack.pop()
    return string or bool(stack)


def _prose(line: str, folded: bool = False) -> bool:
    """Whether a line reads as running text rather than a name, title or label.

    ``folded``: the whole text is of one case, so that case tells nothing.
    """
    found = WORD.findall(NOT_WORDS.sub(" ", line))
    if not found:
        return False
    if folded:
        return len(found) >= 4 and sum(w.lower() in FUNCTION for w in found) >= 1 and " | " not in line and not SIGNED.search(line)
    lower = sum(w[0].islower() for w in found)
    function = sum(w.lower() in FUNCTION for w in found)
    if line.upper() == line or line.title() == line:
        return len(found) >= 5 and function >= 2
    if len(found) == 1:
        return found[0].lower() in FUNCTION or found[0] in ("See", "There", "According", "During", "Between", "Despite")
    plain = sum(w[0].islower() and w.lower() not in FUNCTION for w in found)
    return (lower >= 0.5 * len(found) and plain > 0) or function == len(found)


def _is_furniture(line: str, seen: dict[str, int]) -> bool:
    s = re.sub(r"[\dOIl]+", "0", line.strip())
    return bool(PAGE_NUMBER.match(line.strip())) or (len(line) < 90 and not TERMINATED.search(line) and (seen.get(s, 0) > 1 or (FURNITURE.match(line.strip()) is not None and not _prose(line))))


def ending(text: str) -> str:
    """'' for a complete text, else what shows the cut: trace, broken, open, word or terminator."""
    why = last_lines(text)
    return "open" if why in ("", "terminator") and left_open(text) else why


def last_lines(text: str) -> str:
    """What the end of a text shows, without the stack."""
    body = text.rstrip()
    if not body:
        return ""
    if TRACE.search(body, body.rfind("\n") + 1):
        return "trace"
    if BROKEN.search(body[-10:]) and not body.endswith(("=-=", "==")):
        return "broken"
    if body.lstrip()[:1] == "{":
        return ""
    lines = [QUOTE_MARKS.sub("", x).rstrip() for x in body.replace("\f", "\n").split("\n")]
    while lines and not lines[-1].strip():
        lines.pop()
    if not lines:
        return ""
    seen: dict[str, int] = {}
    for x in lines:
        if x.strip():
            k = re.sub(r"[\dOIl]+", "0", x.strip())
            seen[k] = seen.get(k, 0) + 1
    bare = len(lines)
    dropped = 0
    while bare > 1 and _is_furniture(lines[bare - 1], seen):
        bare -= 1
        dropped += 1
        while bare > 1 and not lines[bare - 1].strip():
            bare -= 1
    lines = lines[:bare]
    last = lines[-1].strip()
    folded = body.upper() == body or body.lower() == body or body.title() == body
    begin = len(lines) - 1
    while begin > 0 and lines[begin - 1].strip():
        begin -= 1
    paragraph = " ".join(lines[begin:])
    if dropped and not TERMINATED.search(last) and any(TERMINATED.search(x) for x in lines[-4:-1]) and not _prose(last):
        return ""
    if TERMINATED.search(last):
        if ABBREVIATED.search(last) and not re.search(r"\b(?:St|Ave|Rd|Inc|Ltd|Co|Corp|Bros|Dept|Assn)\.$", last):
            return "terminator"
        return ""
    if HEADER.match(last) and not CLOSING.match(last):
        return "open"
    if WROTE.search(last) and re.search(r"@|\d", paragraph):
        return "open"
    if re.search(r"-{2,}\s*(?:original|forwarded)\b.*$", last, re.I):
        return "open"
    if HALF_ADDRESS.search(last):
        return "word"
    if CLOSING.match(last) or MOBILE.match(last) or INITIALS.match(last) or SIGN_OFF.match(last):
        return ""
    if FIELD.match(last):
        value = re.split(r"[:=\-]\s*", last, maxsplit=1)[-1]
        return "terminator" if last.lower().startswith("comment") and (not value or _prose(value)) else ""
    if CONTACT.search(last) and not _prose(last, folded):
        return ""
    if SIGNED.search(re.sub(r"\s+", " ", paragraph)):
        return ""
    parts = re.split(r"(?<=[a-z0-9)'\"][.!?])\s+(?=[A-Z\-(])", last)
    if len(parts) > 1 and not re.search(r"\b(?:Dr|Mr|Mrs|Ms|Prof|Capt|St|No|P\.O|Inc|Ltd|Co|Ave|Rd|T|Tel|o)\.$", parts[-2]) and " | " not in parts[-1] and _prose(parts[-2] + " " + parts[-1], folded):
        return "terminator"
    if _prose(last, folded):
        return "terminator"
    before = lines[-2].strip() if len(lines) - begin > 1 else ""
    if before and _prose(before, folded) and not CONTACT.search(before) and not TERMINATED.search(before) and not SIGN_OFF.match(before):
        return "terminator"
    return ""


def _unterminated_by_nature(text: str) -> bool:
    """A long text of one case or form in which hardly any sentence has a terminator."""
    return 400 + 600 * len(re.findall(r"[.!?](?:\s|$)", text)) < len(text)


def _features(batches):
    for pdf in batches:
        rows = []
        for doc, text, pages, counted in zip(pdf["document_id"].tolist(), pdf["full_text"].tolist(), pdf["pages_text"], pdf["word_count"].tolist()):
            try:
                size = len(text.encode())
            except UnicodeEncodeError:
                size = len(text.encode("utf-8", "replace"))
            why, opened = last_lines(text), left_open(text)
            if why == "terminator" and _unterminated_by_nature(text):
                why = ""
            fewer = counted is not None and counted == counted and counted - len(text.split()) >= 3
            pages_longer = False
            if pages is not None and len(pages):
                joined = "\n".join(p for p in pages if p is not None)
                if len(joined) > len(text) + 20:
                    a, b = (re.sub(r"[\W_]+", "", x).lower() for x in (text, joined))
                    while a and not b.startswith(a) and len(a) > 20:
                        a = a[:-1] if b.startswith(a[:-1]) or b.startswith(a[:-12]) else ""
                    pages_longer = len(a) > 20 and len(b) - len(a) >= 10
            end = text.rstrip()
            tail = LAST_WORD.search(end, len(end) - len(end.split(None)[-1]) if end else 0)
            last = tail.group().lower() if tail else None
            digest = int.from_bytes(hashlib.blake2b(re.sub(r"[\W_]+", "", text).lower().encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)
            rows.append((doc, why, opened, bool(fewer), bool(pages_longer), len(text), size, last, digest))
        yield pd.DataFrame(rows, columns=["document_id", "why", "opened", "fewer", "pages_longer", "chars", "bytes", "last", "digest"])


FEATURES = "document_id bigint, why string, opened array<string>, fewer boolean, pages_longer boolean, chars int, bytes int, last string, digest bigint"


def source_name(source: Column) -> Column:
    """One spelling per source: lower case, letters and digits, numbers without leading zeros."""
    bare = F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "")
    return F.coalesce(F.regexp_replace(bare, r"^(\p{L}*)0+(?=\d)", "$1"), F.lit(""))


def _beginnings(batches):
    """Of one sorted range of (c, h): h of texts that begin the next one, and the range's first and last row."""
    from pyspark import TaskContext

    part, prev = TaskContext.get().partitionId(), None
    for pdf in batches:
        rows = []
        for c, h in zip(pdf["c"].tolist(), pdf["h"].tolist()):
            if prev is None:
                rows.append((part, 0, c, h))
            elif c.startswith(prev[0]):
                rows.append((part, 1, None, prev[1]))
            prev = (c, h)
        yield pd.DataFrame(rows, columns=["part", "what", "c", "h"])
    if prev is not None:
        yield pd.DataFrame([(part, 2, *prev)], columns=["part", "what", "c", "h"])


def prefix_of_longer(texts: DataFrame) -> DataFrame:
    """document_id of texts whose letters and digits begin, but do not end, another text, whatever their length.

    Different contents are range-sorted over the cluster; a beginning stands right before a text it begins.
    At the seams of the ranges the last text of one is joined with the first of the next.
    """
    content = cut(texts.select("document_id", normalise(F.col("full_text")).alias("c")).filter("c <> ''").withColumn("h", F.md5("c")))
    distinct = content.select("c", "h").dropDuplicates(["h"])
    found = cut(distinct.repartitionByRange("c").sortWithinPartitions("c").mapInPandas(_beginnings, "part int, what int, c string, h string"))
    parts = found.filter("what = 0").select("part").withColumn("next", F.lead("part").over(W.orderBy("part")))  # one small row per range
    last, first = found.filter("what = 2").select("part", "c", "h"), found.filter("what = 0").select(F.col("part").alias("next"), F.col("c").alias("next_c"))
    seams = last.join(parts.filter("next is not null"), "part").join(first, "next").filter("startswith(next_c, c)")
    begin = found.filter("what = 1").select("h").unionAll(seams.select("h")).distinct()
    return content.select("document_id", "h").join(begin, "h", "left_semi").select("document_id")


def half_words(texts: DataFrame, elsewhere: float = 0.1, known: float = 3.0) -> DataFrame:
    """Last words of texts that the corpus knows only as the beginning of words: rows (last).

    All words of all texts are counted. A last word is half if it stands elsewhere at most ``elsewhere``
    times as often as at ends, and begins a word that occurs ``known`` times as often.
    """
    lower = F.lower(F.rtrim("full_text", F.lit(" \t\n\r\f\v")))
    end = F.regexp_extract(F.substring_index(F.regexp_replace(lower, r"\s", " "), " ", -1), rf"({JVM_WORD})$", 1)
    # last words are counted once more, under a mark
    words = texts.select(F.explode(F.concat(F.regexp_extract_all(lower, F.lit(JVM_WORD), F.lit(0)), F.array(F.concat(F.lit("$"), end)))).alias("word"))
    counts = cut(words.filter("word <> '$'").groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    at_end = counts.filter("startswith(word, '$') and length(word) > 3").select(F.expr("substring(word, 2)").alias("last"), F.col("n").alias("ends"))
    every = counts.filter("not startswith(word, '$')")
    asked = at_end.join(every.withColumnRenamed("word", "last"), "last").filter(F.col("n") - F.col("ends") <= elsewhere * F.col("ends"))
    starts = every.filter(F.length("word") > 3).select("word", F.col("n").alias("times"), F.explode(F.sequence(F.lit(3), F.length("word") - 1)).alias("k"))
    starts = starts.groupBy(F.expr("substring(word, 1, k)").alias("last")).agg(F.max("times").alias("times"))
    return asked.join(starts, "last").filter(F.col("times") >= known * F.col("n")).select("last")


def judged(texts: DataFrame, documents: DataFrame, least_at_limit: int = 3, spike: float = 4.0, usual: float = 0.05) -> DataFrame:
    """Rows (document_id, source, cut, evidence) of every text that is not blank.

    A limit is a length that ``least_at_limit`` texts of a source share and ``spike`` times as many as
    each of the 64 lengths around it. A kind of open mark that ``usual`` of a source's otherwise complete texts show is no evidence.
    """
    source = texts.select(F.col("document_id").cast("bigint").alias("document_id"), "full_text", "pages_text", "word_count").filter(r"document_id is not null and full_text rlike '\\S'")
    origin = documents.select(F.col("id").cast("bigint").alias("document_id"), source_name(F.col("data_set")).alias("source")).filter("document_id is not null").groupBy("document_id").agg(F.max("source").alias("source"))
    found = source.mapInPandas(_features, FEATURES).dropDuplicates(["document_id"])
    found = cut(found.join(origin, "document_id", "left").withColumn("source", F.coalesce("source", F.lit(""))))

    complete = found.filter("why = ''").groupBy("source").agg(F.count(F.lit(1)).alias("complete"))
    opened = found.filter("why = ''").select("source", F.explode("opened").alias("kind")).groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
    # one text alone shows no habit
    usually = opened.join(complete, "source").filter(F.col("n") > usual * F.col("complete") + 1).groupBy("source").agg(F.collect_set("kind").alias("usually"))
    found = found.join(usually, "source", "left").withColumn("opened", F.array_except("opened", F.coalesce("usually", F.array().cast("array<string>")))).drop("usually")

    lacking = ((F.col("why") != "") | (F.size("opened") > 0)).cast("int")
    once = found.groupBy("source", "digest").agg(F.max("chars").alias("chars"), F.max("bytes").alias("bytes"), F.max(lacking).alias("lacking"))
    lengths = once.select("source", "lacking", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("b").alias("unit"), F.col("bytes").alias("size")))).alias("l"))
    limits = lengths.groupBy("source", "l.unit", "l.size").agg(F.count(F.lit(1)).alias("n"), F.avg("lacking").alias("share"))
    near = limits.groupBy("source", "unit", F.floor(F.col("size") / 64).alias("range")).agg(F.sum("n").alias("near"))
    limits = limits.filter((F.col("n") >= least_at_limit) & (F.col("share") >= 0.6)).withColumn("range", F.floor(F.col("size") / 64)).join(near, ["source", "unit", "range"])
    limits = limits.filter(F.col("n") * 63 >= spike * (F.col("near") - F.col("n")))
    at_c = limits.filter("unit = 'c'").select("source", F.col("size").alias("chars"), F.lit(True).alias("limit_c"))
    at_b = limits.filter("unit = 'b'").select("source", F.col("size").alias("bytes"), F.lit(True).alias("limit_b"))
    baseline = found.groupBy("source").agg(F.avg((F.col("why") == "terminator").cast("double")).alias("unterminated"))

    half = half_words(source).withColumn("half_word", F.lit(True))

    # a copy with the same letters and digits that has its terminator
    whole = found.groupBy("digest").agg(F.max((F.col("why") == "").cast("int")).alias("whole"))

    longer = prefix_of_longer(source).distinct().withColumn("begins_another", F.lit(True))
    out = found.join(at_c, ["source", "chars"], "left").join(at_b, ["source", "bytes"], "left").join(baseline, "source", "left").join(whole, "digest", "left").join(half, "last", "left").join(longer, "document_id", "left")
    evidence = F.concat_ws(
        ",",
        F.when((F.col("why") != "") & ((F.col("why") != "terminator") | ((F.col("unterminated") < 0.5) & (F.col("whole") == 0))), F.col("why")),
        F.when(F.size("opened") > 0, "open"),
        F.when(F.col("limit_c") | F.col("limit_b"), "limit"),
        F.when(F.col("fewer"), "words"), F.when(F.col("pages_longer"), "pages"), F.when(F.col("begins_another"), "longer text"),
        F.when(F.col("half_word"), "half word"),
    )
    return out.select("document_id", "source", (evidence != "").alias("cut"), evidence.alias("evidence"))


def truncation_rates(judgement: DataFrame) -> DataFrame:
    """Per source: texts, cut texts and their share."""
    return judgement.groupBy("source").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.col("cut").cast("bigint")).alias("cut_texts"), F.avg(F.col("cut").cast("double")).alias("share"))
