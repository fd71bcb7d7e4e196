"""Problem 3: the newly written text of emails.

Messages are winnowed into fingerprints of their words, kept in one inverted
index over the corpus: per fingerprint the messages that hold it, their number,
and how often it stands in a closing paragraph. The index serves three ends, all
without thread identifiers:

* recurring closings (legal notices, mottos): fingerprints that several messages
  share and that nearly always stand in a last paragraph; a closing paragraph
  largely made of them is no new text;
* ancestors: a message whose own text stands nearly whole inside a longer one.
  Candidates come from the index, all holders of a fingerprint among them; the spans are
  then verified word by word against the ancestor's text, and the lines that stand there
  are quoted matter even where nothing marks them;
* siblings: where the ancestor is not in the corpus, a paragraph that stands word for word
  below the introducing lines of two messages of different openings is quoted in both.

A message is looked up by its rarest fingerprints only, which loses no ancestor.
Lines are then classified by ``split_message``: header, quoted or forwarded matter
with its introducing lines, sign-off and signature, notice, or new text. An
unmarked quotation that opens a message ends at a greeting, after its own
signature, or where the width to which lines are wrapped changes.

Null, empty and blank texts give no rows. Texts that are no emails give no rows.
Repeated rows of one id give the same lines once.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recordspark.llm.leakage import TOP, WORD, winnow
from recordspark.session import cut

HEADER = re.compile(r"^\s*\*?(from|to|cc|bcc|date|sent|subject|reply-to|importance|attachments?|von|an|betreff|gesendet|de|à|objet|envoyé|datum)\*?\s*:\*?(?:\s|$)", re.I)
QUOTE = re.compile(r"^\s*[>|]")
NO_MAIL = re.compile(r"^\s*(?:memorandum|deposition|interview of|date\s+time\s+leg|\{|bates\s+begin|in the\b|exhibit\b)", re.I)
NAMED_GREETING = re.compile(r"^\s*(?:(?:mr|mrs|ms|dr|prof|capt|mme)\s?\.{0,3}\s+)?[^\W\d_]{2,}(?:\s+[^\W\d_]{2,})?\s*(?:[,:]|\s[-–—])\s*$", re.I)
STRICT_GREETING = re.compile(r"^\s*(?:(?:hi|hello|hey|dear|good\s+(?:morning|afternoon|evening|day)|greetings|bonjour|hallo|hola)\b(?:[^.!?;]|\b(?:mr|mrs|ms|dr|prof|capt|mme|m)\s?[.!]{1,3}){0,60}|all|team|everyone|folks)\s*(?:[,:!]|\s[-–—])?\s*$", re.I)
WROTE = re.compile(r"(?:\bwrote|a\s+écrit|\bschrieb\b.*|escribió|ha scritto)\s*:\s*$", re.I)
WROTE_OPEN = re.compile(r"^\s*(?:on|le|am|el|il)\s.*\d{2}", re.I)
DASHED = re.compile(r"^\s*-{2,}\s*(?:original|forwarded|weitergeleitete|message\s+transféré|ursprüngliche)\b.*", re.I)
BEGIN = re.compile(r"^\s*(?:begin\s+forwarded\s+message|début\s+du\s+message\s+réexpédié)\s*:?\s*$", re.I)
ARROWS = re.compile(r"^\s*\S.{3,120}>>>\s*$")
RULE = re.compile(r"^\s*_{6,}\s*$")
CUT_LINE = re.compile(r"^\s*(?:--|—|_{3,}|\*{3,}|={3,}|-{4,})\s*$")
SIGN_OFF = re.compile(
    r"^\s*(?:(?:kind|best|warm|warmest|kindest|many|with\s+(?:kind|best|warm))\s+)*(?:regards|wishes|thanks|thank\s+you|sincerely|cheers|best|yours(?:\s+(?:sincerely|faithfully|truly))?|respectfully(?:\s+(?:yours|submitted))?|cordially|mit\s+freundlichen\s+grüßen|cordialement|saludos|atentamente)(?:\s+(?:again|and\s+regards|in\s+advance|very\s+much))?\s*[,.!\-–—]?\s*$",
    re.I,
)
MAIL_SIGN_OFF = re.compile(r"^\s*(?:(?:kind|best|warm|many)\s+)?(?:regards|best|wishes|cheers|thanks)\s*[,.]?\s*$", re.I | re.M)
DATED = re.compile(r"^\s*(?:\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}|\d{4}-\d{2}-\d{2}|\d{1,2}\s+[A-Za-z]{3,9}\.?\s+\d{4}|[A-Za-z]{3,9}\.?\s+\d{1,2},?\s+\d{4})\s*$", re.M)
INITIALS = re.compile(r"^\s*(?:[-–—/~]+\s*[A-Z]{1,3}\.?(?:[A-Z]\.?)?|[-–—~]+\s*[A-Z][\w'’]+)\s*$", re.I)
MOBILE = re.compile(r"^\s*(?:sent|written|typed)\s+(?:from|via|on|with)\s+(?:my|a|mobile|phone|handset)\b.{0,60}$|^\s*(?:envoyé\s+de\s+mon|von\s+meinem)\b.{0,60}$", re.I)
POSTSCRIPT = re.compile(r"^\s*(?:p\.?\s?p?\.?\s?s\.?|post\s?script(?:um)?|nb|n\.b\.)\s*[:.\-–—]?\s+\S", re.I)
NOTICE = re.compile(
    r"(?:confidentiality\s+notice\s*[:\-]|^\s*disclaimer\s*[:\-]|accepts?\s+no\s+liability|intended\s+(?:solely|only)\s+for|(?:e-?mail|message|communication)s?\s+(?:and\s+its\s+\w+\s+)?(?:may|might)\s+contain\s+(?:\w+\s+){0,3}(?:privileged|confidential)|information\s+transmitted|consider\s+the\s+environment|tax\s+advice\s+in\s+this|do\s+not\s+bind\b|ce\s+message\s+est\s+confidentiel|diese\s+(?:e-?mail|nachricht)\s+(?:ist|kann)|virus|if\s+you\s+are\s+not\s+(?:that|the\s+intended)|for\s+the\s+(?:named\s+)?(?:addressee|recipient)\s+only)",
    re.I,
)
CONTACT = re.compile(
    r"(?:^\s*(?:(?:t|tel|phone|mobile|o|m|fax|cell|direct|office)\s*[.:]?\s*)?\+?[\d(][\d\s().\-/+]{6,}\d\s*$|@[\w.\-]+\.\w+\s*$|^\s*(?:t|tel|phone|mobile|o|m|f|fax|cell|direct)\b[.:]?\s*[+(\d]|https?://|^\s*www\.|p\.?\s?o\.?\s?box\s+\d|\b(?:street|st\.|avenue|ave|road|rd\.?|lane|drive|court|terrace)\b,?\s.*\b(?:[A-Z]{1,2}\d|\d{5})|\s\|\s.*\s\|\s)",
    re.I,
)
PROSE_END = re.compile(r"[.!?]['\")\]]*\s*$")


def is_email(text: str, hint: str | None) -> bool:
    """Whether a text is an email by its form; ``hint`` is its document type."""
    head = text.lstrip("﻿\n\r\t ")
    if not head or NO_MAIL.match(head):
        return False
    lines = head.split("\n")
    if len(lines) > 1 and HEADER.match(lines[0]) and HEADER.match(lines[1]):
        return True
    if STRICT_GREETING.match(lines[0]) or DASHED.match(lines[0]) or BEGIN.match(lines[0]) or ARROWS.match(lines[0]):
        return True
    if re.search(r"(?m)^\s*>.*\n\s*>", text) and re.search(r"(?im)(?:wrote|écrit|schrieb.*):\s*$", text):
        return True
    if re.search(r"(?im)^\s*-{3,}\s*(?:original|forwarded) message|^.*@.*>>>\s*$", text):
        return True
    if hint and ("mail" in hint.lower() or hint.lower().strip() == "correspondence"):
        return True
    closing = [x for x in re.split(r"\n\s*\n", text.rstrip()) if x.strip()][-2:]
    # no header and no hint: signed off as mails are, or with a notice that only mails carry; letters open with a date
    return not DATED.match(head) and (bool(MAIL_SIGN_OFF.search(text)) or any(NOTICE.search(x) for x in closing) or any(MOBILE.match(x) for p in closing for x in p.split("\n")))


def _intro(lines: list[str], i: int) -> int:
    """Number of lines from i that introduce quoted matter; 0 if none do."""
    line = lines[i]
    if DASHED.match(line) or BEGIN.match(line):
        n = 1
        while i + n < len(lines) and (not lines[i + n].strip() or HEADER.match(lines[i + n])):
            n += 1
        return n
    if RULE.match(line) and i + 2 < len(lines) and HEADER.match(lines[i + 1]) and HEADER.match(lines[i + 2]):
        n = 1
    elif re.match(r"^\s*\*(?:from|von|de)\s*:\*", line, re.I) and i + 1 < len(lines) and HEADER.match(lines[i + 1]):
        n = 0
    elif ARROWS.match(line) and not QUOTE.match(line) and ("@" in line or re.search(r"\d", line)):
        return 1
    elif WROTE.search(line) and len(line) < 200 and not QUOTE.match(line) and re.search(r"@|\d|<", line):
        return 1
    elif WROTE_OPEN.match(line) and i + 1 < len(lines) and WROTE.search(lines[i + 1]) and len(lines[i + 1]) < 120:
        return 2
    elif re.match(r"^\s*-{2,}\s+\S", line) and i + 1 < len(lines) and WROTE.search(lines[i + 1]) and len(lines[i + 1]) < 120:
        return 2
    elif re.match(r"^\s*from\s*:", line, re.I) and i + 2 < len(lines) and HEADER.match(lines[i + 1]) and HEADER.match(lines[i + 2]):
        n = 0
    else:
        return 0
    while i + n < len(lines) and HEADER.match(lines[i + n]):
        n += 1
    return n


def _paragraphs(at: list[int], lines: list[str]) -> list[list[int]]:
    out: list[list[int]] = []
    last = None
    for i in at:
        if last is None or i != last + 1:
            out.append([])
        out[-1].append(i)
        last = i
    return out


def wrap_range(paragraph: list[str]) -> tuple[int, int]:
    """The widths to which a paragraph's lines may have been wrapped."""
    low, high = 0, 10**6
    for a, b in zip(paragraph, paragraph[1:]):
        first = b.split(None, 1)
        low = max(low, len(a.rstrip()))
        high = min(high, len(a.rstrip()) + len(first[0]) if first else high)
    if len(paragraph) > 1:
        low = max(low, len(paragraph[-1].rstrip()))
    elif paragraph and len(paragraph[0]) > 110:
        low = len(paragraph[0].rstrip())
    return low, high


def _looks_signed(line: str, names: set[str]) -> bool:
    """A line of a signature block: a name, a post, a firm or a contact."""
    s = line.strip()
    if not s or len(s) > 160:
        return False
    if CONTACT.search(s) or INITIALS.match(s):
        return True
    return len(s) < 60 and not PROSE_END.search(s) and len(s.split()) <= 6 and not re.search(r"[;?!]", s)


def _is_name(line: str, names: set[str]) -> bool:
    found = WORD.findall(line.lower())
    return 0 < len(found) <= 4 and len(line.strip()) < 45 and bool(names) and all(w in names or len(w) == 1 for w in found)


def _own(at: list[int], lines: list[str], names: set[str], closings: set[int]) -> list[int]:
    """Of the lines of one unquoted stretch, those newly written."""
    paragraphs = _paragraphs([i for i in at if lines[i].strip()], lines)
    keep: list[int] = []
    signed = False
    for n, p in enumerate(paragraphs):
        text = " ".join(lines[i] for i in p)
        notice = bool(NOTICE.search(text)) and (len(p) == 1 or len(text) > 60) and (n == len(paragraphs) - 1 or signed or NOTICE.search(" ".join(lines[i] for q in paragraphs[n + 1 :] for i in q)) or re.match(r"\s*(?:disclaimer|confidentiality notice)", text, re.I))
        if POSTSCRIPT.match(lines[p[0]]):
            keep += [i for i in p if not MOBILE.match(lines[i])]
            continue
        if notice or (p[0] in closings and (n == len(paragraphs) - 1 or signed)) or (len(p) == 1 and MOBILE.match(lines[p[0]])):
            continue
        if signed:
            continue
        for k, i in enumerate(p):
            line = lines[i]
            rest = [lines[j] for j in p[k + 1 :]]
            if CUT_LINE.match(line) or RULE.match(line):
                signed = True
                break
            if SIGN_OFF.match(line):
                signed = True
                break
            if INITIALS.match(line) and not rest and n > 0:
                signed = True
                break
            if MOBILE.match(line):
                continue
            if _is_name(line, names) and not line.rstrip().endswith((",", ":", "-")) and (n > 0 or k > 0) and all(_looks_signed(x, names) for x in rest):
                signed = True
                break
            if " | " in line and _looks_signed(line, names) and line.count(" | ") >= 2:
                signed = True
                break
            keep.append(i)
    return keep


def _person(text: str) -> set[str]:
    return {w for w in WORD.findall(re.sub(r"<[^>]*>|\[[^\]]*\]|\S+@\S+|\d\S*", " ", text).lower()) if len(w) > 1}


def _end_of_quote(at: list[int], lines: list[str], names: set[str], author: set[str]) -> int:
    """Index into ``at`` where new text follows an unmarked quotation; len(at) if it never does.

    ``names`` and ``author`` are the words of the sender's and the quoted writer's name.
    """
    paragraphs = _paragraphs([i for i in at if lines[i].strip()], lines)
    place = {i: k for k, i in enumerate(at)}
    low, high, signed, first = 0, 10**6, False, True
    prose: list[int] = []
    for n, p in enumerate(paragraphs):
        text = [lines[i] for i in p]
        one = text[0]
        if prose and not signed and (SIGN_OFF.match(one) or CUT_LINE.match(one) or RULE.match(one) or one.count(" | ") >= 2):
            signer = {w for q in paragraphs[n : n + 2] for i in q[:3] if len(lines[i]) < 160 for w in WORD.findall(re.split(r"\|", lines[i])[0].lower())}
            theirs, ours = bool(signer & author), bool(signer & names) if names else bool(author)
            if ours and not theirs and len(prose) > 1:
                # signed by the sender: the new text is the later part, though nothing marks where it begins
                marked = [q for q in prose[1:] if re.match(r"\s*(?:to be clear|to answer|in answer|my answer)\b", lines[q], re.I)]
                return place[marked[0] if marked else prose[(len(prose) + 1) // 2]]
        if not first and (STRICT_GREETING.match(one) or (len(p) == 1 and NAMED_GREETING.match(one) and not SIGN_OFF.match(one))):
            return place[p[0]]
        if first and STRICT_GREETING.match(one) and len(p) == 1:
            continue
        if SIGN_OFF.match(one) or CUT_LINE.match(one) or RULE.match(one) or INITIALS.match(one) or (one.count(" | ") >= 2):
            signed = True
            continue
        joined = " ".join(text)
        block = all(_looks_signed(x, set()) for x in text)
        if signed and (block or NOTICE.search(joined) or MOBILE.match(one)):
            continue
        if signed:
            return place[p[0]]
        if NOTICE.search(joined) or MOBILE.match(one) or (block and n > 0):
            signed = signed or bool(NOTICE.search(joined) or MOBILE.match(one))
            continue
        a, b = wrap_range(text)
        if not first and (max(a, low) > min(b, high)):
            return place[p[0]]
        low, high, first = max(a, low), min(b, high), False
        prose.append(p[0])
    return len(at)


def single_spaced(lines: list[str]) -> list[int | None] | None:
    """Of a text whose every line is followed by blank ones: its lines' places, None for a blank that stays.

    Null for any other text.
    """
    full = [i for i, x in enumerate(lines) if x.strip()]
    if len(full) < 6:
        return None
    gaps = [b - a for a, b in zip(full, full[1:])]
    least = min(gaps)
    if least < 2 or all(g == least for g in gaps):
        return None
    out: list[int | None] = [full[0]]
    for i, g in zip(full[1:], gaps):
        out += [None] * (g > least) + [i]
    return out


def split_message(text: str, quoted: set[int] = frozenset(), closings: set[int] = frozenset()) -> list[int]:
    """Numbers, from 1, of the newly written lines of an email.

    ``quoted`` and ``closings`` hold lines (from 0) that the index has recognised.
    """
    every = text.split("\n")
    number = single_spaced(every)
    if number is not None:
        back = {i: k for k, i in enumerate(number) if i is not None}
        quoted = {back[i] for i in quoted if i in back}
        closings = {back[i] for i in closings if i in back}
        lines = ["" if i is None else every[i] for i in number]
    else:
        lines = every
    n = len(lines)
    i = 0
    while i < n and not lines[i].strip():
        i += 1
    names: set[str] = set()
    start = i
    while i < n and HEADER.match(lines[i]) and not lines[i].lstrip().startswith("*"):
        if re.match(r"\s*from\s*:", lines[i], re.I):
            names |= {w for w in WORD.findall(re.sub(r"<[^>]*>|\S+@\S+", " ", lines[i].split(":", 1)[1]).lower())}
        i += 1
    if i - start == 1 and not re.match(r"\s*(?:from|to|date|sent|subject)\s*:", lines[start], re.I):
        i = start
    keep: list[int] = []
    stretch: list[int] = []
    had_body = False
    while i < n:
        line = lines[i]
        if QUOTE.match(line) or i in quoted:
            keep += _own(stretch, lines, names, closings)
            stretch = []
            i += 1
            continue
        k = _intro(lines, i) if line.strip() else 0
        if k:
            own = _own(stretch, lines, names, closings)
            keep += own
            had_body = had_body or bool(keep)
            stretch = []
            author = _person(" ".join(x for x in lines[i : i + k] if ">>>" in x or re.match(r"\W*from\W", x, re.I)).replace("From", " ")) if k else set()
            if ">>>" in lines[i]:
                author -= {"am", "pm", "january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"}
            i += k
            j = i
            while j < n and not lines[j].strip():
                j += 1
            if j < n and QUOTE.match(lines[j]):
                continue
            if j < n and _intro(lines, j):
                continue
            # unmarked: up to the next introduction or marked line, or to where new text begins
            block = []
            while i < n and not QUOTE.match(lines[i]) and not (lines[i].strip() and _intro(lines, i)):
                block.append(i)
                i += 1
            if had_body:
                continue
            at = _end_of_quote(block, lines, names, author)
            if at < len(block):
                i = block[at]
                had_body = True
                stretch = []
                while i < n and not QUOTE.match(lines[i]) and not (lines[i].strip() and _intro(lines, i)):
                    stretch.append(i)
                    i += 1
            continue
        stretch.append(i)
        i += 1
    keep += _own(stretch, lines, names, closings)
    new = [i for i in sorted(set(keep)) if lines[i].strip()]
    return [i + 1 if number is None else number[i] + 1 for i in new]


K, WINDOW = 6, 6


def _hash_words(found: list[str], cache: dict[str, int]) -> np.ndarray:
    """Ids of words that are equal in every process."""
    out = np.empty(len(found), np.int64)
    for k, w in enumerate(found):
        v = cache.get(w)
        if v is None:
            v = 1469598103934665603
            for b in w.encode():
                v = ((v ^ b) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
            v = cache[w] = v >> 2
        out[k] = v
    return out


FPS = "fp bigint, document_id bigint, whole bigint, line int, opens int, closing boolean, paragraph boolean, opening bigint, below boolean"


def _digest(words: list[str]) -> int:
    return int.from_bytes(hashlib.blake2b(" ".join(words).encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def unquoted(lines: list[str]) -> list[tuple[int, int, list[str]]]:
    """(line, first line of its paragraph, words) of the lines below the header that nothing marks as quoted."""
    out = []
    last, head = 0, True
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        head = head and bool(HEADER.match(line))
        if head or QUOTE.match(line):
            continue
        if i == 0 or not lines[i - 1].strip() or QUOTE.match(lines[i - 1]):
            last = i
        out.append((i, last, WORD.findall(line.lower())))
    return out


def unmarked_blocks(lines: list[str], begin: int) -> set[int]:
    """Lines (from 0) from ``begin`` on below an introducing line that is followed by unmarked lines, up to the next marked one."""
    out: set[int] = set()
    inside, i = False, begin
    while i < len(lines):
        if not lines[i].strip():
            i += 1
        elif QUOTE.match(lines[i]):
            inside, i = False, i + 1
        elif k := _intro(lines, i):
            i += k
            j = next((j for j in range(i, len(lines)) if lines[j].strip()), len(lines))
            inside = j < len(lines) and not QUOTE.match(lines[j])
        else:
            if inside:
                out.add(i)
            i += 1
    return out


def _fingerprints(batches, least_words: int = 8):
    """Rows of FPS: the fingerprints of the unquoted lines of emails, and the digests of their paragraphs' words.

    ``whole`` is equal for copies of one message, which must not count as several. ``line`` is the
    first line of the paragraph, ``opens`` that of the message's first with a fingerprint; ``opening`` is the digest of the first paragraph of
    ``least_words``, ``below`` tells that the paragraph stands, unmarked, below an introducing line. Every email has a row without fingerprint.
    """
    from recordspark.llm.leakage import _grams

    cache: dict[str, int] = {}
    for pdf in batches:
        rows = []
        for doc, text, hint in zip(pdf["document_id"].tolist(), pdf["full_text"].tolist(), pdf["hint"].tolist()):
            if not is_email(text, hint):
                continue
            found, owner, paragraphs = [], [], {}
            lines = text.split("\n")
            for _, line, words in unquoted(lines):
                found += words
                owner += [line] * len(words)
                paragraphs.setdefault(line, []).extend(words)
            if len(cache) > 500_000:
                cache.clear()
            h = _grams(_hash_words(found, cache), K)
            kept = {(int(h[x].view(np.int64)), owner[x]) for x in winnow(h, WINDOW).tolist() if h[x] != TOP and owner[x] == owner[x + K - 1]}
            final, opens = owner[-1] if owner else 0, min((line for _, line in kept), default=owner[0] if owner else 0)
            whole = _digest(found)
            long = {line: _digest(words) for line, words in paragraphs.items() if len(words) >= least_words}
            opening = long[min(long)] if long else 0
            block = unmarked_blocks(lines, opens) if len(long) > 1 else set()
            rows.append((None, doc, whole, None, opens, False, False, 0, False))
            rows += [(fp, doc, whole, line, opens, line == final, False, 0, False) for fp, line in kept]
            rows += [(digest, doc, whole, line, opens, line == final, True, opening, line in block) for line, digest in long.items()]
        out = pd.DataFrame(rows, columns=["fp", "document_id", "whole", "line", "opens", "closing", "paragraph", "opening", "below"])
        yield out.astype({"fp": "Int64", "document_id": "int64", "whole": "int64", "line": "Int32", "opens": "int32", "closing": "bool", "paragraph": "bool", "opening": "int64", "below": "bool"})


def verified_lines(text: str, ancestors: list[str]) -> set[int]:
    """Lines (from 0) whose words stand, word by word, in the text of an ancestor.

    A paragraph that stands there as a whole is quoted with all its lines; of any other those lines of
    ``K`` words or more that do.
    """
    own = [" " + " ".join(w for _, _, words in unquoted(a.split("\n")) for w in words) + " " for a in ancestors]
    paragraphs: dict[int, list[tuple[int, list[str]]]] = {}
    for i, line, words in unquoted(text.split("\n")):
        paragraphs.setdefault(line, []).append((i, words))
    out: set[int] = set()
    for part in paragraphs.values():
        span = [w for _, words in part for w in words]
        if span and any(f" {' '.join(span)} " in a for a in own):
            out |= {i for i, _ in part}
        else:
            out |= {i for i, words in part if len(words) >= K and any(f" {' '.join(words)} " in a for a in own)}
    return out


def paragraph_lines(text: str, firsts: set[int]) -> set[int]:
    """All lines of the paragraphs that begin at the given lines."""
    return {i for i, line, _ in unquoted(text.split("\n")) if line in firsts}


def _classify(batches):
    for pdf in batches:
        docs, numbers = [], []
        for doc, text, ancestors, siblings, closings in zip(pdf["document_id"].tolist(), pdf["full_text"].tolist(), pdf["ancestors"], pdf["siblings"], pdf["closings"]):
            quoted = set() if ancestors is None else verified_lines(text, list(ancestors))
            if siblings is not None:
                quoted |= paragraph_lines(text, set(siblings))
            lines = split_message(text, quoted, set() if closings is None else set(closings))
            docs += [doc] * len(lines)
            numbers += lines
        yield pd.DataFrame({"document_id": docs, "line_no": numbers}).astype({"document_id": "int64", "line_no": "int32"})


def ancestors_of(fps: DataFrame, hits: DataFrame, share: float = 0.7, longer: float = 1.3, least: int = 2) -> DataFrame:
    """Rows (document_id, first): ``first`` is a message whose text stands nearly whole inside the longer ``document_id``.

    All holders of a fingerprint are looked at. A message of which ``share`` stands in another shares
    with it one of its rarest fingerprints at least, as many as may be missing and one more, so only
    those are joined; copies of one message are looked up once.
    """
    sets = fps.select("document_id", "fp").distinct().groupBy("document_id").agg(F.count(F.lit(1)).alias("total"), F.bit_xor(F.xxhash64("fp")).alias("all"))
    own = hits.groupBy("document_id", "fp").agg(F.max("n").alias("n")).join(sets, "document_id")
    needed = F.greatest(F.lit(least), F.ceil(F.col("total") * F.lit(share) - 1e-9).cast("int"))
    w = W.partitionBy("document_id")
    one = sets.groupBy("total", "all").agg(F.min("document_id").alias("document_id")).select("document_id")
    held = own.join(one, "document_id", "left_semi").withColumns({"usable": F.count(F.lit(1)).over(w), "rank": F.row_number().over(w.orderBy("n", "fp"))}).filter(F.col("usable") >= needed)
    rarest = held.filter(F.col("rank") <= F.col("usable") - needed + 1).select("fp", F.col("document_id").alias("first"), F.col("total").alias("first_total"))
    pairs = own.select("fp", "document_id", "total").join(rarest, "fp").filter((F.col("document_id") != F.col("first")) & (F.col("total") >= longer * F.col("first_total"))).select("document_id", "first", "first_total").distinct()
    common = pairs.join(held.select(F.col("document_id").alias("first"), "fp"), "first").join(hits.select("document_id", "fp", "line", "opens"), ["document_id", "fp"])
    shared = common.groupBy("document_id", "first", "first_total").agg(F.count_distinct("fp").alias("common"), F.min("line").alias("begins"), F.min("opens").alias("opens"))
    return shared.filter((F.col("common") >= least) & (F.col("common") >= share * F.col("first_total")) & (F.col("begins") > F.col("opens"))).select("document_id", "first")


def siblings_of(paragraphs: DataFrame, recurring: int = 5) -> DataFrame:
    """Rows (document_id, siblings): first lines of the paragraphs that stand word for word below an introducing line of another message too, unmarked in both.

    Messages of one opening are copies, no siblings. Paragraphs that mostly close messages are no quotations.
    """
    later = paragraphs.filter("below and line > opens and fp <> opening")
    held = later.groupBy("fp", "opening").agg(F.max(F.col("closing").cast("int")).alias("closing")).groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum("closing").alias("n_closing"))
    held = held.filter((F.col("n") > 1) & ((F.col("n") < recurring) | (F.col("n_closing") < 0.6 * F.col("n")))).select("fp")
    return later.join(held, "fp").groupBy("document_id").agg(F.collect_set("line").alias("siblings"))


def email_index(messages: DataFrame, recurring: int = 5) -> DataFrame:
    """Rows (document_id, firsts, siblings, closings), one for every email.

    ``firsts`` are its ancestors, ``siblings`` and ``closings`` first lines of quoted and of closing paragraphs.
    A closing is one that ``recurring`` messages share.
    """
    every = cut(messages.mapInPandas(_fingerprints, FPS).distinct())
    mails = every.select("document_id").distinct()
    fps = every.filter("fp is not null and not paragraph")
    once = fps.groupBy("fp", "whole").agg(F.max(F.col("closing").cast("int")).alias("closing"))
    index = once.groupBy("fp").agg(F.count(F.lit(1)).alias("n"), F.sum("closing").alias("n_closing")).filter("n > 1")
    hits = cut(fps.join(index, "fp").drop("whole"))
    frequent = (F.col("n") >= recurring) & (F.col("n_closing") >= 0.6 * F.col("n"))
    closings = hits.filter(F.col("closing") & frequent).groupBy("document_id", "line").agg(F.count_distinct("fp").alias("hit"))
    # all fingerprints of that paragraph, for the share
    whole = fps.filter("closing").groupBy("document_id", "line").agg(F.count_distinct("fp").alias("of"))
    closings = closings.join(whole, ["document_id", "line"]).filter("hit >= 0.5 * of").groupBy("document_id").agg(F.collect_set("line").alias("closings"))
    ancestors = ancestors_of(fps, hits.filter(~frequent)).groupBy("document_id").agg(F.collect_set("first").alias("firsts"))
    siblings = siblings_of(every.filter("paragraph"), recurring)
    return mails.join(ancestors, "document_id", "left").join(siblings, "document_id", "left").join(closings, "document_id", "left")


def new_lines(texts: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (document_id, line_no) of newly written lines; ``types`` has (id, document_type)."""
    source = texts.select(F.col("document_id").cast("bigint").alias("document_id"), "full_text").filter("document_id is not null and trim(full_text) <> ''")
    hints = types.select(F.col("id").cast("bigint").alias("document_id"), F.col("document_type").alias("hint")).filter("document_id is not null").groupBy("document_id").agg(F.max("hint").alias("hint"))
    found = cut(email_index(source.join(hints, "document_id", "left")))
    # the texts of the ancestors go to the messages that quote them
    quoting = found.select("document_id", F.explode("firsts").alias("first"))
    quoted = source.select(F.col("document_id").alias("first"), F.col("full_text").alias("ancestor")).join(quoting.select("first").distinct(), "first", "left_semi").join(quoting, "first")
    quoted = quoted.groupBy("document_id").agg(F.collect_set("ancestor").alias("ancestors"))
    mails = source.join(found.select("document_id", "siblings", "closings"), "document_id").join(quoted, "document_id", "left")
    return mails.mapInPandas(_classify, "document_id bigint, line_no int").distinct()


def new_text(texts: DataFrame, types: DataFrame) -> DataFrame:
    """Rows (document_id, new_text): the sender's words of each email, lines joined by line feeds."""
    lines = new_lines(texts, types)
    parts = texts.select(F.col("document_id").cast("bigint").alias("document_id"), F.split("full_text", "\n").alias("lines")).join(
        lines.groupBy("document_id").agg(F.array_sort(F.collect_list("line_no")).alias("at")), "document_id"
    )
    return parts.select("document_id", F.array_join(F.transform("at", lambda i: F.element_at("lines", i)), "\n").alias("new_text")).groupBy("document_id").agg(F.max("new_text").alias("new_text"))
