"""Column functions over free text; all stay inside the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordspark.config import STOP_TERMS

# Frequent words that readable English text holds.
COMMON_WORDS = (
    "the", "and", "for", "that", "this", "with", "from", "have", "are", "was", "were", "been", "will", "would", "could", "should", "their", "which", "about", "into", "more", "some", "them", "these", "than", "other", "made", "after",
)
TOKEN = r"[\p{L}\p{N}]+"


def _bare(ch: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", ch) if not unicodedata.combining(c))


# letters with diacritics and the letter each stands for, from the character database
_MARKED = {ch: _bare(ch) for ch in map(chr, [*range(0xC0, 0x600), *range(0x1E00, 0x2000)]) if len(_bare(ch)) == 1 and _bare(ch) != ch and ch.isalpha()}


def squeeze(c: Column) -> Column:
    """White space runs as one space, ends trimmed."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column) -> Column:
    """Words apart by white space."""
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.when(c.isNull(), F.lit(0)).otherwise(F.size(words(c)))


def fold(c: Column) -> Column:
    """Lower case without diacritics, whether written as one character or as marks of their own."""
    low = F.lower(c)
    return F.translate(F.when(low.rlike(r"\p{Mn}"), F.regexp_replace(low, r"\p{Mn}+", "")).otherwise(low), "".join(_MARKED), "".join(_MARKED.values()))


def fold_word(word: str) -> str:
    """``fold`` of one word of a query."""
    return "".join(_MARKED.get(c, c) for c in word.lower() if not unicodedata.category(c) == "Mn")


def tokens(c: Column) -> Column:
    """Search tokens: runs of letters and digits, in lower case and without diacritics."""
    return F.regexp_extract_all(fold(c), F.lit(TOKEN), F.lit(0))


def clean_query(c: Column) -> Column:
    """Letters, digits, underscores, hyphens; anything else a space."""
    return squeeze(F.regexp_replace(c, r"[^\p{L}\p{N}_\s-]", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def contains_ci(c: Column, needle: str) -> Column:
    """Case-insensitive contains, without patterns."""
    return F.lower(c).contains(needle.lower())


def contains_any(columns: Sequence[Column], needle: str) -> Column:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(contains_ci(c, needle), F.lit(False))
    return hit


def like_body(value: str, most: int = 50) -> str:
    """The longest beginning of ``value`` that, escaped for LIKE and between wildcards, fits ``most`` bytes."""
    out, used = "", 2
    for ch in value:
        cost = len(ch.encode()) + (ch in "\\%_")
        if used + cost > most:
            break
        out, used = out + ch, used + cost
    return out


def significant_terms(query: str, most: int = 3) -> list[str]:
    """The first terms of a query that are longer than two letters and no stop words."""
    return [t for t in query.split() if len(t) > 2 and t.lower() not in STOP_TERMS][:most]


def contains_terms(columns: Sequence[Column], query: str, most: int = 3) -> Column:
    hit = F.lit(False)
    for t in significant_terms(query, most):
        hit = hit | contains_any(columns, t)
    return hit


def is_readable(c: Column, least_ratio: float = 0.05, least_chars: int = 100, least_words: int = 20) -> Column:
    """Whether a text holds enough frequent words to be readable English."""
    w = words(F.lower(c))
    common = F.size(F.filter(w, lambda x: x.isin(*COMMON_WORDS)))
    return F.coalesce((F.length(c) >= least_chars) & (F.size(w) >= least_words) & (common / F.size(w) >= least_ratio), F.lit(False))


def context(c: Column, start: Column, end: Column, around: int = 150, most: int = 500) -> Column:
    """Text around [start, end) (from 0), spaces squeezed, dots where it was cut."""
    begin = F.greatest(start - around, F.lit(0))
    stop = F.least(end + around, F.length(c))
    body = squeeze(c.substr(begin + 1, stop - begin))
    return F.substring(F.concat(F.when(begin > 0, "...").otherwise(""), body, F.when(stop < F.length(c), "...").otherwise("")), 1, most)


def snippet(c: Column, needle: str, name: Column | None = None, around: int = 150) -> Column:
    """Text around the first case-insensitive match, marked >>>match<<<; else of the name; else the beginning."""
    n = len(needle)
    at = F.locate(needle.lower(), F.lower(c))
    begin = F.greatest(at - around, F.lit(1))
    stop = F.least(at + n - 1 + around, F.length(c))
    marked = F.concat(
        F.when(begin > 1, "...").otherwise(""), c.substr(begin, at - begin), F.lit(">>>"), c.substr(at, F.lit(n)), F.lit("<<<"),
        c.substr(at + n, stop - (at + n) + 1), F.when(stop < F.length(c), "...").otherwise(""),
    )
    out = F.when(at > 0, marked)
    if name is not None:
        k = F.locate(needle.lower(), F.lower(name))
        out = out.when(k > 0, F.concat(F.lit("Filename: "), name.substr(F.lit(1), k - 1), F.lit(">>>"), name.substr(k, F.lit(n)), F.lit("<<<"), name.substr(k + n, F.length(name))))
    head = F.when(F.length(c) > 2 * around, F.concat(F.substring(c, 1, 2 * around), F.lit("..."))).otherwise(c)
    return out.when(F.coalesce(c, F.lit("")) != "", head).otherwise(F.coalesce(name, F.lit("")) if name is not None else F.lit(""))


def mark_html(c: Column) -> Column:
    """>>>x<<< of an escaped snippet as HTML marks."""
    return F.regexp_replace(html_escape(c), r"&gt;&gt;&gt;(.+?)&lt;&lt;&lt;", "<mark>$1</mark>")


def looks_like_filename(c: Column) -> Column:
    """Whether a title is a bare file name: no blanks, and the ending of a stored document."""
    return F.coalesce(F.trim(c).rlike(r"(?i)^[A-Za-z0-9_.\-]+\.(pdf|jpe?g|png|tiff?|mp4|mov|avi|wav|mp3|m4a|docx?|xlsx?|txt)$"), F.lit(False))


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def pieces(c: Column, size: int = 20_000) -> Column:
    """Array of (part from 0, text, running end) of fixed size."""
    n = F.greatest(F.ceil(F.length(c) / F.lit(size)).cast("int"), F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(k.alias("part"), c.substr(k * size + 1, F.lit(size)).alias("piece"), F.least((k + 1) * size, F.length(c)).alias("upto")))
