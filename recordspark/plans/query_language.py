"""The search language: quoted phrases, OR, and AND between neighbours; AND binds tighter."""

from __future__ import annotations

import re
import unicodedata

from recordspark.config import MAX_QUERY_CHARS
from recordspark.functions.text import fold_word

LEXER = re.compile(r'"(?P<phrase>[^"]*)"|(?P<word>[^\s"]+)')
NOT_TERM = re.compile(r"[^\w\s-]", re.UNICODE)
TOKEN = re.compile(r"[^\W_]+", re.UNICODE)


class QueryError(ValueError):
    """A query that cannot be read."""


def parse(query: str, most: int = MAX_QUERY_CHARS) -> list[list[tuple[str, ...]]]:
    """Alternatives of conjunctions of phrases, a phrase being its search tokens in order."""
    if len(query) > most:
        raise QueryError(f"a query has at most {most} characters")
    alternatives: list[list[tuple[str, ...]]] = [[]]
    waiting = False
    for m in LEXER.finditer(query):
        word = m["word"]
        if word is not None and word.upper() == "OR":
            if waiting or not alternatives[-1]:
                raise QueryError("OR stands between two terms")
            alternatives.append([])
            waiting = True
            continue
        found = tuple(TOKEN.findall(fold_word(NOT_TERM.sub(" ", unicodedata.normalize("NFC", m["phrase"] if word is None else word)))))
        if found:
            alternatives[-1].append(found)
            waiting = False
    if waiting:
        raise QueryError("OR stands between two terms")
    if not alternatives[-1]:
        raise QueryError("a query has at least one letter or digit")
    return alternatives


def as_phrase(query: str) -> list[list[tuple[str, ...]]]:
    """The whole query as one phrase."""
    found = tuple(TOKEN.findall(fold_word(unicodedata.normalize("NFC", query))))
    if not found:
        raise QueryError("a query has at least one letter or digit")
    return [[found]]
