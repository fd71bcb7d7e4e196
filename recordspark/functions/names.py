"""Column functions over names of people and organisations."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordspark.functions.text import squeeze, words

# Title and suffix lists, in the order in which they are taken away.
NAME_TITLES = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "Hon.", "Rev.")
NAME_SUFFIXES = ("Jr.", "Sr.", "II", "III", "IV", "Esq.", "PhD", "MD")
KEY_TITLES = ("mr.", "mrs.", "ms.", "dr.", "hon.", "prof.")
KEY_SUFFIXES = ("jr.", "sr.", "ii", "iii", "iv", "esq.", "phd", "md")
# Shapes of extracted strings that are no names (case-insensitive, from the start).
JUNK_SHAPES = (
    r"^[A-Z]{1,3}$",
    r"^[0-9\s\-\.]+$",
    r"^(The|A|An|This|That|It|He|She|They|We|I|You)\s*$",
    r"^(Mr|Mrs|Ms|Dr|Jr|Sr|Inc|LLC|Corp)\.?$",
    r"^(See|Dkt|Ex|Exh|Exhibit|Page|pp|Id|Ibid)\.?\s*\d*$",
    r"^(January|February|March|April|May|June|July|August|September|October|November|December)\s*\d*$",
    r"^\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}$",
    r"^[A-Z]\.[A-Z]\.$",
    r"^\$[\d,\.]+$",
    r"^(Plaintiff|Defendant|Petitioner|Respondent|Appellant|Appellee)s?$",
    r"^(Court|Judge|Attorney|Counsel|Clerk)$",
    r"^(United States|U\.S\.|USA)$",
)


def display_name(c: Column) -> Column:
    """A name without titles before and suffixes after it, each taken away once, in order."""
    out = squeeze(c)
    for t in NAME_TITLES:
        out = F.trim(F.regexp_replace(out, "^" + re.escape(t) + " ", ""))
    for s in NAME_SUFFIXES:
        out = F.trim(F.regexp_replace(out, " " + re.escape(s) + "$", ""))
    return out


def merge_key(c: Column) -> Column:
    """The key under which two names are one for merging: lower case, titles anywhere and suffixes gone."""
    out = F.trim(F.lower(c))
    for t in KEY_TITLES:
        out = F.replace(out, F.lit(t), F.lit(""))
    for s in KEY_SUFFIXES:
        out = F.regexp_replace(out, " " + re.escape(s) + "$", "")
    return squeeze(out)


@F.pandas_udf(StringType())
def fold_key(names: pd.Series) -> pd.Series:
    """Compatibility form, spaces squeezed, full case folding; there is no built-in for it."""
    import unicodedata

    return names.map(lambda s: None if s is None else " ".join(unicodedata.normalize("NFKC", s).split()).casefold())


def is_junk_name(c: Column, label: Column | None = None, backreference: bool = True) -> Column:
    """Whether an extracted string is no usable name; rules of length, shape, case, noise and word length."""
    t = F.trim(c)
    letters, digits = F.regexp_count(t, F.lit("[a-zA-Z]")), F.regexp_count(t, F.lit("[0-9]"))
    w = words(t)
    lengths = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    rules = [
        F.length(t) < 2,
        F.length(t) > 80,
        letters == 0,
        *(t.rlike("(?i)" + p) for p in JUNK_SHAPES),
        ~t.contains(" ") & (F.upper(t) == t) & (F.length(t) > 5) & (letters > 0),
        t.rlike(r"[*•\[\]{}|\\<>\n]"),
        (F.size(w) > 1) & F.forall(w, lambda x: F.length(x) <= 2),
        (F.size(w) == 1) & (F.lower(t) == t) & (letters > 0),
        (F.size(w) >= 2) & (lengths / F.size(w) < 3),
    ]
    if backreference:
        rules.append(F.lower(t).rlike(r"(.)\1{3,}"))
    if label is not None:
        rules.append((F.upper(label) == "PERSON") & (digits > letters * 0.3))
    return F.coalesce(reduce(lambda a, b: a | b, rules), F.lit(True))


def type_key(c: Column) -> Column:
    """One vocabulary for entity types; unknown ones in lower case."""
    low = F.lower(c)
    return F.when(low.isin("org", "organization", "organisation"), "organization").when(low.isin("per", "person"), "person").when(low.isin("loc", "gpe", "location"), "location").otherwise(F.coalesce(low, F.lit("unknown")))
