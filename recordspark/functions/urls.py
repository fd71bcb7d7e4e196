"""Column functions over URLs, header policies and stored file names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

DOCUMENT_ENDINGS = ("pdf", "doc", "docx", "jpg", "jpeg", "png", "tif", "tiff", "mp4", "mov", "mp3", "wav", "zip", "txt", "eml", "msg")


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def is_document_url(url: Column) -> Column:
    """Whether a URL's path ends like a stored document."""
    return F.lower(path_of(url)).rlike(r"\.(" + "|".join(DOCUMENT_ENDINGS) + r")$")


def set_of_url(url: Column) -> Column:
    """The release named in a URL ('release-7', 'data-set_03'), in one spelling; null without one."""
    n = F.regexp_extract(F.lower(url), r"(?:release|data[-_ ]?set)[-_ ]?0*(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("release-"), F.lpad(n, 2, "0")))


def safe_filename(url: Column, most: int = 100) -> Column:
    """Last path part with odd characters replaced; the URL's digest where nothing is left or it is too long."""
    last = F.regexp_replace(F.element_at(F.split(path_of(url), "/"), -1), r"[^A-Za-z0-9._-]+", "_")
    return F.when((F.length(last) == 0) | (F.length(last) > most), F.md5(url)).otherwise(last)


def header_policy(value: Column) -> Column:
    """Map of directive to array of sources of a policy header."""
    parts = F.filter(F.transform(F.split(value, ";"), lambda p: F.trim(p)), lambda p: p != "")
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.lower(F.substring_index(p, " ", 1)).alias("k"), F.filter(F.split(F.regexp_replace(p, r"^\S+\s*", ""), r"\s+"), lambda s: s != "").alias("v"))))


def byte_range(value: Column) -> Column:
    """(first, last, total) of a 'bytes a-b/n' value; nulls where it is none."""
    part = lambda k: F.nullif(F.regexp_extract(value, r"^bytes (\d+)-(\d+)/(\d+)$", k), F.lit("")).cast("bigint")
    return F.struct(part(1).alias("first"), part(2).alias("last"), part(3).alias("total"))


def hashed_asset(html: Column, ending: str = "js") -> Column:
    """The first asset of a page whose name holds the hash of its content; null without one."""
    return F.nullif(F.regexp_extract(html, rf"""(?:src|href)=["']([^"']*[-.][0-9a-fA-F]{{8,}}\.{ending})["']""", 1), F.lit(""))


def is_jpeg(content: Column) -> Column:
    """Whether bytes begin as a JPEG file does."""
    return F.coalesce(F.hex(F.substring(content, 1, 3)) == "FFD8FF", F.lit(False))


@F.pandas_udf(StringType())
def truncate_utf8(texts: pd.Series, most: pd.Series, note: pd.Series) -> pd.Series:
    """Texts of more than ``most`` bytes cut between characters, with a note that keeps them within; null stays null."""

    def cut(text, limit, said):
        if text is None or len(text.encode()) <= limit:
            return text
        return text.encode()[: max(0, limit - len(said.encode()))].decode("utf-8", "ignore") + said

    return pd.Series([cut(t, n, x) for t, n, x in zip(texts, most, note)])


@F.pandas_udf(ArrayType(StringType()))
def utf8_chunks(texts: pd.Series, most: pd.Series) -> pd.Series:
    """Parts of at most ``most`` bytes, cut between characters; there is no built-in for it."""

    def cut(text, limit):
        if text is None:
            return None
        out, held = [], bytearray()
        for ch in text:
            b = ch.encode()
            if held and len(held) + len(b) > limit:
                out.append(held.decode())
                held = bytearray()
            held += b
        return [*out, held.decode()] if held or not out else out

    return pd.Series([cut(t, n) for t, n in zip(texts, most)])
