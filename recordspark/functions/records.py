"""Column functions over record fields: titles, Bates numbers, paths, dates, media types, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to media type.
MEDIA_TYPES = {
    "avi": "video/x-msvideo", "bmp": "image/bmp", "gif": "image/gif", "jpeg": "image/jpeg", "jpg": "image/jpeg", "mov": "video/quicktime", "mp4": "video/mp4",
    "pdf": "application/pdf", "png": "image/png", "tif": "image/tiff", "tiff": "image/tiff", "wmv": "video/x-ms-wmv",
}
MEDIA_ALIASES = {"audio/vnd.wave": "audio/wav", "audio/wave": "audio/wav", "audio/x-wav": "audio/wav", "image/jpg": "image/jpeg"}


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c)


def extension(c: Column) -> Column:
    return F.lower(F.nullif(F.regexp_extract(c, r"\.([A-Za-z0-9]{1,5})$", 1), F.lit("")))


def clean_title(c: Column) -> Column:
    """Extension, upload stamp and underscores gone; empty if under four letters or mostly no letters."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?i)\.[a-z0-9]{2,4}$", "")
    t = F.regexp_replace(t, r"^\d{6,}[_-]\s*", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(t, "_+", " "), r"\s+", " "))
    letters = F.regexp_count(t, F.lit("[A-Za-z]"))
    return F.when((F.length(t) < 4) | (letters < F.length(t) * 0.4), "").otherwise(t)


def record_title(bates: Column, said: Column) -> Column:
    """'bates — words' unless both say the same; ``said`` is a cleaned title, null or empty for none."""
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^a-z0-9]", "")
    none = F.coalesce(said, F.lit("")) == ""
    return F.when(none, bates).when(bates.isNull() | (bare(said) == bare(bates)), said).otherwise(F.concat(bates, F.lit(" — "), said))


def bates_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+)$", 1), F.lit("")).cast("bigint")


def bates_pages(c: Column, page_count: Column, first: int = 1, folder_size: int = 2000) -> Column:
    """Array of (page from 0, number, folder, key) of a record's pages; folders start at ``first``."""
    n = bates_number(c)
    prefix = F.regexp_extract(c, r"^(.*?)\d+$", 1)
    offsets = F.sequence(F.lit(0), F.greatest(F.coalesce(page_count, F.lit(1)), F.lit(1)) - 1)

    def page(k):
        number = n + k
        folder = F.floor((number - first) / folder_size) + 1
        return F.struct(k.alias("page"), number.alias("number"), folder.alias("folder"), F.concat(F.lpad(folder.cast("string"), 3, "0"), F.lit("/"), prefix, F.lpad(number.cast("string"), 6, "0"), F.lit(".jpg")).alias("key"))

    return F.filter(F.transform(offsets, page), lambda p: p["folder"] >= 1)


def slash_path(c: Column) -> Column:
    """Backslashes turned, leading ./ and / gone."""
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def object_key(c: Column, marker: str) -> Column:
    """The path after the last ``marker``/, case ignored; null without one."""
    return F.nullif(F.regexp_replace(F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), rf"(?i)^.*{marker}/(.*)$", 1), "^/+", ""), F.lit(""))


def file_stem(c: Column) -> Column:
    """The last path part without its ending; null for null."""
    return F.regexp_replace(F.regexp_extract(F.replace(c, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"\.[^.]*$", "")


def provenance(data_set: Column, labels: dict[str, str], releases: str = "release-", release: str = "Evidence release", other: str = "Public release") -> Column:
    """The label of a set, that of releases, or the general one."""
    return F.coalesce(_lookup(data_set, labels), F.when(data_set.startswith(releases), release), F.lit(other))


def released_name(filename: Column, title: Column, bates: Column) -> Column:
    """The released file name worth telling: not the Bates number over again; else a title that is a file name; else ''."""
    own = F.coalesce((filename != "") & ~filename.eqNullSafe(bates) & ~filename.eqNullSafe(F.concat(bates, F.lit(".pdf"))), F.lit(False))
    return F.when(own, filename).when(F.coalesce(title, F.lit("")).rlike(r"(?i)\.[a-z0-9]{2,4}$"), title).otherwise("")


def media_type(c: Column) -> Column:
    """A media type without parameters, lower case, aliases resolved."""
    bare = F.lower(F.trim(F.substring_index(c, ";", 1)))
    return F.coalesce(_lookup(bare, MEDIA_ALIASES), F.nullif(bare, F.lit("")))


def native_target(bates: Column, title: Column, folder: str = "natives") -> Column:
    """(key, content_type) of the native media a record's title names by its ending; null where it names none."""
    ending = F.lower(F.regexp_extract(F.coalesce(title, F.lit("")), r"(?i)\.(mp4|mov|avi|wmv)$", 1))
    return F.when((ending != "") & bates.isNotNull(), F.struct(F.concat(F.lit(folder + "/"), bates, F.lit("."), ending).alias("key"), _lookup(ending, MEDIA_TYPES).alias("content_type")))


def content_type_of(name: Column, document_type: Column) -> Column:
    return F.coalesce(_lookup(extension(name), MEDIA_TYPES), F.when(F.lower(document_type).contains("mail"), "message/rfc822"), F.lit("application/octet-stream"))


def document_type_of(name: Column, content_type: Column, page: Column) -> Column:
    """Document type from media type, file name and source page; the first rule that holds."""
    f, s = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(page, F.lit("")))
    return (
        F.when(F.coalesce(content_type, F.lit("")).contains("image"), "image")
        .when(f.contains("flight") | f.contains("log"), "flight_log")
        .when(s.contains("court") | f.contains("indictment"), "court_record")
        .when(f.contains("fbi") | f.contains("memorandum"), "fbi_notes")
        .when(f.contains("email") | f.contains(".eml"), "email")
        .when(f.contains(".mp4") | f.contains(".mov") | f.contains("video"), "video")
        .when(f.contains(".pdf"), "pdf")
        .otherwise("other")
    )


def set_key(c: Column) -> Column:
    """One spelling per release: words and numbers joined by '-', numbers with two digits; null stays null."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z0-9]+", "-")
    number = F.regexp_extract(bare, r"(\d+)$", 1)
    return F.when(number != "", F.concat(F.regexp_replace(bare, r"-?\d+$", ""), F.lit("-"), F.lpad(F.regexp_replace(number, "^0+(?=.)", ""), 2, "0"))).otherwise(bare)


def doc_type_key(c: Column) -> Column:
    """One spelling per document type."""
    bare = F.regexp_replace(F.lower(F.trim(c)), r"[^a-z]+", "_")
    return F.when(bare.isin("e_mail", "mail"), "email").otherwise(F.coalesce(bare, F.lit("unknown")))


def date_prefix(c: Column) -> Column:
    """The first ten characters if they are a date, else null; provenance tags after them do no harm."""
    d = F.substring(c.cast("string"), 1, 10)
    return F.when(d.rlike(r"^\d{4}-\d{2}-\d{2}$"), d)


def us_date(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit("MM/dd/yyyy"))


def confidence_label(c: Column, has_text: Column) -> Column:
    return F.when(~has_text, "no text").when(c.isNull(), "text").otherwise(F.concat(F.lit("text, "), F.round(c * 100).cast("int").cast("string"), F.lit(" % sure")))


def item_meta(data_set: Column, document_type: Column, page_count: Column) -> Column:
    """'set · type · n pages'; media have no page count, nulls are left out."""
    media = document_type.isin("video", "audio")
    pages = F.when(~media & (page_count > 0), F.concat(page_count.cast("string"), F.when(page_count == 1, " page").otherwise(" pages")))
    return F.concat_ws(" · ", data_set, document_type, pages)


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, a path at least /, query kept, fragment gone."""
    scheme, rest = F.lower(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)), F.regexp_extract(c, r"^[^:]+://([^/?#]*)", 1)
    path = F.coalesce(F.nullif(F.regexp_extract(c, r"^[^:]+://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    query = F.regexp_extract(c, r"(\?[^#]*)", 1)
    return F.concat(scheme, F.lit("://"), F.lower(rest), path, query)
