"""Problem 4: duplicates hidden by formatting, by Merkle-style digests.

Leaves are normalised (letters and digits only, case folded) and hashed. A load
file record is an unordered node: the digests of its labelled fields are sorted
before they are hashed into the root; nested records (``digest``, ``record_groups``)
are hashed bottom up the same way, at any depth. Records with one root digest are
confirmed by comparing their whole normalised content: per digest the least
and the greatest content must be the same string, which needs no group in one
task; where they are not, the contents themselves tell the copies. Records with one file
hash, however written, are copies as well, and the two relations are closed by connected components.

Null, empty and blank texts and hashes join nothing. A record that has neither
is its own record with one copy. Repeated ids count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from recordspark.operators.components import connected_components
from recordspark.session import cut

# The field labels of load-file records.
LABELS = ("Bates Begin", "Bates End", "Custodian", "Date Created", "Original Filename", "Document Extension", "Pages", "File Size", "Document Title", "Email Subject", "MD5 Hash", "Box", "Comment")
KEY_LABEL = "Bates Begin"
START, MIDDLE = "\u0001", "\u0002"


def normalise(text: Column) -> Column:
    """Letters and digits of a text, case folded."""
    return F.lower(F.upper(F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")))


def _label(name: str) -> str:
    return r"\s+".join(name.split())


def is_load_record(text: Column) -> Column:
    return text.rlike(rf'(?i)(?<![\p{{L}}\p{{N}}]){_label(KEY_LABEL)}\s*"?\s*[:=\-]')


def fields(text: Column, labels=LABELS) -> Column:
    """Sorted array of normalised 'label MIDDLE value' strings of a load-file record."""
    any_label = "|".join(_label(x) for x in labels)
    marked = F.regexp_replace(text, rf'(?i)(^|[\s|;,{{"]){{1}}({any_label})\s*"?\s*(?:[:=]|-\s)', START + "$2" + MIDDLE)
    parts = F.filter(F.split(marked, START), lambda p: p.contains(MIDDLE))
    folded = F.transform(parts, lambda p: F.concat(normalise(F.substring_index(p, MIDDLE, 1)), F.lit(MIDDLE), normalise(F.substring_index(p, MIDDLE, -1))))
    return F.array_sort(folded)


def content(text: Column, labels=LABELS) -> Column:
    """The whole normalised content; equal for copies only. Null if nothing is left."""
    plain = normalise(text)
    record = F.concat(F.lit(START), F.array_join(fields(text, labels), START))
    return F.nullif(F.when(is_load_record(text), record).otherwise(plain), F.lit(""))


def root_digest(text: Column, labels=LABELS) -> Column:
    """Root of the digest tree over a text's leaves."""
    leaves = F.array_sort(F.transform(fields(text, labels), lambda x: F.md5(x)))
    plain = normalise(text)
    return F.when(is_load_record(text), F.sha2(F.concat(F.lit("node:"), F.array_join(leaves, "")), 256)).when(plain != "", F.sha2(F.concat(F.lit("leaf:"), plain), 256))


def _tree(value: Column, kind: DataType, leaf, node, ordered: bool) -> Column:
    """A nested value, bottom up: ``leaf`` of a normalised value, ``node`` of the array of its children, sorted where order means nothing."""
    if isinstance(kind, StructType):
        children = F.array(*[F.concat(normalise(F.lit(f.name)), F.lit(MIDDLE), _tree(value[f.name], f.dataType, leaf, node, ordered)) for f in kind.fields])
        return F.when(value.isNull(), leaf(F.lit(""))).otherwise(node(F.array_sort(children)))
    if isinstance(kind, MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.concat(normalise(e["key"].cast("string")), F.lit(MIDDLE), _tree(e["value"], kind.valueType, leaf, node, ordered)))
        return F.when(value.isNull(), leaf(F.lit(""))).otherwise(node(F.array_sort(entries)))
    if isinstance(kind, ArrayType):
        items = F.transform(value, lambda v: _tree(v, kind.elementType, leaf, node, ordered))
        return F.when(value.isNull(), leaf(F.lit(""))).otherwise(node(items if ordered else F.array_sort(items)))
    return leaf(F.coalesce(normalise(value.cast("string")), F.lit("")))


def digest(value: Column, kind: DataType, ordered: bool = False) -> Column:
    """Root digest of a nested value: fields and map entries in any order, and array items too unless ``ordered``.

    Null and blank leaves are equal.
    """
    return _tree(value, kind, lambda x: F.md5(F.concat(F.lit("leaf:"), x)), lambda c: F.md5(F.concat(F.lit("node:"), F.array_join(c, ""))), ordered)


def canonical(value: Column, kind: DataType, ordered: bool = False) -> Column:
    """A nested value written in one way; equal for equal structures only."""
    return _tree(value, kind, lambda x: x, lambda c: F.concat(F.lit("{"), F.array_join(c, START), F.lit("}")), ordered)


def record_groups(records: DataFrame, id_col: str, ordered: bool = False) -> DataFrame:
    """Rows (first_id, copy_id) of nested records that are equal but for form and order; ``first_id`` is the least id, itself included.

    Null ids take no part; repeated ids count once.
    """
    whole = F.struct(*[c for c in records.columns if c != id_col])
    kind = records.drop(id_col).schema
    rows = records.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), whole.alias("r"))
    return _proven(cut(rows.select("id", digest(F.col("r"), kind, ordered).alias("root"))), rows.select("id", canonical(F.col("r"), kind, ordered).alias("content"))).select(F.col("first").alias("first_id"), F.col("id").alias("copy_id")).distinct()


def _proven(roots: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows (first, id) of the ids of one root (id, root) whose contents (id, content) are the same; ``first`` is the least of them."""
    text_first = roots.groupBy("root").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = roots.join(text_first, "root").select("id", "root", "first")
    held = contents.join(members.select("id", "root"), "id").select("root", "id", "content")
    # whole content compared: one string per root, gathered by its least and greatest
    proof = cut(held.groupBy("root").agg((F.min("content") == F.max("content")).alias("same")))
    same = members.join(proof.filter("same").select("root"), "root").select("first", "id")
    if proof.filter("not same").isEmpty():
        return same
    # two contents under one digest: told apart by themselves
    apart = held.join(proof.filter("not same").select("root"), "root")
    firsts = apart.groupBy("root", "content").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return same.unionAll(apart.join(firsts, ["root", "content"]).select("first", "id"))


def hash_key(file_hash: Column) -> Column:
    """A file hash without prefix, separators and case; null if too short to be one."""
    bare = F.regexp_replace(F.lower(F.trim(file_hash)), r"^(?:sha-?(?:1|256|512)|md5)\s*[:\-=]\s*", "")
    bare = F.regexp_replace(bare, r"[^0-9a-z]", "")
    return F.when(F.length(bare) >= 16, bare)


def copy_groups(documents: DataFrame, texts: DataFrame, id_col: str = "id", hash_col: str = "file_hash", text_id: str = "document_id", text_col: str = "full_text", labels=LABELS) -> DataFrame:
    """Rows (first_id, copy_id) of every record that has a copy, first_id included as its own copy; ``labels`` are the fields of load-file records."""
    by_hash = documents.select(F.col(id_col).alias("id"), hash_key(F.col(hash_col)).alias("key")).filter("key is not null and id is not null")
    hash_first = by_hash.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    hash_links = by_hash.join(hash_first, "key").filter("id <> first").select("first", "id")

    source = texts.select(F.col(text_id).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null")
    roots = cut(source.select("id", root_digest(F.col("text"), labels).alias("root")).filter("root is not null"))
    text_links = _proven(roots, source.select("id", content(F.col("text"), labels).alias("content"))).filter("id <> first").select("first", "id")

    groups = connected_components(hash_links.unionAll(text_links), "first", "id")
    return groups.select(F.col("component").alias("first_id"), F.col("node").alias("copy_id"))


def copies(documents: DataFrame, texts: DataFrame) -> DataFrame:
    """One row per kept record: (first_id, copies), copies counting the record itself."""
    groups = cut(copy_groups(documents, texts))
    counted = groups.groupBy("first_id").agg(F.count(F.lit(1)).alias("copies"))
    rest = documents.select(F.col("id").alias("first_id")).filter("first_id is not null").distinct().join(groups.select(F.col("copy_id").alias("first_id")), "first_id", "left_anti")
    return counted.unionAll(rest.select("first_id", F.lit(1).cast("bigint").alias("copies")))
