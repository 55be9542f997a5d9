"""Duplicates hidden by formatting: bottom-up digests of nested records.

Leaves are normalised (letters and digits only, lower case) and digested; the header is an
unordered node, so its children's digests are sorted before they are digested again; the record
is an ordered node of header and sequence. Records are grouped by the 128-bit root digest, with
partial aggregation; the same aggregation compares their full normalised structures. Members that
only share the digest are regrouped by that structure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise

#: a field of a header: name, '=' or ':', then anything up to the next separator or bracket
FIELD = r"""([\p{L}\p{N}_.\- ]+?)\s*[=:]\s*("[^"]*"|'[^']*'|[^;|,\]\)\[\(\r\n\t]*)"""
_NOISE = r"[^\p{L}\p{N}]+"


def plain(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.lower(F.regexp_replace(text, _NOISE, ""))


def header_fields(header: Column) -> Column:
    """The header's fields as sorted, normalised 'name=value' strings; a field given twice alike counts once."""
    names = F.regexp_extract_all(header, F.lit(FIELD), F.lit(1))
    values = F.regexp_extract_all(header, F.lit(FIELD), F.lit(2))
    pairs = F.zip_with(names, values, lambda n, v: F.concat(plain(n), F.lit("="), plain(v)))
    return F.array_sort(F.array_distinct(pairs))


def root_digest(fields: Column, seq: Column) -> Column:
    """Digest of a record from its normalised leaves; a null part digests unlike an empty one."""
    leaves = F.array_sort(F.transform(fields, lambda leaf: F.md5(leaf.cast("binary"))))
    node = F.md5(F.array_join(leaves, "").cast("binary"))
    leaf = F.md5(seq.cast("binary"))
    return F.md5(F.concat(F.coalesce(node, F.lit("-")), F.lit("|"), F.coalesce(leaf, F.lit("-"))).cast("binary"))


def canonical_records(df: DataFrame, rec_id: str, header: str, seq: str) -> DataFrame:
    """Columns rec_id, root, body: the record's digest and its normalised structure."""
    parts = df.select(F.col(rec_id).alias("rec_id"), header_fields(F.col(header)).alias("fields"), plain(F.col(seq)).alias("seq"))
    body = F.concat(F.coalesce(F.array_join("fields", "\u0001"), F.lit("\u0002")), F.lit("\u0003"), F.coalesce("seq", F.lit("\u0002")))
    return parts.select("rec_id", root_digest(F.col("fields"), F.col("seq")).alias("root"), body.alias("body"))


def collapse_formatting(df: DataFrame, rec_id: str, header: str, seq: str) -> DataFrame:
    """One row per distinct record: first_rec_id (the smallest id), root and copies.

    Two records are the same if their headers hold the same field names with the same values and
    their sequences the same bases, apart from order of fields, letter case, white space and
    punctuation. A null header (sequence) only equals a null one, not an empty one. Rows with a null
    ``rec_id`` count as copies; a group of only such rows has a null first_rec_id. A row that comes
    again under the same id counts again. An empty table gives no rows. Only the three named columns are read.
    """
    records = materialise(canonical_records(df, rec_id, header, seq), "records")
    groups = _groups(records)
    mixed = _regrouped(records, groups)
    return groups.where("_same").select("first_rec_id", "root", "copies").unionByName(mixed.select("first_rec_id", "root", "copies"))


def repeated_records(df: DataFrame, rec_id: str, header: str, seq: str) -> DataFrame:
    """(first_rec_id, rec_id) for each record that repeats an earlier one; same rule as ``collapse_formatting``.

    The normalised table is written once. The rows that then meet their group's first one are a digest and
    an id; adaptive execution splits a hot digest, whose other side is one row. Rows with a null id are left out.
    """
    records = materialise(canonical_records(df, rec_id, header, seq).where(F.col("rec_id").isNotNull()), "records")
    groups = _groups(records)
    same = records.select("root", "rec_id").join(groups.where("_same and copies > 1").select("root", "first_rec_id"), "root")
    mixed = _members(records, groups).join(_regrouped(records, groups), ["root", "body"])
    return same.select("first_rec_id", "rec_id").unionByName(mixed.select("first_rec_id", "rec_id")).where(F.col("rec_id") > F.col("first_rec_id"))


def _groups(records: DataFrame) -> DataFrame:
    """Per digest: first_rec_id, copies and whether all structures behind it are the same, compared in full.

    The partial aggregate leaves one row per digest and task, however many copies a group has.
    """
    per = records.groupBy("root").agg(F.min("rec_id").alias("first_rec_id"), F.count("*").alias("copies"), F.min("body").alias("_least"), F.max("body").alias("_most"))
    return per.select("root", "first_rec_id", "copies", (F.col("_least") == F.col("_most")).alias("_same"))


def _members(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Records whose digest stands for several structures."""
    return records.join(groups.where("not _same").select("root"), "root", "left_semi")


def _regrouped(records: DataFrame, groups: DataFrame) -> DataFrame:
    """Those records grouped by the structure itself."""
    return _members(records, groups).groupBy("root", "body").agg(F.min("rec_id").alias("first_rec_id"), F.count("*").alias("copies"))
