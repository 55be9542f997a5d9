"""Columns over record names, metadata in names and report texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the fields of an Illumina read name
ILLUMINA_FIELDS = ["instrument", "run", "flowcell", "lane", "tile", "x", "y", "read", "filtered", "control", "sample_number"]
ILLUMINA = r"^([A-Za-z0-9_]+):([0-9]+):([A-Za-z0-9-]+):([0-9]+):([0-9]+):([0-9]+):([0-9]+) ([12]):([NY]):([0-9]+):([AGCTN+]+|[0-9]+)$"
_META = r"\[([^\]]*)\]"


def illumina(name: Column) -> Column:
    """The fields of a read name as a struct; empty strings where the name has another form."""
    return F.struct(*(F.regexp_extract(name, ILLUMINA, i + 1).alias(f) for i, f in enumerate(ILLUMINA_FIELDS)))


def sample_number(name: Column) -> Column:
    """The sample number or index (also a dual one) of a read name; '' for names of another form.

    The words of a name are its place on the flow cell, seven fields, and its read, four fields of which the last is the
    index. Where the index was moved into a word of its own, that word's leading code counts.
    """
    words = F.split(name, " ")
    place, read = F.split(F.get(words, F.lit(0)), ":"), F.split(F.get(words, F.lit(1)), ":")
    formed = (F.size(place) == 7) & (F.size(read) >= 4) & F.get(read, F.lit(0)).isin("1", "2") & F.get(read, F.lit(1)).isin("Y", "N")
    index = F.get(read, F.lit(3))
    plain = F.when((F.size(read) == 4) & (F.translate(index, "ACGTN+", "") == ""), index).when(index.rlike("^[0-9]+$"), index).otherwise("")
    own = F.regexp_extract(F.get(words, F.lit(2)), "^[0-9A-Za-z|_+-]+", 0)
    return F.coalesce(F.when(formed, F.when(F.size(words) > 2, own).otherwise(plain)), F.lit(""))


def meta(name: Column) -> Column:
    """Metadata written into a name as [k=v;k=v] -> map; an empty map without any."""
    body = F.regexp_extract(name, _META, 1)
    pairs = F.filter(F.split(body, ";"), lambda p: p.contains("="))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    values = F.transform(pairs, lambda p: F.substring(p, F.locate("=", p) + 1, F.length(p)))
    return F.map_from_arrays(keys, values)


def with_meta(name: Column, entries: dict[str, Column]) -> Column:
    """The name with its metadata replaced by ``entries``."""
    body = F.concat_ws(";", *(F.concat(F.lit(k + "="), v.cast("string")) for k, v in entries.items()))
    return F.concat(F.regexp_replace(name, _META, ""), F.lit("["), body, F.lit("]"))


def read_count(name: Column) -> Column:
    """The count at a cluster name's end (_t12 or _12), 1 without one."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, r"_t?([0-9]+)(?:\.[0-9]+)?$", 1), F.lit("")), F.lit("999999999999")).cast("double"), F.lit(1.0))


def percent(part: Column, whole: Column) -> Column:
    """'n(p%)' with two decimals; 0.00 of nothing."""
    return F.format_string("%d(%.2f%%)", part.cast("long"), F.when(whole > 0, part * 100.0 / whole).otherwise(0.0))


def strip_percent(cell: Column) -> Column:
    """The text before the first bracket."""
    return F.regexp_replace(cell, r"\(.*", "")


def padded_number(number: Column, total: Column) -> Column:
    """The number with zeros to the width of ``total``."""
    return F.lpad(number.cast("string"), F.length(total.cast("string")), F.lit("0"))


def true_false(flag: Column) -> Column:
    return F.when(flag, "TRUE").otherwise("FALSE")
