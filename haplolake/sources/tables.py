"""Delimited tables, BED, GFF, JSON documents, id files and parameter files."""

from __future__ import annotations

import re
from itertools import product

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BED = "chrom string, start bigint, end bigint, name string, score double, strand string"
GFF = "chrom string, source string, type string, start bigint, end bigint, score string, strand string, phase string, attributes string"


def read_delimited(spark: SparkSession, path: str, sep: str = "\t", *, header: bool = True, lower: bool = False, required: list[str] | None = None, schema: str | None = None) -> DataFrame:
    """A delimited table (gzip by extension); ``sep`` 'whitespace' splits on any run of blanks. Missing required columns are an error."""
    if sep == "whitespace":
        lines = spark.read.text(path).where("trim(value) != '' and not value like '#%'").select(F.split(F.trim("value"), r"\s+").alias("c"))
        first = lines.first()
        names = (list(first["c"]) if header else [f"_c{i}" for i in range(len(first["c"]))]) if first else []
        body = lines.where(F.col("c") != F.array(*map(F.lit, names))) if header and names else lines
        df = body.select(*(F.get("c", F.lit(i)).alias(n) for i, n in enumerate(names)))
    else:
        reader = spark.read.option("sep", sep).option("header", header).option("comment", "#" if not header else "")
        df = (reader.schema(schema) if schema else reader).csv(path)
        df = df.toDF(*(c.lstrip("#") for c in df.columns))
    if lower:
        df = df.toDF(*(c.lower() for c in df.columns))
    missing = [c for c in required or [] if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df


def write_delimited(df: DataFrame, path: str, sep: str = "\t", *, mode: str = "errorifexists", compression: str = "none") -> None:
    df.write.mode(mode).option("sep", sep).option("header", True).option("compression", compression).csv(path)


def union_tables(spark: SparkSession, folder: str, pattern: str, sep: str = "\t") -> DataFrame:
    """All tables under a folder whose path matches a regular expression, by column name, absent columns null, with ``source``."""
    files = [r["path"] for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path").collect() if re.search(pattern, r["path"])]
    if not files:
        raise FileNotFoundError(f"nothing in {folder} matches {pattern}")
    out = None
    for path in sorted(files):
        part = read_delimited(spark, path, sep).withColumn("source", F.lit(path.rpartition("/")[2]))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED of three to six columns, half-open from 0; comment, track and browser lines are skipped."""
    parts = spark.read.text(path).where("trim(value) != '' and not value rlike '^(#|track|browser)'").select(F.split("value", "\t").alias("c"))
    kinds = [f.split() for f in BED.split(", ")]
    return parts.select(*(F.get("c", F.lit(i)).try_cast(t).alias(n) for i, (n, t) in enumerate(kinds)))


def write_bed(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select("chrom", "start", "end", "name", "score", "strand").write.mode(mode).option("sep", "\t").csv(path)


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF features with their attributes as a map; start is turned to count from 0, so intervals are half-open like BED."""
    raw = spark.read.option("sep", "\t").option("comment", "#").schema(GFF).csv(path)
    return raw.withColumn("start", F.col("start") - 1).withColumn("attributes", F.str_to_map("attributes", F.lit(";"), F.lit("=")))


def read_json(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """A JSON document per file; a required member that is absent raises an error when the result is read."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    for c in required:
        df = df.withColumn(c, F.coalesce(F.col(c), F.raise_error(F.lit(f"{path} lacks {c}")).cast(dict(df.dtypes)[c])))
    return df


def parse_ids(text: str) -> tuple[list[tuple[str, str, str]], list[tuple[str, str, str | None]]]:
    """Targets (name, forward, reverse) and barcodes (name, forward, reverse or None) of a sectioned id file.

    A section starts with a line ``target fwd rev`` (or ``gene ...``) or ``id barcode [...]``; comment and blank lines are
    skipped. Wrong numbers of columns, rows before a section, and names given twice are errors.
    """
    targets: dict[str, tuple[str, str, str]] = {}
    mids: dict[str, tuple[str, str, str | None]] = {}
    section = None
    for number, line in enumerate(text.splitlines(), 1):
        cells = line.split()
        if not cells or line.lstrip().startswith("#"):
            continue
        head = cells[0].lower()
        if head in ("target", "gene", "id"):
            section = "mid" if head == "id" else "target"
            continue
        if section is None:
            raise ValueError(f"line {number}: a row before any section")
        if section == "target":
            if len(cells) != 3:
                raise ValueError(f"line {number}: a target needs 3 columns, not {len(cells)}")
            if cells[0] in targets:
                raise ValueError(f"line {number}: target {cells[0]} is given twice")
            targets[cells[0]] = (cells[0], cells[1].upper(), cells[2].upper())
        else:
            if len(cells) not in (2, 3):
                raise ValueError(f"line {number}: a barcode needs 2 or 3 columns, not {len(cells)}")
            if cells[0] in mids:
                raise ValueError(f"line {number}: barcode {cells[0]} is given twice")
            mids[cells[0]] = (cells[0], cells[1].upper(), cells[2].upper() if len(cells) == 3 else None)
    return list(targets.values()), list(mids.values())


def read_ids(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The targets and barcodes of an id file as small DataFrames."""
    text = spark.read.text(path, wholetext=True).first()
    targets, mids = parse_ids(text["value"] if text else "")
    return spark.createDataFrame(targets, "target string, fwd_primer string, rev_primer string"), spark.createDataFrame(mids, "mid string, fwd_barcode string, rev_barcode string")


def format_ids(targets: list[tuple], mids: list[tuple]) -> str:
    """The text of an id file; ``parse_ids`` gives the same rows back."""
    lines = ["\t".join(("target", "forward", "reverse")), *("\t".join(t) for t in targets)] if targets else []
    if mids:
        lines += ["\t".join(("id", "barcode")), *("\t".join(c for c in m if c) for m in mids)]
    return "\n".join(lines) + "\n"


def parse_overlap_statuses(text: str) -> dict[str, list[str]]:
    """target -> permitted statuses; NOOVERLAP stands alone, unknown names are errors."""
    # fixed values: the names a status file may use
    known = {"NOOVERLAP", "AUTO", "R1BEGINSINR2", "R1ENDSINR2", "PERFECTOVERLAP"}
    out: dict[str, list[str]] = {}
    for line in text.splitlines()[1:]:
        cells = line.split()
        if not cells:
            continue
        names = [s.upper() for s in cells[1].split(",")]
        if not set(names) <= known or ("NOOVERLAP" in names and len(names) > 1):
            raise ValueError(f"{cells[0]}: {cells[1]} isn't a permitted set of statuses")
        out[cells[0]] = names
    return out


def expand_commands(template: str, lists: dict[str, list[str]]) -> list[str]:
    """A command template with {KEY} places -> one command per combination of the keys it uses, in order."""
    used = [k for k in lists if "{" + k + "}" in template]
    out = []
    for values in product(*(lists[k] for k in used)):
        line = template
        for k, v in zip(used, values, strict=True):
            line = line.replace("{" + k + "}", v)
        out.append(line)
    return out


def write_tree_json(edges: DataFrame, path: str, a: str = "a", b: str = "b", weight: str = "events", *, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Edges of spanning trees as a JSON document per tree (key ``by``): its nodes by name and its links with their weights.

    A tree is one row, so this is for trees that somebody will draw; the edges themselves scale.
    """
    keys = by or []
    links = F.sort_array(F.collect_list(F.struct(F.col(a).alias("source"), F.col(b).alias("target"), F.col(weight).alias("value")))).alias("links")
    nodes = F.array_sort(F.array_distinct(F.concat(F.collect_set(a), F.collect_set(b)))).alias("nodes")
    edges.groupBy(*keys).agg(nodes, links).write.mode(mode).json(path)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The table with metrics that are counted while it is written, without another pass; read them from ``get`` of the observation afterwards."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *(m.alias(k) for k, m in metrics.items())), seen
