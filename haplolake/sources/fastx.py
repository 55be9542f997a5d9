"""FASTA and FASTQ, plain or gzip, as a Python data source and as writers.

``spark.read.format("fastx").load(path)`` reads files of a folder in parallel, one partition per file (a gzip
stream can't be split), as Arrow batches: (source, ordinal, name, seq, qual). The ordinal is the record's place in
its file, so mates of two files are joined by (library, ordinal), never by an id made up at run time.
Paths are local or on a mounted shared file system; ``to_table`` makes a splittable Parquet copy for all later reads.
"""

from __future__ import annotations

import glob
import gzip
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import quality
from ..functions import sequence as sq

SCHEMA = "source string, ordinal bigint, name string, seq string, qual array<smallint>"
_ARROW = pa.schema([("source", pa.string()), ("ordinal", pa.int64()), ("name", pa.string()), ("seq", pa.string()), ("qual", pa.list_(pa.int16()))])
# fixed values: extensions and the formats they mean
FORMATS = {"fasta": "fasta", "fa": "fasta", "fna": "fasta", "fastq": "fastq", "fq": "fastq"}
BATCH = 5000


def format_of(path: str) -> str:
    """'fasta' or 'fastq' by the file's extension (.gz aside); an error for anything else."""
    ext = path.lower().removesuffix(".gz").rpartition(".")[2]
    if ext not in FORMATS:
        raise ValueError(f"{path} has no known sequence format; known: {', '.join(FORMATS)}")
    return FORMATS[ext]


def _records(path: str) -> Iterator[tuple[str, str, str | None]]:
    opener = gzip.open if path.endswith(".gz") else open
    with opener(path, "rt") as f:
        if format_of(path) == "fasta":
            name, parts = None, []
            for line in f:
                line = line.rstrip("\r\n")
                if line.startswith(">"):
                    if name is not None:
                        yield name, "".join(parts), None
                    name, parts = line[1:], []
                elif name is None:
                    if line.strip():
                        raise ValueError(f"{path}: sequence before the first '>'")
                else:
                    parts.append(line.strip())
            if name is not None:
                yield name, "".join(parts), None
            return
        while header := f.readline():
            if not header.strip():
                continue
            seq, plus, qual = (f.readline().rstrip("\r\n") for _ in range(3))
            if not header.startswith("@") or not plus.startswith("+") or len(seq) != len(qual):
                raise ValueError(f"{path}: broken record {header.strip()!r}")
            yield header[1:].rstrip("\r\n"), seq, qual


class FilePartition(InputPartition):
    def __init__(self, path: str):
        self.path = path


class FastxReader(DataSourceReader):
    def __init__(self, path: str, offset: int):
        self.path, self.offset = path, offset

    def partitions(self) -> list[InputPartition]:
        path = self.path.removeprefix("file://")
        files = sorted(glob.glob(path)) if glob.has_magic(path) else [path]
        found = []
        for p in files:
            if os.path.isdir(p):
                found += [os.path.join(d, n) for d, _, names in sorted(os.walk(p)) for n in sorted(names) if n.lower().removesuffix(".gz").rpartition(".")[2] in FORMATS]
            else:
                format_of(p)
                found.append(p)
        if not found:
            raise FileNotFoundError(self.path)
        return [FilePartition(p) for p in found]

    def read(self, partition: FilePartition) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for k, (name, seq, qual) in enumerate(_records(partition.path)):
            values = None if qual is None else (np.frombuffer(qual.encode("latin-1"), np.uint8).astype(np.int16) - self.offset)
            rows.append((partition.path, k, name, seq, values))
            if len(rows) == BATCH:
                yield self._batch(rows)
                rows = []
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class FastxSource(DataSource):
    """Options: path, offset (quality offset, 33)."""

    @classmethod
    def name(cls) -> str:
        return "fastx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FastxReader:  # noqa: ANN001
        return FastxReader(self.options["path"], int(self.options.get("offset", "33")))


def read(spark: SparkSession, path: str, offset: int = 33) -> DataFrame:
    spark.dataSource.register(FastxSource)
    return spark.read.format("fastx").option("offset", str(offset)).load(path)


def read_pairs(spark: SparkSession, path1: str, path2: str, *, mate_rc: bool = False) -> DataFrame:
    """Mates of two files or file sets by library and ordinal: (library, ordinal, name, r1, q1, r2, q2).

    The library is the file name before _R1/_R2. A record without a mate raises an error when the result is read.
    """
    library = F.regexp_replace(F.regexp_extract("source", r"([^/]+)$", 1), r"_R?[12](_[0-9]+)?\.(fastq|fq|fasta|fa)(\.gz)?$", "")
    one = read(spark, path1).select(library.alias("library"), "ordinal", "name", F.col("seq").alias("r1"), F.col("qual").alias("q1"))
    two = read(spark, path2).select(library.alias("library"), "ordinal", F.col("name").alias("_name2"), F.col("seq").alias("r2"), F.col("qual").alias("q2"))
    both = one.join(two, ["library", "ordinal"], "full")
    lone = F.col("name").isNull() | F.col("_name2").isNull()
    checked = both.withColumn("name", F.when(lone, F.raise_error(F.concat(F.lit("no mate for record "), F.col("ordinal").cast("string"), F.lit(" of "), F.col("library"))).cast("string")).otherwise(F.col("name"))).drop("_name2")
    return checked.withColumns({"r2": sq.revcomp(F.col("r2")), "q2": F.reverse("q2")}) if mate_rc else checked


def fasta_text(name: Column, seq: Column) -> Column:
    return F.concat(F.lit(">"), name, F.lit("\n"), seq)


def fastq_text(name: Column, seq: Column, qual: Column, offset: int = 33) -> Column:
    return F.concat(F.lit("@"), name, F.lit("\n"), seq, F.lit("\n+\n"), quality.encode(qual, offset))


def write(df: DataFrame, path: str, name: str, seq: str, qual: str | None = None, *, by: list[str] | None = None, compression: str = "none", mode: str = "errorifexists") -> None:
    """Write records as text files, one folder per value of ``by`` (a keyed multi-writer without open handles).

    Rows with a null name or sequence are left out, as are rows with null qualities in FASTQ.
    """
    text = fastq_text(F.col(name), F.col(seq), F.col(qual)) if qual else fasta_text(F.col(name), F.col(seq))
    rows = df.select(text.alias("value"), *(by or [])).where("value is not null")
    writer = rows.write.mode(mode).option("compression", compression)
    (writer.partitionBy(*by) if by else writer).text(path)


def write_pairs(df: DataFrame, path: str, name: str, first: tuple[str, str | None], second: tuple[str, str | None], *, by: list[str] | None = None, compression: str = "none", mode: str = "errorifexists") -> None:
    """Write mates as two datasets ``path``/R1 and ``path``/R2, each a folder per value of ``by``; records are sorted by name within a task, so mates stand in the same order.

    Pairs of which either mate lacks what its text needs (name, sequence, qualities) are left out of both.
    """
    text = {side: fastq_text(F.col(name), F.col(s), F.col(q)) if q else fasta_text(F.col(name), F.col(s)) for side, (s, q) in (("R1", first), ("R2", second))}
    rows = df.select(F.col(name).alias("_n"), text["R1"].alias("R1"), text["R2"].alias("R2"), *(by or [])).where("R1 is not null and R2 is not null")
    rows = rows.sortWithinPartitions(*(by or []), "_n")
    for side in ("R1", "R2"):
        writer = rows.select(F.col(side).alias("value"), *(by or [])).write.mode(mode).option("compression", compression)
        (writer.partitionBy(*by) if by else writer).text(f"{path}/{side}")


def write_by_status(df: DataFrame, path: str, name: str, seq: str, qual: str, status: str, expected: str, *, mode: str = "errorifexists") -> None:
    """Write stitched records into folders route=good or route=bad and status=..., by whether the array ``expected`` holds their status.

    A null status or null expectation is bad.
    """
    route = F.when(F.array_contains(expected, F.col(status)), "good").otherwise("bad")
    write(df.withColumns({"route": route, "status": F.coalesce(F.col(status), F.lit("NONE"))}), path, name, seq, qual, by=["route", "status"], mode=mode)


def write_to_locations(df: DataFrame, path: str, name: str, seq: str, qual: str | None, key: str, locations: DataFrame, *, mode: str = "errorifexists") -> None:
    """Write records under location=<folder> of their key, from a table (key, location); a key that isn't there is tried without _R1 or _R2 at its end.

    Records of unknown keys are left out.
    """
    known = locations.select(F.col("key").alias("_k"), "location").dropna().dropDuplicates(["_k"])
    plain = F.regexp_replace(F.col(key), "_R[12]$", "")
    met = df.join(known, F.col(key) == F.col("_k"), "left").drop("_k").withColumnRenamed("location", "_own")
    met = met.join(known, plain == F.col("_k"), "left").withColumn("location", F.coalesce("_own", "location")).where("location is not null")
    write(met, path, name, seq, qual, by=["location"], mode=mode)
