"""Translation, amino-acid changes and population measures of haplotypes against a reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the standard genetic code, codons in the order TTT TTC TTA TTG TCT ... GGG
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def codon_table() -> dict[str, str]:
    return {a + b + c: CODE[16 * i + 4 * j + k] for i, a in enumerate("TCAG") for j, b in enumerate("TCAG") for k, c in enumerate("TCAG")}


def translate(seq: Column, frame: int = 0) -> Column:
    """Amino acids of whole codons from ``frame``; X for codons with other letters than A, C, G, T."""
    table = F.create_map(*(F.lit(x) for pair in codon_table().items() for x in pair))
    starts = F.sequence(F.lit(1 + frame), F.length(seq) - 2, F.lit(3))
    codons = F.when(F.length(seq) >= 3 + frame, F.transform(starts, lambda i: F.substring(F.upper(seq), i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
    return F.when(seq.isNotNull(), F.array_join(F.transform(codons, lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), ""))


def amino_changes(haps: DataFrame, key: list[str], seq: str, ref: str, frame: int = 0) -> DataFrame:
    """(key, pos, ref_aa, aa): changed amino acids of sequences whose length is the reference's, positions from 1."""
    rows = haps.where(F.length(seq) == F.length(ref)).select(*key, translate(F.col(seq), frame).alias("_a"), translate(F.col(ref), frame).alias("_r"))
    long = rows.where(F.length("_a") > 0).withColumn("pos", F.explode(F.sequence(F.lit(1), F.length("_a"))))
    changed = long.select(*key, "pos", F.substring("_r", F.col("pos"), F.lit(1)).alias("ref_aa"), F.substring("_a", F.col("pos"), F.lit(1)).alias("aa"))
    return changed.where("ref_aa != aa")


def typed(changes: DataFrame, key: list[str]) -> DataFrame:
    """(key, typed): all changes of a haplotype written as K76T-N86Y, in order of position."""
    parts = F.array_sort(F.collect_list(F.struct("pos", F.concat("ref_aa", F.col("pos").cast("string"), "aa").alias("t"))))
    return changes.groupBy(*key).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "-").alias("typed"))


def diversity(haps: DataFrame, by: list[str], count: str) -> DataFrame:
    """Per key: haplotypes, expected heterozygosity n/(n-1) * (1 - sum of squared shares), effective number of haplotypes."""
    total = haps.groupBy(*by).agg(F.sum(count).alias("_n"), F.count("*").alias("haplotypes"), F.sum(F.col(count) * F.col(count)).alias("_q"))
    homo = F.col("_q") / (F.col("_n") * F.col("_n"))
    he = F.try_divide(F.col("_n"), F.col("_n") - 1) * (1 - homo)
    return total.select(*by, "haplotypes", F.round(he, 6).alias("he"), F.round(1 / homo, 6).alias("effective"))
