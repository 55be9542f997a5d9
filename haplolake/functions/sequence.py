"""Columns over sequences. Null in, null out, unless a docstring says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: IUPAC nucleotide codes
IUPAC = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
_FROM, _TO = "ACGTRYSWKMBDHVNacgtryswkmbdhvn", "TGCAYRSWMKVHDBNtgcayrswmkvhdbn"


def revcomp(seq: Column) -> Column:
    """Reverse complement, IUPAC codes and case kept."""
    return F.translate(F.reverse(seq), _FROM, _TO)


def bases(seq: Column) -> Column:
    """The sequence as an array of one-letter strings; an empty sequence gives an empty array."""
    return F.filter(F.split(seq, ""), lambda c: c != "")


def remove_lower(seq: Column) -> Column:
    """Without its lower-case (masked) bases."""
    return F.regexp_replace(seq, "[a-z]", "")


def keep_upper_qualities(seq: Column, qual: Column) -> Column:
    """The qualities of upper-case bases; null where the array's length isn't the sequence's."""
    kept = F.filter(F.arrays_zip(bases(seq).alias("b"), qual.alias("q")), lambda x: x["b"].rlike("[A-Z]"))
    return F.when(F.length(seq) == F.size(qual), F.transform(kept, lambda x: x["q"]))


def count_base(seq: Column, base: str) -> Column:
    """Occurrences of one base, either case."""
    return F.length(seq) - F.length(F.translate(seq, base.upper() + base.lower(), ""))


def remove_gaps(seq: Column) -> Column:
    return F.translate(seq, "-", "")


def kmers(seq: Column, k: int) -> Column:
    """All k-mers in order; an empty array for shorter sequences."""
    starts = F.sequence(F.lit(1), F.length(seq) - F.lit(k - 1))
    return F.when(F.length(seq) >= k, F.transform(starts, lambda i: F.substring(seq, i, F.lit(k)))).otherwise(F.when(seq.isNotNull(), F.array().cast("array<string>")))


def hamming(a: Column, b: Column) -> Column:
    """Differing positions of two sequences of one length; null for different lengths."""
    differ = F.zip_with(bases(a), bases(b), lambda x, y: F.when(x == y, 0).otherwise(1))
    return F.when(F.length(a) == F.length(b), F.aggregate(differ, F.lit(0), lambda s, x: s + x))


def motif_errors(window: Column, motif: str) -> Column:
    """Mismatches of a window against an IUPAC motif of the same length, as one sum of literals: no arrays."""
    parts = [F.when(F.substring(window, i + 1, 1).isin(*IUPAC.get(c, c)), 0).otherwise(1) for i, c in enumerate(motif.upper())]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def motif_regex(motif: str) -> str:
    """A regular expression for an IUPAC motif."""
    return "".join(c if len(IUPAC.get(c, c)) == 1 else f"[{IUPAC[c]}]" for c in motif.upper())


def expand_motif(motif: str, limit: int = 4096) -> list[str]:
    """All plain sequences of an IUPAC motif, in order; an error where there are more than ``limit``."""
    out = [""]
    for c in motif.upper():
        out = [p + x for p in out for x in IUPAC.get(c, c)]
        if len(out) > limit:
            raise ValueError(f"{motif} stands for more than {limit} sequences")
    return out


def trim_ends(seq: Column, front: int, back: int) -> Column:
    """Without ``front`` bases at the start and ``back`` at the end; empty if nothing is left."""
    return F.substring(seq, F.lit(front + 1), F.greatest(F.length(seq) - F.lit(front + back), F.lit(0)))


def trim_at(seq: Column, motif: str, within: int = 100, include: bool = False) -> Column:
    """Cut at the last occurrence of ``motif`` inside the last ``within`` bases; unchanged where there is none."""
    tail_start = F.greatest(F.length(seq) - F.lit(within), F.lit(0))
    tail = F.substring(seq, tail_start + 1, F.length(seq))
    back = F.locate(motif[::-1], F.reverse(tail))
    keep = F.length(seq) - back + 1 - (F.lit(0) if include else F.lit(len(motif)))
    return F.when(back > 0, F.substring(seq, F.lit(1), keep)).otherwise(seq)


def homopolymer_runs(seq: Column) -> Column:
    """Each run of equal bases as one string."""
    return F.regexp_extract_all(seq, F.lit(r"((.)\2*)"), F.lit(1))
