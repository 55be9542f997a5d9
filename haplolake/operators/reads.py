"""Row filters, classification cascades, dereplication and consensus over reads.

Common rules: null sequences and qualities never crash an operator; what they mean is said at each.
Columns are addressed by name, other columns pass through where rows are kept and are never read where they aren't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, quality
from ..functions import sequence as sq


def remove_low_quality(df: DataFrame, seq: str, qual: str, cutoff: int) -> DataFrame:
    """Drop every base below ``cutoff`` from sequence and qualities; rows whose lengths disagree stay as they are."""
    pairs = F.filter(F.arrays_zip(sq.bases(F.col(seq)).alias("b"), F.col(qual).alias("q")), lambda x: x["q"] >= cutoff)
    fits = F.length(seq) == F.size(qual)
    return df.withColumns(
        {
            seq: F.when(fits, F.array_join(F.transform(pairs, lambda x: x["b"]), "")).otherwise(F.col(seq)),
            qual: F.when(fits, F.transform(pairs, lambda x: x["q"])).otherwise(F.col(qual)),
        }
    )


def trim_first_bad(df: DataFrame, seq: str, qual: str, cutoff: int = 2) -> DataFrame:
    """Adds trimmed_len (bases before the first one of quality ``cutoff`` or less) and starts_bad (none is left)."""
    at = quality.first_at_most(F.col(qual), cutoff)
    kept = F.when(at > 0, at - 1).otherwise(F.length(seq))
    return df.withColumn("trimmed_len", F.least(kept, F.length(seq))).withColumn("starts_bad", F.coalesce(F.col("trimmed_len") == 0, F.lit(False)))


def cascade(tests: list[tuple[str, Column]], good: str = "GOOD") -> Column:
    """The name of the first test that is true, else ``good``; a null test counts as not failed."""
    out = F
    for name, failed in tests:
        out = out.when(failed, name)
    return out.otherwise(good)


def single_end_case(seq: str, qual: str, minlen: Column, maxlen: Column, *, n_limit: int = 1, check: int = 30, percent: int = 90, bad_reverse: Column | None = None, contaminated: Column | None = None) -> Column:
    """First failure of a single-end read: reverse primer and contamination (where given), length below the least, Ns, length above the most, quality, else GOOD."""
    length = F.length(seq)
    first = [(name, failed) for name, failed in (("BADREVERSE", bad_reverse), ("CONTAMINATION", contaminated)) if failed is not None]
    return cascade(
        first
        + [
            ("MINLENBAD", length < minlen),
            ("CONTAINSNS", sq.count_base(F.col(seq), "N") >= n_limit),
            ("MAXLENBAD", length > maxlen),
            ("QUALITYFAILED", ~quality.fraction_ok(F.col(qual), check, percent)),
        ]
    )


def paired_case(seq: str, qual: str, minlen: Column, maxlen: Column, *, stitched: bool = True, n_limit: int = 1, check: int = 30, percent: int = 90) -> Column:
    """First failure of a pair: Ns, quality, then (only if stitched) least and greatest length."""
    tests = [("CONTAINSNS", sq.count_base(F.col(seq), "N") >= n_limit), ("QUALITYFAILED", ~quality.fraction_ok(F.col(qual), check, percent))]
    if stitched:
        tests += [("MINLENBAD", F.length(seq) < minlen), ("MAXLENBAD", F.length(seq) > maxlen)]
    return cascade(tests)


CASES = ["GOOD", "MINLENBAD", "CONTAINSNS", "MAXLENBAD", "QUALITYFAILED"]


def case_counts(df: DataFrame, by: list[str], case: str = "case", cases: list[str] | None = None) -> DataFrame:
    """One row per key with a count for each case (fixed list, so no pass to discover pivot values) and the total."""
    counts = [F.count_if(F.col(case) == c).alias(c.lower()) for c in cases or CASES]
    return df.groupBy(*by).agg(*counts, F.count("*").alias("total"))


def length_cutoffs(df: DataFrame, by: list[str], seq: str, percent: int = 20) -> DataFrame:
    """Median length per key, and the lengths that lie ``percent`` of 100 below and above it (towards the median)."""
    med = F.median(F.length(seq))
    step = F.floor(med * percent / 100)
    return df.where(F.col(seq).isNotNull()).groupBy(*by).agg(med.alias("median_len"), F.greatest(F.floor(med) - step, F.lit(0)).alias("minlen"), (F.floor(med) + step).alias("maxlen"))


def dereplicate(df: DataFrame, by: list[str], seq: str, count: str, ident: str) -> DataFrame:
    """Identical sequences of a key (letter case aside) as one row: reads, summed count, smallest id.

    Hash aggregation with partial sums, so a sequence that makes up a third of all rows costs one row per task
    in the shuffle. Null sequences are left out; a null count adds nothing.
    """
    rows = df.where(F.col(seq).isNotNull()).withColumn("_seq", F.upper(seq))
    found = rows.groupBy(*by, "_seq").agg(F.count("*").alias("reads"), F.coalesce(F.sum(count), F.lit(0.0)).alias("cnt"), F.min(ident).alias("first_id"))
    return found.withColumnRenamed("_seq", "seq")


# fixed values: ways to make a consensus quality
CONSENSUS = {"median": F.median, "average": F.avg, "worst": F.min, "bestQual": F.max}


def quality_consensus(df: DataFrame, by: list[str], qual: str, how: str = "median", low: int = 0, high: int = 60) -> DataFrame:
    """Per key and position one consensus quality (median, average, worst or bestQual) over values in [low, high]."""
    if how not in CONSENSUS:
        raise ValueError(f"{how} is none of {', '.join(CONSENSUS)}")
    long = df.select(*by, F.posexplode(qual).alias("pos", "q")).where(F.col("q").between(low, high))
    return long.groupBy(*by, "pos").agg(CONSENSUS[how]("q").cast("double").alias("q"), F.count("*").alias("n"))


def number_repeated_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """Adds unique_name: a name that comes again gets .1, .2 ... in the given order, its first occurrence stays."""
    nth = F.row_number().over(Window.partitionBy(name).orderBy(order)) - 1
    return df.withColumn("unique_name", F.when(nth > 0, F.concat_ws(".", name, nth.cast("string"))).otherwise(F.col(name)))


def keep_modal_sample_number(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Only rows with their key's commonest sample number (ties: the greater text; undecodable names share '')."""
    rows = df.withColumn("sample_number", names.sample_number(F.col(name)))
    counts = rows.groupBy(*by, "sample_number").agg(F.count("*").alias("_n"))
    modal = counts.groupBy(*by).agg(F.max_by("sample_number", F.struct("_n", "sample_number")).alias("sample_number"))
    return rows.join(modal, [*by, "sample_number"], "left_semi")


def hash_order(ident: str) -> Column:
    """A fixed pseudo-random order of integer ids that any SQL engine can repeat."""
    return (F.col(ident) * 2654435761 + 40503) % 4294967296


def downsample(df: DataFrame, by: list[str], ident: str, most: int) -> DataFrame:
    """At most ``most`` rows per key, picked by hash order: repeatable, and pre-limited per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(hash_order(ident), ident))
    return df.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def one_direction_clusters(df: DataFrame, cluster: list[str], name: str, marker: str, percent: int = 98) -> DataFrame:
    """Clusters with the share of reads whose name carries ``marker``; dropped = share above the limit and more than one read."""
    found = df.groupBy(*cluster).agg(F.count_if(F.col(name).contains(marker)).alias("marked"), F.count("*").alias("reads"))
    return found.withColumn("dropped", (F.col("marked") * 100 > F.col("reads") * percent) & (F.col("reads") > 1))


def top_starts(df: DataFrame, seq: str, bases: int = 20, k: int = 10) -> DataFrame:
    """The k commonest read starts (ties: the smaller text); rows shorter than ``bases`` count with what they have."""
    starts = df.where(F.col(seq).isNotNull()).groupBy(F.substring(F.upper(seq), 1, bases).alias("start")).agg(F.count("*").alias("n"))
    return starts.orderBy(F.desc("n"), "start").limit(k)


def kmer_spectrum(df: DataFrame, by: list[str], seq: str, k: int = 5, low: int = 1) -> DataFrame:
    """Per key and k-mer the number of sequences that have it, and whether that is ``low`` or fewer."""
    rows = df.select(*by, F.explode(F.array_distinct(sq.kmers(F.upper(seq), k))).alias("kmer"))
    return rows.groupBy(*by, "kmer").agg(F.count("*").alias("n")).withColumn("is_low", F.col("n") <= low)


def is_small(seq: str, least: int = 50) -> Column:
    """Whether a sequence is shorter than ``least``; null without a sequence. Small reads of a k-mer step: ``least=max(2 * k, k) + 1``."""
    return F.length(seq) < least


def trim_to_longest(df: DataFrame, seq: str, longest: Column) -> DataFrame:
    """Sequences cut at ``longest`` bases; uncut where that is null."""
    return df.withColumn(seq, F.when(longest.isNull(), F.col(seq)).otherwise(F.substring(F.col(seq), F.lit(1), longest)))


def mark_small_bins(df: DataFrame, by: list[str], most: int = 5) -> DataFrame:
    """Adds small_bin: whether a row's key has ``most`` rows or fewer. Keys are counted by partial sums, null keys are keys of their own."""
    counts = df.groupBy(*by).agg(F.count("*").alias("_n"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    return df.alias("l").join(counts.alias("r"), same).select("l.*", (F.col("_n") <= most).alias("small_bin"))


def exclude_named(df: DataFrame, column: str, names_: list[str]) -> DataFrame:
    """Rows whose ``column`` is none of the names; rows with null stay."""
    return df.where(F.col(column).isNull() | ~F.col(column).isin(names_)) if names_ else df


def outcome_counts(df: DataFrame, by: list[str], status: str, statuses: list[str]) -> DataFrame:
    """One row per key with 'n(p%)' of its rows for every status of the list, and the total; other statuses count in the total only."""
    counts = df.groupBy(*by).agg(F.count("*").alias("total"), *(F.count_if(F.col(status) == s).alias(s.lower()) for s in statuses))
    return counts.select(*by, "total", *(names.percent(F.col(s.lower()), F.col("total")).alias(s.lower()) for s in statuses))


def sorted_counts(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows per key, the commonest first, ties by key in ascending order."""
    return df.groupBy(*by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *by)


def trim_mates(df: DataFrame, first: tuple[str, str], second: tuple[str, str], n1: int = 1, n2: int = 1, *, mate_rc: bool = False) -> DataFrame:
    """Mates without the last ``n1`` and ``n2`` bases and qualities; of a mate that was turned round already the first ``n2`` go.

    Mates no longer than what goes become empty; null sequences and qualities stay null.
    """
    cut = {}
    for (s, q), n, front in ((first, n1, False), (second, n2, mate_rc)):
        length, size = F.greatest(F.length(s) - n, F.lit(0)), F.greatest(F.size(q) - n, F.lit(0))
        start = F.lit(n + 1 if front else 1)
        cut[s] = F.substring(F.col(s), start, length)
        cut[q] = F.when(F.col(q).isNotNull(), F.slice(F.col(q), start, size))
    return df.withColumns(cut)
