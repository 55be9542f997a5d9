"""Replicates, samples, populations, groups: fractions, filters, ranks and reports.

Clusters come with the key columns sample, target, replicate and a sequence and count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise
from . import ranking


def replicate_fractions(clusters: DataFrame, sample: list[str], replicate: str, seq: str, count: str) -> DataFrame:
    """Per sample and sequence: avg_frac over all the sample's replicates (absent = 0), rep_cnt, reads.

    Fractions are of the replicate's total count; sequences are compared in upper case. Rows with a null
    replicate, sequence or count are left out, replicates with a total of 0 count as replicates with fraction 0.
    """
    rows = clusters.where(F.col(replicate).isNotNull() & F.col(seq).isNotNull() & F.col(count).isNotNull())
    per = rows.groupBy(*sample, replicate, F.upper(seq).alias("seq")).agg(F.sum(count).alias("cnt"))
    total = F.sum("cnt").over(Window.partitionBy(*sample, replicate))
    per = per.withColumn("_frac", F.when(total > 0, F.col("cnt") / total).otherwise(0.0))
    reps = per.groupBy(*sample).agg(F.count_distinct(replicate).alias("reps"))
    found = per.groupBy(*sample, "seq").agg(F.sum("_frac").alias("_f"), F.count_distinct(replicate).alias("rep_cnt"), F.sum("cnt").alias("reads"))
    return found.join(reps, sample).withColumn("avg_frac", F.col("_f") / F.col("reps")).drop("_f")


def prefilter(clusters: DataFrame, sample: list[str], replicate: str, count: str, *, sample_least: int = 250, cluster_least: int = 10) -> DataFrame:
    """Clusters of at least ``cluster_least`` reads whose sample and replicate both have at least ``sample_least`` reads."""
    rows = clusters.where(F.col(count) >= cluster_least)
    w1, w2 = Window.partitionBy(*sample), Window.partitionBy(*sample, replicate)
    marked = rows.withColumns({"_s": F.sum(count).over(w1), "_r": F.sum(count).over(w2)})
    return marked.where((F.col("_s") >= sample_least) & (F.col("_r") >= sample_least)).drop("_s", "_r")


def in_all_replicates(found: DataFrame, least: int | None = None) -> DataFrame:
    """Only haplotypes seen in ``least`` replicates (default: all that the sample has)."""
    return found.where(F.col("rep_cnt") >= (F.lit(least) if least else F.col("reps")))


def by_fraction(found: DataFrame, sample: list[str], least: float = 0.005, custom: DataFrame | None = None, cutoff: str = "cutoff") -> DataFrame:
    """Haplotypes at or above the sample's cut-off (``custom``: sample columns and a cutoff; else ``least``), fractions
    made to sum to 1 again among the rest."""
    rows = found.join(custom, sample, "left") if custom is not None else found.withColumn(cutoff, F.lit(None).cast("double"))
    kept = rows.where(F.col("avg_frac") >= F.coalesce(cutoff, F.lit(least))).drop(cutoff)
    return renormalise(kept, sample)


def renormalise(found: DataFrame, sample: list[str]) -> DataFrame:
    total = F.sum("avg_frac").over(Window.partitionBy(*sample))
    return found.withColumn("avg_frac", F.when(total > 0, F.col("avg_frac") / total).otherwise(0.0))


def rank_clusters(found: DataFrame, sample: list[str]) -> DataFrame:
    """Adds rank (0 the largest fraction; ties: the smaller sequence) and name, the sample joined with the zero-padded rank."""
    w = Window.partitionBy(*sample)
    rank = F.row_number().over(w.orderBy(F.desc("avg_frac"), "seq")) - 1
    width = F.length((F.count("*").over(w)).cast("string"))
    return found.withColumn("rank", rank).withColumn("name", F.concat_ws(".", *sample, F.lpad(rank.cast("string"), width, F.lit("0"))))


def one_off_pairs(found: DataFrame, sample: list[str], times: int = 10) -> DataFrame:
    """Haplotypes one edit away from another of the same sample that is more than ``times`` as frequent: (sample, seq, parent).

    Two sequences one edit apart share their first or their last half (of the shorter one), so candidates
    meet in an equi-join on a half, never all with all.
    """
    half = F.floor((F.length("seq")) / 2)
    def keyed(df: DataFrame, longer: tuple[int, ...]) -> DataFrame:
        keys = []
        for d in longer:
            h = F.floor((F.length("seq") + d) / 2)
            keys += [F.struct(F.lit("h").alias("side"), h.alias("n"), F.substring(F.col("seq"), F.lit(1), h).alias("part")), F.struct(F.lit("t").alias("side"), h.alias("n"), F.right(F.col("seq"), h).alias("part"))]
        return df.withColumn("_k", F.explode(F.array(*keys)))

    small = keyed(found.where(half > 0), (0,)).select(*sample, "_k", F.col("seq").alias("seq"), F.col("avg_frac").alias("frac"))
    large = keyed(found.where(half > 0), (-1, 0, 1)).select(*sample, "_k", F.col("seq").alias("parent"), F.col("avg_frac").alias("parent_frac"))
    met = small.join(large, [*sample, "_k"]).where((F.col("frac") * times < F.col("parent_frac")) & (F.abs(F.length("seq") - F.length("parent")) <= 1))
    return met.where(F.levenshtein("seq", "parent") == 1).select(*sample, "seq", "parent").distinct()


def population(found: DataFrame, sample: list[str], prefix: str, pool: list[str] | None = None) -> DataFrame:
    """Haplotypes over all samples, exact: samples that carry it, summed fraction, PopUID by rank.

    Rank: most samples, then the larger summed fraction (compared to 9 places), then the smaller sequence; ``pool`` ranks within keys.
    """
    pool = pool or []
    # every later step starts from these few columns, so the fractions behind them are worked out once
    found = materialise(found.select(*dict.fromkeys([*pool, *sample]), "seq", "avg_frac", "reads"), "fractions")
    haps = found.groupBy(*pool, "seq").agg(F.count_distinct(*sample).alias("h_sampcnt"), F.round(F.sum("avg_frac"), 9).alias("total_frac"), F.sum("reads").alias("reads"))
    all_samples = found.select(*dict.fromkeys([*pool, *sample])).distinct()
    n = all_samples.groupBy(*pool).agg(F.count("*").alias("n_samples")) if pool else all_samples.agg(F.count("*").alias("n_samples"))
    haps = haps.join(n, pool) if pool else haps.crossJoin(n)
    haps = materialise(haps, "haplotypes")
    counts = haps.groupBy(*pool).agg(F.count("*").alias("_k"))
    haps = ranking.number_within(haps, pool, [F.desc("h_sampcnt"), F.desc("total_frac"), "seq"], "_r")
    haps = haps.join(counts, pool) if pool else haps.crossJoin(counts)
    uid = F.concat(F.concat_ws("-", F.lit(prefix), *pool), F.lit("."), F.lpad(F.col("_r").cast("string"), F.length(F.col("_k").cast("string")), F.lit("0")))
    return haps.withColumn("h_popuid", uid).withColumn("h_sampfrac", F.round(F.col("h_sampcnt") / F.col("n_samples"), 6)).drop("_r", "_k")


def rescue(excluded: DataFrame, kept: DataFrame, by: list[str], seq: str, major: float = 0.5) -> DataFrame:
    """Excluded rows whose sequence is a major haplotype (fraction at least ``major``) of some sample that was kept."""
    return excluded.join(kept.where(F.col("avg_frac") >= major).select(*by, seq).distinct(), [*by, seq], "left_semi")


def coi_summary(info: DataFrame, pool: list[str], sample: str, hap: str) -> DataFrame:
    """Per pool: samples, haplotypes, and mean, median, least and greatest number of haplotypes per sample."""
    per = info.where(F.col(hap).isNotNull() & F.col(sample).isNotNull()).groupBy(*pool, sample).agg(F.count_distinct(hap).alias("coi"))
    haps = info.where(F.col(sample).isNotNull()).groupBy(*pool).agg(F.count_distinct(hap).alias("haplotypes"))
    out = per.groupBy(*pool).agg(
        F.count("*").alias("samples"), F.round(F.avg("coi"), 6).alias("mean_coi"), F.median("coi").alias("median_coi"), F.min("coi").alias("min_coi"), F.max("coi").alias("max_coi")
    )
    return out.join(haps, pool)


def group_report(rows: DataFrame, group: str, sample: str, hap: str) -> DataFrame:
    """Per group: samples, haplotypes, haplotypes found in no other group."""
    rows = rows.where(F.col(group).isNotNull() & F.col(hap).isNotNull())
    per = rows.groupBy(hap).agg(F.count_distinct(group).alias("_groups"), F.min(group).alias(group))
    only = per.where("_groups = 1").groupBy(group).agg(F.count("*").alias("only_here"))
    base = rows.groupBy(group).agg(F.count_distinct(sample).alias("samples"), F.count_distinct(hap).alias("haplotypes"))
    return base.join(only, group, "left").withColumn("only_here", F.coalesce("only_here", F.lit(0)))


def joined_names(rows: DataFrame, seq: str, name: str, sep: str = ":") -> DataFrame:
    """Identical sequences as one row with their distinct names joined in sorted order."""
    return rows.groupBy(seq).agg(F.array_join(F.array_sort(F.collect_set(name)), sep).alias("names"), F.count("*").alias("n"))


def wide_runs(rows: DataFrame, by: list[str], value: str, most: int | None = None) -> DataFrame:
    """Each key's sorted distinct values as columns run1 .. run<most>, null where there are fewer; by default as wide as the longest list."""
    lists = rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_set(value)).alias("_v"))
    if most is None:
        most = lists.agg(F.max(F.size("_v"))).first()[0] or 0
    return lists.select(*by, *(F.get("_v", F.lit(i)).alias(f"run{i + 1}") for i in range(most)), F.size("_v").alias("runs"))


def two_hop(rows: DataFrame, key: str, first: DataFrame, second: DataFrame, *, fill: str = "") -> DataFrame:
    """``rows`` with ``uid`` and ``typed``: key -> uid by ``first`` (key, uid), uid -> typed by ``second`` (uid, typed); ``fill`` where a hop leads nowhere.

    Of several entries for one key the smallest counts; null keys lead nowhere. No row is lost or doubled.
    """
    one = first.where("key is not null").groupBy(F.col("key").alias("_k")).agg(F.min("uid").alias("uid"))
    two = second.where("uid is not null").groupBy(F.col("uid").alias("_u")).agg(F.min("typed").alias("typed"))
    met = rows.join(one, F.col(key) == F.col("_k"), "left").join(two, F.col("uid") == F.col("_u"), "left").drop("_k", "_u")
    return met.withColumns({"uid": F.coalesce("uid", F.lit(fill)), "typed": F.coalesce("typed", F.lit(fill))})
