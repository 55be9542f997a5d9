"""Control mixtures: expected against observed haplotypes, recovery, false haplotypes, error of fractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def normalise(mixtures: DataFrame, mix: str, strain: str, amount: str) -> DataFrame:
    """Adds relative = amount / sum of the mixture. Zero amounts are dropped; a negative amount, a strain named
    twice in one mixture, or a mixture of zeros only raises an error when the result is read."""
    w = Window.partitionBy(mix)
    total, twice = F.sum(amount).over(w), F.count("*").over(Window.partitionBy(mix, strain))
    checked = mixtures.withColumn("_total", total).withColumn("_twice", twice)
    bad = (
        F.when(F.col(amount) < 0, F.raise_error(F.concat(F.lit("negative amount in mixture "), F.col(mix))).cast("double"))
        .when(F.col("_twice") > 1, F.raise_error(F.concat(F.lit("strain named twice in mixture "), F.col(mix))).cast("double"))
        .when(F.col("_total") <= 0, F.raise_error(F.concat(F.lit("only zeros in mixture "), F.col(mix))).cast("double"))
    )
    return checked.withColumn("relative", F.coalesce(bad, F.col(amount) / F.col("_total"))).where(F.col("relative") > 0).drop("_total", "_twice")


def without_strains(mixtures: DataFrame, mix: str, strain: str, amount: str, removed: DataFrame) -> DataFrame:
    """Mixtures without the strains listed, relative amounts made to sum to 1 again."""
    return normalise(mixtures.join(removed.select(strain).distinct(), strain, "left_anti"), mix, strain, amount)


def merge_identical(expected: DataFrame, by: list[str], seq: str, name: str, fraction: str) -> DataFrame:
    """Expected haplotypes of one sequence as one: names joined by commas in order, fractions summed."""
    return expected.groupBy(*by, seq).agg(F.array_join(F.array_sort(F.collect_set(name)), ",").alias(name), F.sum(fraction).alias(fraction))


def classed(rows: DataFrame, by: list[str], fraction: str) -> DataFrame:
    """Adds class: major where the fraction is the sample's largest, else minor."""
    return rows.withColumn("class", F.when(F.col(fraction) == F.max(fraction).over(Window.partitionBy(*by)), "major").otherwise("minor"))


def compare(observed: DataFrame, expected: DataFrame, sample: list[str], hap: str) -> DataFrame:
    """Full outer match of observed (sample, hap, obs_frac) and expected (sample, hap, exp_frac): column ``state`` is
    recovered, false (only observed) or missing (only expected)."""
    both = observed.select(*sample, hap, "obs_frac").join(expected.select(*sample, hap, "exp_frac"), [*sample, hap], "full")
    state = F.when(F.col("exp_frac").isNull(), "false").when(F.col("obs_frac").isNull(), "missing").otherwise("recovered")
    return both.withColumn("state", state)


def metrics(compared: DataFrame, sample: list[str]) -> DataFrame:
    """Per sample: recovered, false_haps, missing, total, expected, recovery_rate, false_rate, rmse (over recovered; null without any)."""
    is_ = lambda s: F.count_if(F.col("state") == s)
    error = F.sum(F.when(F.col("state") == "recovered", F.pow(F.col("obs_frac") - F.col("exp_frac"), 2)))
    out = compared.groupBy(*sample).agg(is_("recovered").alias("recovered"), is_("false").alias("false_haps"), is_("missing").alias("missing"), error.alias("_e"))
    return out.select(
        *sample, "recovered", "false_haps", "missing", (F.col("recovered") + F.col("false_haps")).alias("total"), (F.col("recovered") + F.col("missing")).alias("expected"),
        F.round(F.try_divide("recovered", F.col("recovered") + F.col("missing")), 6).alias("recovery_rate"),
        F.round(F.try_divide("false_haps", F.col("recovered") + F.col("false_haps")), 6).alias("false_rate"),
        F.round(F.sqrt(F.try_divide("_e", "recovered")), 6).alias("rmse"),
    )


def fill_missing_samples(rows: DataFrame, samples: DataFrame, sample: list[str], zeros: list[str]) -> DataFrame:
    """A row for every sample; those without one get zeros in the columns named."""
    return samples.select(*sample).distinct().join(rows, sample, "left").fillna(0, zeros)


def unknown_references(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of ``rows`` that ``known`` doesn't have: what a foreign-key check reports."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key).distinct(), key, "left_anti")


def best_flag(rows: DataFrame, by: list[str], score: str) -> DataFrame:
    """Adds best: whether the row's score is its key's largest (ties are all best)."""
    return rows.withColumn("best", F.col(score) == F.max(score).over(Window.partitionBy(*by)))
