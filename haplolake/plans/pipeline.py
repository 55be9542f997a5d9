"""The dataflow from read pairs to population tables as one lazy plan, from one configuration."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import collapse, matching, reads, samples, stitch


@dataclass(frozen=True)
class Config:
    """Parameters of a run; the values are checked when it is made."""

    barcode_errors: int = 1
    primer_errors: int = 2
    primer_within: int = 10
    contamination_k: int = 5
    contamination_halves: int = 1
    quality: int = 30
    quality_percent: int = 90
    min_overlap: int = 10
    stitch_error: float = 0.01
    least_fraction: float = 0.005
    rounds: tuple[collapse.Round, ...] = field(default_factory=lambda: (collapse.Round(100, 3, hq=1, indel1=1), collapse.Round(100, 0, hq=1, indel1=1)))
    population: str = "pop"

    def __post_init__(self) -> None:
        if self.barcode_errors < 0 or self.primer_errors < 0 or not 0 <= self.stitch_error < 1 or not 0 <= self.least_fraction < 1 or "." in self.population:
            raise ValueError("errors can't be negative, fractions lie in [0, 1), and a population's name has no '.'")


class Pipeline:
    """Each step is a DataFrame of the one before; nothing runs until a result is read or written."""

    def __init__(self, config: Config, targets: DataFrame, *, barcodes: DataFrame | None = None, references: DataFrame | None = None):
        """``targets`` may have rev_primer, ``barcodes`` is (mid, barcode), ``references`` (target_name, ref); a step whose table or column is missing is left out."""
        self.config, self.targets, self.barcodes, self.references = config, targets, barcodes, references

    def stitched(self, pairs: DataFrame, keep: list[str]) -> DataFrame:
        """Pairs (r1, q1, r2, q2) -> stitched reads; pairs without an overlap keep status NOOVERLAP and no sequence."""
        return stitch.stitch(pairs, keep, "r1", "q1", "r2", "q2", min_overlap=self.config.min_overlap, error=self.config.stitch_error)

    def demultiplexed(self, rows: DataFrame, read_id: str, seq: str, qual: str) -> DataFrame:
        """Adds mid and outcome; reads with one best barcode lose it and what is before it."""
        if self.barcodes is None:
            raise ValueError("no barcodes were given")
        found = matching.demultiplex(rows, read_id, seq, self.barcodes, "mid", "barcode", errors=self.config.barcode_errors)
        widths = self.barcodes.select("mid", F.length("barcode").alias("_width"))
        met = rows.join(found.select(read_id, "mid", "outcome", "offset"), read_id).join(widths, "mid", "left").withColumn("_cut", F.coalesce(F.col("offset") + F.col("_width"), F.lit(0)))
        kept = {seq: F.substring(seq, F.col("_cut") + 1, F.length(seq)), qual: F.slice(qual, F.col("_cut") + 1, F.greatest(F.size(qual), F.lit(0)))}
        return met.withColumns(kept).drop("_cut", "_width", "offset")

    def classified(self, rows: DataFrame, read_id: str, seq: str, qual: str) -> DataFrame:
        """Reads with their barcode, their target by forward primer and the first test that they fail, from the barcode on.

        Reads of a target without any reference aren't screened for contamination.
        """
        c = self.config
        rows = rows if self.barcodes is None else self.demultiplexed(rows, read_id, seq, qual)
        match = {"errors": c.primer_errors, "within": c.primer_within}
        found = matching.match_primers(rows, read_id, seq, self.targets, "target_name", "fwd_primer", **match)
        limits = self.targets.select(F.col("target_name").alias("matched"), "minlen", "maxlen")
        met = rows.join(found.select(read_id, "matched"), read_id).join(limits, "matched", "left")
        bad_reverse = contaminated = None
        if "rev_primer" in self.targets.columns:
            back = matching.match_primers(rows, read_id, seq, self.targets, "target_name", "rev_primer", reverse=True, **match)
            met = met.join(back.select(read_id, F.col("matched").alias("_reverse")), read_id)
            bad_reverse = F.col("_reverse") != F.col("matched")
        if self.references is not None:
            refs = self.references.where("ref is not null").select(F.col("target_name").alias("matched"), "ref")
            like = matching.kmer_screen(met, read_id, seq, refs, "ref", ["matched"], k=c.contamination_k, halves=c.contamination_halves)
            met = met.join(like.select(read_id, F.lit(True).alias("_like")), read_id, "left")
            met = met.join(refs.select("matched", F.lit(True).alias("_screened")).distinct(), "matched", "left")
            contaminated = F.col("_screened") & F.col("_like").isNull()
        case = reads.single_end_case(seq, qual, F.col("minlen"), F.col("maxlen"), check=c.quality, percent=c.quality_percent, bad_reverse=bad_reverse, contaminated=contaminated)
        case = F.when(F.col("matched") == "unrecognized", "UNRECOGNIZED").otherwise(case)
        if self.barcodes is not None:
            case = F.when(F.col("outcome") != "MATCH", F.col("outcome")).otherwise(case)
        return met.withColumn("case", case).drop("_reverse", "_like", "_screened")

    def clustered(self, good: DataFrame, by: list[str], seq: str, count: str) -> DataFrame:
        """Good reads -> clusters of each key, dereplicated and collapsed: (by, seq, cnt)."""
        found = collapse.collapse(good, by, seq, count, list(self.config.rounds))
        return found.groupBy(*by, F.col("into").alias("seq")).agg(F.sum("cnt").alias("cnt"))

    def without_chimeras(self, clusters: DataFrame, by: list[str]) -> DataFrame:
        """Clusters that aren't made of two more abundant ones of their key."""
        return clusters.join(collapse.chimeras(clusters, by), [*by, "seq"], "left_anti")

    def population(self, clusters: DataFrame, target: str, sample: str, replicate: str) -> DataFrame:
        """Clusters of replicates, without chimeras -> haplotypes of every sample, filtered -> population table."""
        key = [target, sample]
        clusters = self.without_chimeras(clusters, [*key, replicate])
        haps = samples.in_all_replicates(samples.replicate_fractions(clusters, key, replicate, "seq", "cnt"))
        return samples.population(samples.by_fraction(haps, key, self.config.least_fraction), [sample], self.config.population, [target])
