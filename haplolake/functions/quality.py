"""Columns over per-base quality arrays (Phred values)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def decode(text: Column, offset: int = 33) -> Column:
    """Phred values of a quality string."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: (F.ascii(c) - offset).cast("smallint"))


def encode(qual: Column, offset: int = 33) -> Column:
    """Quality string of Phred values; values are held within the printable range."""
    held = F.transform(qual, lambda q: F.char(F.least(F.greatest(q.cast("int"), F.lit(0)), F.lit(93)) + offset))
    return F.array_join(held, "")


def mean_error(qual: Column) -> Column:
    """Average error probability; null without qualities."""
    total = F.aggregate(qual, F.lit(0.0), lambda s, q: s + F.pow(F.lit(10.0), -q.cast("double") / 10))
    return F.when(F.size(qual) > 0, total / F.size(qual))


def count_at_least(qual: Column, cutoff: int) -> Column:
    return F.size(F.filter(qual, lambda q: q >= cutoff))


def fraction_ok(qual: Column, cutoff: int = 30, percent: int = 90) -> Column:
    """At least ``percent`` of 100 bases have the quality ``cutoff``; false without qualities. Compared as integers."""
    return F.coalesce((F.size(qual) > 0) & (count_at_least(qual, cutoff) * 100 >= F.size(qual) * percent), F.lit(False))


def first_at_most(qual: Column, cutoff: int = 2) -> Column:
    """Position (from 1) of the first base of quality ``cutoff`` or less, 0 if there is none."""
    return F.coalesce(F.array_position(F.transform(qual, lambda q: q <= cutoff), True), F.lit(0))


def _sum(qual: Column, start: Column, width: int) -> Column:
    return F.aggregate(F.slice(qual, start, F.lit(width)), F.lit(0), lambda s, q: s + F.coalesce(q.cast("int"), F.lit(0)))


def failing_windows(qual: Column, width: int, step: int, mean: int) -> Column:
    """Starts (from 1) of the windows whose mean is below ``mean``; empty where no window fits."""
    last = F.size(qual) - F.lit(width - 1)
    starts = F.sequence(F.lit(1), F.greatest(last, F.lit(1)), F.lit(step))
    return F.when(last >= 1, F.filter(starts, lambda i: _sum(qual, i, width) < width * mean)).otherwise(F.array().cast("array<int>"))


def windows_ok(qual: Column, width: int = 50, step: int = 5, mean: int = 25) -> Column:
    """No window's mean is below ``mean``; true where no window fits."""
    return F.size(failing_windows(qual, width, step, mean)) == 0


def window_trim_length(qual: Column, width: int = 50, step: int = 5, mean: int = 25) -> Column:
    """Bases before the first failing window; all of them where none fails."""
    bad = failing_windows(qual, width, step, mean)
    return F.when(F.size(bad) > 0, F.element_at(bad, 1) - 1).otherwise(F.size(qual))


def flatten_runs(seq: Column, qual: Column) -> Column:
    """Each homopolymer run's qualities replaced by the run's mean (rounded); null where lengths differ."""
    from .sequence import homopolymer_runs

    lengths = F.transform(homopolymer_runs(seq), lambda r: F.length(r))
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("out"))

    def add(state: Column, n: Column) -> Column:
        part = F.slice(qual, state["at"], n)
        mean = F.round(F.aggregate(part, F.lit(0.0), lambda s, q: s + q) / n).cast("int")
        return F.struct((state["at"] + n).alias("at"), F.concat(state["out"], F.array_repeat(mean, n)).alias("out"))

    return F.when(F.length(seq) == F.size(qual), F.aggregate(lengths, start, add, lambda s: s["out"]))
