"""Candidate barcodes of unknown runs: what stands before a primer, collapsed by similarity and abundance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse_candidates(rows: pd.DataFrame, strong: tuple[float, int] = (0.1, 1), weak: tuple[float, int] = (0.001, 3), least: int = 5) -> pd.DataFrame:
    """Rows (barcode, n) -> those that stay, with the counts of what they took in.

    Largest first; a smaller one of the same length goes into the first larger one from which it differs in at most one
    position with less than a tenth of its count, or in at most three with less than a thousandth. Only totals above ``least`` stay.
    """
    kept: list[list] = []
    for code, n in sorted(zip(rows["barcode"], rows["n"], strict=True), key=lambda x: (-x[1], x[0])):
        for other in kept:
            if len(other[0]) != len(code):
                continue
            differ = sum(a != b for a, b in zip(other[0], code, strict=True))
            if any(differ <= most and n < share * other[1] for share, most in (strong, weak)):
                other[2] += n
                break
        else:
            kept.append([code, n, n])
    return pd.DataFrame([(c, t) for c, _, t in kept if t > least], columns=["barcode", "n"])


def candidates(preceding: DataFrame, by: str, barcode: str, **options) -> DataFrame:  # noqa: ANN003
    """(by, barcode, n) of ``collapse_candidates`` for every key; a key's distinct candidates are few against its reads."""
    counts = preceding.where(F.length(barcode) > 0).groupBy(F.col(by).alias("_k"), F.col(barcode).alias("barcode")).agg(F.count("*").alias("n"))
    kind = dict(preceding.dtypes)[by]

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = collapse_candidates(rows, **options)
        found.insert(0, "_k", key[0])
        return found

    return counts.groupBy("_k").applyInPandas(run, f"_k {kind}, barcode string, n long").withColumnRenamed("_k", by)
