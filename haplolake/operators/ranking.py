"""Dense numbers for the rows of a distributed order, without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise


def number_rows(df: DataFrame, order: list[Column | str], name: str = "id") -> DataFrame:
    """``df`` with ``name``: 0, 1, 2 ... in the given order.

    Rows are range-partitioned by the order and sorted within partitions; a row's number is its place there plus
    the sizes of the partitions before, one number per partition. Ties are numbered in any order, so the
    order should name a row fully. The table is written once, so numbers don't change between reads.
    """
    placed = materialise(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    before, offsets = 0, []
    for row in sorted(placed.groupBy(part.alias("part")).agg(F.count("*").alias("size")).collect()):
        offsets.append((row["part"], before))
        before += row["size"]
    starts = df.sparkSession.createDataFrame(offsets, "_part long, _before long")
    joined = placed.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit(2**33 - 1))).drop("_part", "_before", "_at")


def number_within(df: DataFrame, by: list[str], order: list[Column | str], name: str = "rank") -> DataFrame:
    """Numbers from 0 within every key, in the given order; null keys are a key of their own. A key of any size is spread over tasks."""
    numbered = number_rows(df, [*by, *order], name)
    if not by:
        return numbered
    firsts = numbered.groupBy(*by).agg(F.min(name).alias("_first"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in by]
    return numbered.alias("l").join(firsts.alias("r"), same).select("l.*", "_first").withColumn(name, F.col(name) - F.col("_first")).drop("_first")
