"""Top N items of every group by simultaneous bisection.

Every group's cutoff is refined at once: a batch holds (group, code) with an order-preserving
integer code, and each round counts, for all groups together, the rows above the group's
midpoint. Scores are 64-bit codes (IEEE bits, order-preserving); rows on the cutoff score are
told apart by a second bisection over the identifiers' ranks.

The same kernel serves three levels: over input batches (a row that N others of its own batch
beat can't be among the N best of all, so it never reaches the shuffle), over salted parts of
a group, and over the group. What a hot group sends on is N rows per task, never its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: rows gathered before a bisection runs
BLOCK_ROWS = 200_000
#: salted parts that a group's candidates are first brought to
SALTS = 16


def score_codes(scores: np.ndarray) -> np.ndarray:
    """uint64 codes in the order of the doubles (-0.0 and 0.0 alike; NaN must not occur)."""
    bits = (scores + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def bisect_cutoffs(group: np.ndarray, code: np.ndarray, groups: int, want: np.ndarray) -> np.ndarray:
    """Per group the largest cutoff c for which at least ``want`` rows have code >= c; 0 where fewer rows exist.

    One midpoint per group and round; a row whose side is settled leaves the working set.
    """
    low = np.zeros(groups, np.uint64)
    high = np.full(groups, np.iinfo(np.uint64).max, np.uint64)
    above = np.zeros(groups, np.int64)  # rows known to lie above high
    while group.size and (low < high).any():
        mid = low + (high - low) // np.uint64(2) + ((high - low) & np.uint64(1))
        up = code >= mid[group]
        count = np.bincount(group[up], minlength=groups) + above
        enough = count >= want
        undecided = low < high
        low = np.where(undecided & enough, mid, low)
        below = undecided & ~enough
        above = np.where(below, count, above)
        high = np.where(below, mid - np.uint64(1), high)
        inside = (code >= low[group]) & (code <= high[group]) & (low < high)[group]
        group, code = group[inside], code[inside]
    return low


def best_rows(group: np.ndarray, score: np.ndarray, rank: np.ndarray, n: int) -> np.ndarray:
    """Indices of the n best rows of every group: highest score, equal scores by smallest rank. Ranks are unique in a group."""
    if not group.size:
        return np.zeros(0, np.int64)
    groups = int(group.max()) + 1
    code = score_codes(score)
    cut = bisect_cutoffs(group, code, groups, np.full(groups, n))
    over = code > cut[group]
    tied = np.flatnonzero(code == cut[group])
    left = n - np.bincount(group[over], minlength=groups)
    inverse = np.uint64(2**63) - rank[tied].astype(np.uint64)
    cut2 = bisect_cutoffs(group[tied], inverse, groups, left)
    return np.sort(np.concatenate((np.flatnonzero(over), tied[inverse >= cut2[group[tied]]])))


def _byte_ranks(column: pa.Array) -> tuple[np.ndarray, int]:
    """Rank of each value in byte order, by sorting the dictionary only."""
    encoded = column.dictionary_encode()
    order = pc.sort_indices(encoded.dictionary.cast(pa.binary())).to_numpy()
    ranks = np.empty(order.size, np.int64)
    ranks[order] = np.arange(order.size)
    return ranks[encoded.indices.to_numpy()], order.size


def _reduce(table: pa.Table, n: int) -> pa.Table:
    """The n best (score, item) of each group among the table's rows; an item counts with its best score."""
    table = table.combine_chunks()
    group = table.column("g").combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
    rank, items = _byte_ranks(table.column("x").combine_chunks())
    score = table.column("score").to_numpy()
    # an item that comes again keeps its best score only
    order = np.lexsort((-score, group * items + rank))
    key = (group * items + rank)[order]
    once = order[np.concatenate(([True], key[1:] != key[:-1]))]
    keep = once[best_rows(group[once], score[once], rank[once], n)]
    return table.take(pa.array(keep))


def _best(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.Table] = []
        rows = kept = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            parts.append(pa.Table.from_batches([batch]))
            rows += batch.num_rows
            if rows - kept >= BLOCK_ROWS and rows >= 2 * kept:
                parts = [_reduce(pa.concat_tables(parts), n)]
                rows = kept = parts[0].num_rows
        if parts:
            yield from _reduce(pa.concat_tables(parts), n).to_batches()

    return run


def top_n_per_group(df: DataFrame, group: str, item: str, score: Column, n: int, *, salts: int = SALTS) -> DataFrame:
    """The ``n`` best items of every group: highest score first, equal scores by the smaller item in byte order.

    ``score`` is a double expression over ``df``; rows whose score is null or NaN, or whose group or
    item is null, don't count. An item that comes again counts once, with its best score. Groups with
    fewer items give fewer rows; an empty table gives none. Columns: group, item, score. Other columns
    of ``df`` are not read, so their names can't clash. The rows of a group are exact for any skew.
    """
    if n < 1 or salts < 1:
        raise ValueError("n and salts must be positive")
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(item).cast("string").alias("x"), score.cast("double").alias("score"))
    rows = rows.where("g is not null and x is not null and score is not null and not isnan(score)")
    schema = "g string, x string, score double"
    local = rows.mapInArrow(_best(n), schema)
    parted = local.repartition("g", F.pmod(F.hash("x"), F.lit(salts))).mapInArrow(_best(n), schema)
    final = parted.repartition("g").mapInArrow(_best(n), schema)
    return final.select(F.col("g").alias(group), F.col("x").alias(item), "score")
