"""Items that appear together: pair counts by external sort of packed 64-bit codes.

Plan
1. one ``distinct`` over (group, basket, item);
2. a dictionary of items with their supports; supports alone prove that many items can be
   in no wanted pair (``n_ab <= min(n_a, n_b)``), and those are left out before any pair exists;
3. the dictionary is sorted by range and numbered densely, so a pair is one 64-bit code whose
   order is the byte order of the two items;
4. per chunk of baskets a kernel writes sorted, run-length-counted runs of codes;
5. runs are shuffled by code, merged by Spark's external sorter (sorted spills, multiway
   merge) and run-length-summed in one streaming pass;
6. odds ratios with continuity correction (1/2 on every cell).

A large group is split by salting its baskets; a basket beyond ``block`` items is split into
block pairs, so neither ever sits in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import number_rows
from ..session import materialise

#: codes held by a worker before they are sorted and counted into a run
RUN_CODES = 2_000_000
#: rows of baskets that one chunk of a group may hold
CHUNK_ROWS = 50_000

_RUNS = "code long, n long"


def _count_runs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes.sort()
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
    return codes[first], np.diff(np.append(first, codes.size))


def _emit_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, i, j, blk, id), all rows of a key together: sorted and counted runs of pair codes."""

    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        codes, n = _count_runs(np.concatenate(parts))
        return pa.RecordBatch.from_arrays([pa.array(codes), pa.array(n)], names=["code", "n"])

    parts: list[np.ndarray] = []
    held = 0
    rest: list[pa.Table] = []
    upper: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def pairs_of(keys: np.ndarray, i: np.ndarray, j: np.ndarray, blk: np.ndarray, ids: np.ndarray) -> Iterator[np.ndarray]:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        for a, z in zip(starts, np.append(starts[1:], keys.size), strict=True):
            own = np.sort(ids[a:z])
            if z - a < 2:
                continue
            if i[a] != j[a]:  # two different blocks of one large basket: only pairs between them, none if one is empty
                one, two = ids[a:z][blk[a:z] == i[a]], ids[a:z][blk[a:z] == j[a]]
                left, right = np.repeat(one, two.size), np.tile(two, one.size)
                yield (np.minimum(left, right) << 32) | np.maximum(left, right)
                continue
            if own.size not in upper:
                if len(upper) > 256:
                    upper.clear()
                upper[own.size] = np.triu_indices(own.size, 1)
            x, y = upper[own.size]
            yield (own[x] << 32) | own[y]

    def run(table: pa.Table) -> Iterator[np.ndarray]:
        col = lambda c: table.column(c).to_numpy()
        yield from pairs_of(*(col(c) for c in ("key", "i", "j", "blk", "id")))

    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        keys = table.column("key").to_numpy()
        last = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
        if last == 0:
            rest.append(table)
            continue
        ready = pa.concat_tables([*rest, table.slice(0, last)])
        rest = [table.slice(last)]
        for codes in run(ready):
            parts.append(codes)
            held += codes.size
            if held >= RUN_CODES:
                yield flush(parts)
                parts, held = [], 0
    if rest:
        for codes in run(pa.concat_tables(rest)):
            parts.append(codes)
            held += codes.size
            if held >= RUN_CODES:
                yield flush(parts)
                parts, held = [], 0
    if parts:
        yield flush(parts)


def _merge_runs(min_count: int):
    """Over code-sorted rows: one row per code with the sum of its runs."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_code, open_n = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
            codes, n = codes[first], np.add.reduceat(n, first)
            if open_code is not None:
                if codes[0] == open_code:
                    n[0] += open_n
                else:
                    codes, n = np.concatenate(([open_code], codes)), np.concatenate(([open_n], n))
            open_code, open_n = codes[-1], n[-1]
            keep = n[:-1] >= min_count
            yield pa.RecordBatch.from_arrays([pa.array(codes[:-1][keep]), pa.array(n[:-1][keep])], names=["code", "n"])
        if open_code is not None and open_n >= min_count:
            yield pa.RecordBatch.from_arrays([pa.array([int(open_code)], pa.int64()), pa.array([int(open_n)], pa.int64())], names=["code", "n"])

    return merge


def cooccurring_pairs(df: DataFrame, group: str, basket: str, item: str, *, min_count: int = 1, min_lift: int = 0, block: int = 2048) -> DataFrame:
    """Pairs of items of one group found in the same baskets, with counts, lift and odds ratio.

    Columns: group, item_a, item_b, n_ab, n_a, n_b, n, lift, odds_ratio; item_a < item_b in byte
    order. Every count is over distinct baskets; ``n`` counts the group's baskets that hold any item.
    ``min_count`` and ``min_lift`` (an integer: ``n_ab * n >= min_lift * n_a * n_b``) are both also
    used to leave out items that can be in no such pair; the result is the same as filtering after.

    Rows with a null group, basket or item count nowhere; repeated rows count once; an empty table
    gives an empty result; other columns, whatever their names, are not read. The empty string is an
    ordinary value. Order of the result is undefined.
    """
    if min_count < 1 or min_lift < 0 or block < 2:
        raise ValueError("min_count >= 1, min_lift >= 0 and block >= 2 are required")
    rows = df.select(F.col(group).cast("string").alias("g"), F.col(basket).cast("string").alias("b"), F.col(item).cast("string").alias("x"))
    base = materialise(rows.dropna().distinct(), "baskets")

    totals = base.select("g", "b").distinct().groupBy("g").agg(F.count("*").alias("n"))
    supports = base.groupBy("g", "x").agg(F.count("*").alias("n_x")).join(totals, "g")
    useful = supports.where((F.col("n_x") >= min_count) & (F.col("n_x") * min_lift <= F.col("n")))
    items = materialise(number_rows(useful, ["g", "x"]), "dictionary")
    if (items.agg(F.max("id")).first()[0] or 0) >= 2**31:
        raise ValueError("more than 2^31 items survive the support bounds; raise min_count")

    chunks = items.groupBy("g").agg(F.ceil(F.sum("n_x") / CHUNK_ROWS).alias("_salts"))
    # the number of salts travels with the items, so no join is keyed by a group alone on the side of the rows
    numbered = base.join(items.select("g", "x", "id").join(chunks, "g"), ["g", "x"])
    large = numbered.groupBy("g", "b").agg(F.ceil(F.count("*") / block).alias("_blocks")).where("_blocks > 1")
    marked = numbered.join(large, ["g", "b"], "left").withColumn("_blocks", F.coalesce("_blocks", F.lit(1)))
    marked = marked.withColumn("blk", F.pmod(F.hash("id"), F.col("_blocks")).cast("long"))
    others = F.transform(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1), lambda o: F.struct(F.least(o, "blk").alias("i"), F.greatest(o, "blk").alias("j")))
    spread = marked.withColumn("_pair", F.explode(others)).select(
        "g", F.pmod(F.hash("b", "_pair"), F.col("_salts")).alias("salt"), "b", F.col("_pair.i").alias("i"), F.col("_pair.j").alias("j"), "blk", "id"
    )
    # the numbering of sorted keys is local to a task: baskets never leave it
    placed = spread.repartition("g", "salt").sortWithinPartitions("g", "b", "i", "j")
    keyed = placed.select(F.col("g"), "b", "i", "j", "blk", "id")
    runs = keyed.mapInArrow(_keyed(_emit_runs), _RUNS)
    merged = runs.repartition("code").sortWithinPartitions("code").mapInArrow(_merge_runs(min_count), _RUNS)

    a = items.select(F.col("id").alias("_a"), F.col("g").alias(group), F.col("x").alias("item_a"), F.col("n_x").alias("n_a"), "n")
    b = items.select(F.col("id").alias("_b"), F.col("x").alias("item_b"), F.col("n_x").alias("n_b"))
    pairs = merged.select(F.shiftright("code", 32).alias("_a"), F.col("code").bitwiseAND(F.lit(2**32 - 1)).alias("_b"), F.col("n").alias("n_ab"))
    joined = pairs.join(a, "_a").join(b, "_b")
    if min_lift:
        joined = joined.where(F.col("n_ab") * F.col("n") >= min_lift * F.col("n_a") * F.col("n_b"))
    return joined.select(group, "item_a", "item_b", "n_ab", "n_a", "n_b", "n", lift().alias("lift"), odds_ratio().alias("odds_ratio"))


def _keyed(kernel):
    """Number the (g, b, i, j) runs of a sorted partition, so that the kernel compares one long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered() -> Iterator[pa.RecordBatch]:
            seen, key = None, -1
            for batch in batches:
                if not batch.num_rows:
                    continue
                changed = np.zeros(batch.num_rows, bool)
                for c in range(4):
                    col = batch.column(c)
                    changed[1:] |= np.asarray(pa.compute.not_equal(col.slice(1), col.slice(0, batch.num_rows - 1)))
                head = tuple(batch.column(c)[0].as_py() for c in range(4))
                changed[0] = head != seen
                keys = key + np.cumsum(changed)
                key, seen = int(keys[-1]), tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in range(4))
                yield pa.RecordBatch.from_arrays([pa.array(keys), *(batch.column(c) for c in range(2, 6))], names=["key", "i", "j", "blk", "id"])

        yield from kernel(numbered())

    return run


def lift() -> Column:
    """Observed over expected count."""
    return F.col("n_ab") * F.col("n") / (F.col("n_a") * F.col("n_b"))


def odds_ratio() -> Column:
    """Odds ratio of the 2x2 table of two items with 1/2 added to each cell."""
    both, a, b, n = (F.col(c).cast("double") for c in ("n_ab", "n_a", "n_b", "n"))
    return (both + 0.5) * (n - a - b + both + 0.5) / ((a - both + 0.5) * (b - both + 0.5))
