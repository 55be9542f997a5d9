"""Percentiles by mergeable rank-interval summaries.

A summary is a sorted list of tuples (v, rmin, rmax, w): ``w`` values equal ``v`` for certain, at
least ``rmin`` values are less than ``v`` and at most ``rmax`` are not greater. Merging adds the
intervals of both sides. A summary is compressed only when it outgrows its capacity, 1 / eps tuples:
those nearest to evenly spaced ranks stay, so at most ``eps * n`` more ranks become uncertain. The uncertainty is
carried by the tuples themselves, so the bound a result reports is the one really used up, not
the worst case; values of a small domain (base qualities) never outgrow the capacity and stay
exact through any number of merges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: tuples a summary may hold; a compression makes at most 1 / CAPACITY of all ranks more uncertain
CAPACITY = 1024
#: parts that a key's summaries are merged in before the last merge
SALTS = 16
#: tuples that a task holds before it passes its summaries on
HELD = 1_000_000

SUMMARY = "v array<double>, rmin array<long>, rmax array<long>, w array<long>"
_FIELDS = ("v", "rmin", "rmax", "w")
Summary = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def build(values: np.ndarray, counts: np.ndarray | None = None) -> Summary:
    """An exact summary of the values, each taken ``counts`` times."""
    v, at = np.unique(np.asarray(values, float), return_inverse=True)
    w = np.bincount(at, weights=counts, minlength=v.size).astype(np.int64)
    rmax = np.cumsum(w)
    return v, rmax - w, rmax, w


def _at(s: Summary, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each x what the summary says: least number below x, greatest number not above x, sure copies of x."""
    v, rmin, rmax, w = s
    after = np.searchsorted(v, x, "right")
    before = np.searchsorted(v, x, "left")
    here = after > before
    i, last = np.minimum(before, v.size - 1), np.maximum(before - 1, 0)
    below = np.where(here, rmin[i], np.where(before > 0, rmin[last] + w[last], 0))
    upto = np.where(here, rmax[i], np.where(after < v.size, rmax[i] - w[i], rmax[-1]))
    return below, upto, np.where(here, w[i], 0)


def merge(a: Summary, b: Summary) -> Summary:
    """The summary of both sides' values together."""
    if not a[0].size or not b[0].size:
        return a if a[0].size else b
    v = np.union1d(a[0], b[0])
    return v, *(x + y for x, y in zip(_at(a, v), _at(b, v), strict=True))


def compress(s: Summary, capacity: int = CAPACITY) -> Summary:
    """At most about ``capacity`` tuples, those nearest to evenly spaced ranks; between two of them up to n / capacity more ranks become uncertain."""
    v, rmin, rmax, _ = s
    if v.size <= capacity:
        return s
    middle = (rmin + rmax) / 2
    wanted = np.linspace(middle[0], middle[-1], capacity)
    after = np.minimum(np.searchsorted(middle, wanted), v.size - 1)
    before = np.maximum(after - 1, 0)
    nearest = np.where(wanted - middle[before] < middle[after] - wanted, before, after)
    keep = np.unique(np.concatenate(([0], nearest, [v.size - 1])))
    return tuple(x[keep] for x in s)


def quantile(s: Summary, q: float) -> tuple[float, int]:
    """The value at quantile ``q`` (linear between the two nearest ranks) and the greatest rank error it may have."""
    v, rmin, rmax, w = s
    at = q * (int(rmax[-1]) - 1) + 1
    values, wrong = [], 0
    for rank in (int(np.floor(at)), int(np.ceil(at))):
        error = np.maximum(np.maximum(rmax - w + 1 - rank, rank - rmin - w), 0)
        best = int(np.argmin(error))
        values.append(v[best])
        wrong = max(wrong, int(error[best]))
    return float(values[0] + (values[1] - values[0]) * (at - np.floor(at))), wrong


# --- Spark -----------------------------------------------------------------------------------


def _count_rows(low: float, high: float):
    """Each row's array -> its distinct values v with counts n; the row's other columns pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            at = pc.list_parent_indices(lists).to_numpy()
            x = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            ok = (x >= low) & (x <= high)  # a null became NaN: neither
            at, x = at[ok], x[ok]
            whole = x.size and x.min() >= 0 and x.max() < 256 and not (x % 1).any()
            vocabulary, code = (np.arange(256.0), x.astype(np.int64)) if whole else np.unique(x, return_inverse=True)
            width = max(vocabulary.size, 1)
            key = at * width + code
            if width <= 256:
                count = np.bincount(key, minlength=batch.num_rows * width)
                key = np.flatnonzero(count)
                n = count[key]
            else:
                key, n = np.unique(key, return_counts=True)
            sizes = np.bincount(key // width, minlength=batch.num_rows)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            arrays = [batch.column(c) for c in range(batch.num_columns - 1)]
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(vocabulary[key % width])))
            arrays.append(pa.ListArray.from_arrays(offsets, pa.array(n.astype(np.int32))))
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names[:-1], "_v", "_n"])

    return run


def _lists(columns: list[pa.Array]) -> list[list[np.ndarray]]:
    """Per row the slices of several list columns."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(columns[0]), 0)))
    starts = np.concatenate(([0], ends[:-1]))
    flat = [c.flatten().to_numpy() for c in columns]
    return [[x[a:z] for x in flat] for a, z in zip(starts, ends, strict=True)]


def _as_batches(state: dict[tuple, Summary], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    items = list(state.items())
    for at in range(0, len(items), 10_000):
        some = items[at : at + 10_000]
        keys = [pa.array([k[c] for k, _ in some], f.type) for c, f in enumerate(schema)]
        parts = []
        for i, kind in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.int64())):
            offsets = pa.array(np.concatenate(([0], np.cumsum([s[i].size for _, s in some]))), pa.int32())
            parts.append(pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([s[i] for _, s in some]), kind)))
        yield pa.RecordBatch.from_arrays([*keys, *parts], names=[*schema.names, *_FIELDS])


def _merge_by_key(keys: int, capacity: int, held: int):
    """One summary per key and partition, of rows sorted by key; the first ``keys`` columns are the key.

    Finished keys are passed on as soon as a task holds ``held`` tuples.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, Summary] = {}
        schema, holds = None, 0
        for batch in batches:
            schema = pa.schema([batch.schema.field(c) for c in range(keys)])
            cols = [batch.column(c).to_pylist() for c in range(keys)]
            for key, s in zip(zip(*cols, strict=True), _lists([batch.column(f) for f in _FIELDS]), strict=True):
                if key not in state and holds > held:
                    yield from _as_batches(state, schema)
                    state, holds = {}, 0
                before = state[key][0].size if key in state else 0
                state[key] = compress(merge(state[key], tuple(s)), capacity) if before else tuple(s)
                holds += state[key][0].size - before
        if schema is not None:
            yield from _as_batches(state, schema)

    return run


def _sum_counts(keys: int, identity: list[str], capacity: int, held: int):
    """Rows (identity and key columns, v, n), equal identities next to each other: summaries per key and partition, passed on at ``held`` tuples.

    A batch is reduced by one bincount over (key, value) and then merged into the keys' summaries.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[tuple, Summary] = {}
        schema, seen = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            schema = pa.schema([batch.schema.field(c) for c in range(keys)])
            first = np.ones(batch.num_rows, bool)
            if identity:
                own = [batch.column(c) for c in identity]
                first[1:] = False
                for c in own:
                    a, b = c.slice(1), c.slice(0, batch.num_rows - 1)
                    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                    first[1:] |= ~np.asarray(same)
                head = tuple(c[0].as_py() for c in own)
                first[0] = head != seen
                seen = tuple(c[batch.num_rows - 1].as_py() for c in own)
                batch = batch.filter(pa.array(first))
                if not batch.num_rows:
                    continue
            table = pa.table({**{str(c): batch.column(c) for c in range(keys)}, "row": np.arange(batch.num_rows)})
            groups = table.group_by([str(c) for c in range(keys)]).aggregate([("row", "list")])
            members = groups.column("row_list").combine_chunks()
            of_row = np.empty(batch.num_rows, np.int64)
            of_row[members.flatten().to_numpy()] = pc.list_parent_indices(members).to_numpy()
            v, n = batch.column("_v"), batch.column("_n")
            vocabulary, code = np.unique(v.flatten().to_numpy(), return_inverse=True)
            key = of_row[pc.list_parent_indices(v).to_numpy()] * vocabulary.size + code
            whole, inverse = np.unique(key, return_inverse=True)
            count = np.bincount(inverse, weights=n.flatten().to_numpy(), minlength=whole.size)
            ends = np.cumsum(np.bincount(whole // vocabulary.size, minlength=groups.num_rows))
            names = zip(*(groups.column(str(c)).to_pylist() for c in range(keys)), strict=True)
            for name, a, z in zip(names, np.concatenate(([0], ends[:-1])), ends, strict=True):
                s = build(vocabulary[whole[a:z] % vocabulary.size], count[a:z])
                state[name] = compress(merge(state[name], s) if name in state else s, capacity)
            if sum(s[0].size for s in state.values()) > held:
                yield from _as_batches(state, schema)
                state = {}
        if schema is not None:
            yield from _as_batches(state, schema)

    return run


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{k}` {kinds[k]}" for k in keys)


def summarise(df: DataFrame, keys: list[str], values: str, *, identity: list[str] | None = None, low: float = float("-inf"), high: float = float("inf"), capacity: int = CAPACITY, held: int = HELD) -> DataFrame:
    """Summaries of an array column, at least one per key and partition: columns keys, v, rmin, rmax, w. ``combine`` joins them.

    With ``identity`` rows that agree in the keys and those columns count once; should their arrays
    differ, the one whose distinct values sort first counts. Values that are null, NaN or outside
    [low, high] don't count; a row with none of them left gives nothing. Null keys are a key of their
    own. Empty tables give no rows. Columns that aren't named are not read.
    """
    names = list(dict.fromkeys([*keys, *(identity or [])]))
    if set(names) & {*_FIELDS, "_v", "_n", "_values"}:
        raise ValueError(f"a key can't be named like a summary's columns: {', '.join(_FIELDS)}")
    rows = df.select(*names, F.col(values).alias("_values")).where(F.size("_values") > 0)
    slim = rows.mapInArrow(_count_rows(low, high), f"{_key_schema(df, names)}, _v array<double>, _n array<int>").where(F.size("_v") > 0)
    if identity:
        # what is shuffled are a row's few (value, count) pairs, not its values
        slim = slim.repartition(*names).sortWithinPartitions(*names, "_v", "_n")
    return slim.mapInArrow(_sum_counts(len(keys), names if identity else [], capacity, held), f"{_key_schema(df, keys)}, {SUMMARY}")


def combine(summaries: DataFrame, keys: list[str], *, capacity: int = CAPACITY, salts: int = SALTS, held: int = HELD) -> DataFrame:
    """Merge summaries (of partitions, days, deliveries) into one per key, hierarchically.

    First within salted parts of a key, then the parts: a key with very many summaries is never
    merged by one task alone. The compressions of the levels add up in the tuples' intervals.
    """
    schema = f"{_key_schema(summaries, keys)}, {SUMMARY}"
    merge_all = _merge_by_key(len(keys), capacity, held)
    slim = summaries.select(*keys, *_FIELDS)
    parts = slim.repartition(*keys, F.pmod(F.xxhash64("v", "w"), F.lit(salts))).sortWithinPartitions(*keys).mapInArrow(merge_all, schema)
    return parts.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge_all, schema)


def percentiles(summaries: DataFrame, keys: list[str], qs: dict[str, float]) -> DataFrame:
    """Columns keys, n, one per entry of ``qs`` and rank_error, the greatest rank error any of them may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [tuple(s) for s in _lists([batch.column(f) for f in _FIELDS])]
            found = [[quantile(s, q) for q in qs.values()] for s in rows]
            arrays = [batch.column(c) for c in range(len(keys))]
            arrays.append(pa.array([int(s[2][-1]) for s in rows], pa.int64()))
            arrays += [pa.array([f[i][0] for f in found], pa.float64()) for i in range(len(qs))]
            arrays.append(pa.array([max(e for _, e in f) for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "n", *qs, "rank_error"])

    fields = ", ".join(f"`{q}` double" for q in qs)
    return summaries.select(*keys, *_FIELDS).mapInArrow(run, f"{_key_schema(summaries, keys)}, n long, {fields}, rank_error long")


def is_named(column: str | Column, name: str) -> Column:
    """Whether a free-text setting says ``name``, whatever its case and surrounding spaces."""
    return F.lower(F.trim(column)) == name
