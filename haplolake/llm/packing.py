"""Filling fixed-capacity containers: cost-balanced packing of token counts.

Texts are measured once by a public tokenizer (vocabulary read from a path, whole texts). A text
longer than the capacity is divided into full containers and a rest; no other text is divided.
Items are spread over packing groups of many thousand containers each, so every group wastes
at most about one container; in a group, items in descending order go to the sequence of lowest
estimated cost (linear in tokens plus quadratic in each item's length, as attention costs) among
those with enough capacity left. The number of sequences starts at the least possible one and a new
one is opened only when an item fits nowhere.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .words import small_slices

#: tokens that a packing group should hold, and containers it should fill at least, whatever their capacity
GROUP_TOKENS, GROUP_CONTAINERS = 4_000_000, 500
#: cost of a token, and of a pair of tokens of one item
LINEAR, QUADRATIC = 1.0, 1.0 / 4096


def _tokenizer(path: str, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _count(path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(path, pattern).encode_ordinary
        for batch in (part for whole in batches for part in small_slices(whole, "text")):
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sizes, pa.int64())], names=["id", "tokens"])

    return run


def token_counts(df: DataFrame, rec_id: str, text: str, *, vocabulary: str, pattern: str) -> DataFrame:
    """(id, tokens): length of every text in tokens; a null or empty text has 0. Rows without an id are left out."""
    rows = df.select(F.col(rec_id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).where("id is not null")
    return rows.mapInArrow(_count(vocabulary, pattern), "id long, tokens long")


def assign(sizes: np.ndarray, capacity: int, linear: float = LINEAR, quadratic: float = QUADRATIC) -> np.ndarray:
    """Container of every item, sizes in descending order: the cheapest container that has room, else a new one."""
    bins = max(int(-(-sizes.sum() // capacity)), 1)
    room = np.full(bins, capacity, np.int64)
    cost = np.zeros(bins)
    out = np.empty(sizes.size, np.int64)
    at = 0
    while at < sizes.size:
        size = int(sizes[at])
        run = int(np.searchsorted(-sizes, -size, "right")) - at  # items of one size are placed in one go
        price = linear * size + quadratic * size * size
        while run:
            fits = np.flatnonzero(room >= size)
            if not fits.size:
                room = np.append(room, capacity)
                cost = np.append(cost, 0.0)
                fits = np.array([room.size - 1])
            # one item to each of the cheapest, as long as none of them would become cheaper than the next untouched one again
            order = fits[np.argsort(cost[fits], kind="stable")]
            free = int(np.searchsorted(cost[order], cost[order[0]] + price, "left"))
            take = order[: min(max(free, 1), run)]
            out[at : at + take.size] = take
            room[take] -= size
            cost[take] += price
            at += take.size
            run -= take.size
    return out


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(table: pa.Table) -> pa.RecordBatch:
            sizes = table.column("tokens").to_numpy()
            order = np.lexsort((table.column("part").to_numpy(), table.column("id").to_numpy(), -sizes))
            table = table.take(pa.array(order))
            bins = assign(sizes[order], capacity)
            group = table.column("grp").to_numpy()
            arrays = [table.column(c).combine_chunks() for c in ("id", "part", "tokens")]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(group.astype(np.int64) * (1 << 32) + bins)], names=["id", "part", "tokens", "container"])

        held: list[pa.Table] = []
        group = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = table.column("grp").to_numpy()
            cuts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1]))) if groups.size else []
            for a, z in zip(cuts, np.append(cuts[1:], groups.size) if len(cuts) else [], strict=True):
                if held and groups[a] != group:
                    yield pack(pa.concat_tables(held))
                    held = []
                group = groups[a]
                held.append(table.slice(a, z - a))
        if held:
            yield pack(pa.concat_tables(held))

    return run


def pack_items(counts: DataFrame, capacity: int, *, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """(id, part, tokens, container): every item of (id, tokens) in a container that holds at most ``capacity`` tokens.

    An item beyond the capacity is divided into full containers and a rest, numbered by ``part``; all
    others have part 0 only. Empty items (null or 0 tokens) use no space and are in no container: their
    container is null. A row that comes again is an item of its own. An empty table gives no rows. Container
    ids are unique; their upper bits name the packing group. A group's work is bounded by ``group_tokens`` (or 500 containers, if those hold more), whatever
    the number of items, because items are spread over the groups by hash of their id and size.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    sized = materialise(counts.select("id", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens")), "sizes")
    total = sized.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, round(total / max(group_tokens, GROUP_CONTAINERS * capacity)))
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.expr(f"(tokens - 1) div {capacity}"), F.lit(0)))
    split = sized.where("tokens > 0").withColumn("part", F.explode(parts))
    split = split.withColumn("tokens", F.least(F.lit(capacity).cast("long"), F.col("tokens") - F.col("part") * capacity))
    grouped = split.select("id", F.col("part").cast("int").alias("part"), "tokens", F.pmod(F.xxhash64("id", "part", "tokens"), F.lit(groups)).cast("int").alias("grp"))
    packed = grouped.repartition(groups, "grp").sortWithinPartitions("grp").mapInArrow(_pack(capacity), "id long, part int, tokens long, container long")
    empty = sized.where("tokens = 0").select("id", F.lit(0).alias("part"), "tokens", F.lit(None).cast("long").alias("container"))
    return packed.unionByName(empty)


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """One row: containers, tokens, the share of all space in use, and the fullest container's tokens."""
    per = packed.where("container is not null").groupBy("container").agg(F.sum("tokens").alias("used"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"), F.max("used").alias("fullest"))
