"""Error-tolerant collapse, chimeras, spanning graphs, difference tables.

Kernels work on the distinct sequences of one sample, gathered as one row; the largest row is a sample's number of distinct sequences (dereplicate first), never a population.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequence as sq


@dataclass(frozen=True)
class Round:
    """One round of a collapse: how many larger clusters are tried, the least count that may receive, and what may differ."""

    stop_check: int = 100
    small_cutoff: int = 3
    indel1: float = 0
    indel2: float = 0
    indel_more: float = 0
    hq: float = 0
    lq: float = 0
    low_kmer: float = 0
    identity: float | None = None

    def passes(self, p: Profile) -> bool:
        if self.identity is not None:
            return p.identity >= self.identity
        return p.indel1 <= self.indel1 and p.indel2 <= self.indel2 and p.indel_more <= self.indel_more and p.hq <= self.hq and p.lq <= self.lq


@dataclass(frozen=True)
class Profile:
    """How two sequences differ, by kind of event."""

    identity: float
    indel1: int
    indel2: int
    indel_more: int
    hq: int
    lq: int


def read_rounds(text: str) -> list[Round]:
    """Rounds of a parameter file: a header of eight error counts or of an identity, then one line per round."""
    lines = [x.split(":") for x in text.split() if x.strip()]
    if not lines:
        raise ValueError("no rounds")
    names = [n.lower() for n in lines[0]]
    if "id" in names:
        return [Round(int(r[0]), int(r[1]), identity=float(r[2])) for r in lines[1:]]
    if len(names) != 8 or any(len(r) != 8 for r in lines):
        raise ValueError("a line of eight values is needed")
    return [Round(int(r[0]), int(r[1]), *map(float, r[2:])) for r in lines[1:]]


def align(a: str, b: str, match: int = 2, mismatch: int = -2, gap: int = 5, extend: int = 1) -> tuple[str, str, int]:
    """Global alignment with affine gaps; both sequences with gaps, and the score. Rows are vectorised over ``b``."""
    n, m = len(a), len(b)
    low = -(10**9)
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    best = np.full((n + 1, m + 1), low, np.int64)
    down = np.full((n + 1, m + 1), low, np.int64)
    across = np.full((n + 1, m + 1), low, np.int64)
    best[0, 0] = 0
    steps = np.arange(1, m + 1)
    across[0, 1:] = best[0, 1:] = -(gap + extend * (steps - 1))
    for i in range(1, n + 1):
        down[i] = np.maximum(best[i - 1] - gap, down[i - 1] - extend)
        diagonal = best[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch)
        row = np.concatenate(([down[i, 0]], np.maximum(diagonal, down[i, 1:])))
        # a gap along b: the best opening so far, by running maximum
        opened = np.maximum.accumulate(row + extend * np.arange(m + 1))
        across[i, 1:] = opened[:-1] - gap - extend * (steps - 1)
        best[i] = np.maximum(row, across[i])
    out_a, out_b, i, j = [], [], n, m
    while i or j:
        if i and j and best[i, j] == best[i - 1, j - 1] + (match if a[i - 1] == b[j - 1] else mismatch):
            i, j = i - 1, j - 1
            out_a.append(a[i])
            out_b.append(b[j])
        elif i and best[i, j] == down[i, j]:
            while i and down[i, j] != best[i - 1, j] - gap:
                i -= 1
                out_a.append(a[i])
                out_b.append("-")
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            while j and across[i, j] != best[i, j - 1] - gap:
                j -= 1
                out_a.append("-")
                out_b.append(b[j])
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    return "".join(out_a[::-1]), "".join(out_b[::-1]), int(best[n, m])


def profile(a: str, b: str, qa: list[int] | None = None, qb: list[int] | None = None, primary: int = 25) -> Profile:
    """Events between two sequences; a mismatch is of high quality where both bases reach ``primary`` (always, without qualities)."""
    if a == b:
        return Profile(1.0, 0, 0, 0, 0, 0)
    pairs = list(zip(a, b, strict=True)) if len(a) == len(b) and sum(p != q for p, q in zip(a, b, strict=True)) <= 3 else None
    left, right = (a, b) if pairs else align(a, b)[:2]
    i = j = hq = lq = same = 0
    gaps: list[int] = []
    run = 0
    side = ""
    for p, q in zip(left, right, strict=True):
        if p == "-" or q == "-":
            now = "a" if p == "-" else "b"
            run = run + 1 if now == side else 1
            if run == 1:
                gaps.append(0)
            gaps[-1] = run
            side = now
        else:
            side = ""
            if p == q:
                same += 1
            elif (qa is None or i >= len(qa) or qa[i] >= primary) and (qb is None or j >= len(qb) or qb[j] >= primary):
                hq += 1
            else:
                lq += 1
        i += p != "-"
        j += q != "-"
    return Profile(same / max(len(left), 1), gaps.count(1), gaps.count(2), sum(g > 2 for g in gaps), hq, lq)


def collapse_group(rows: pd.DataFrame, rounds: list[Round]) -> pd.DataFrame:
    """Rows (seq, cnt, qual) of one sample -> the same with ``into``, the sequence of the cluster that holds them.

    Clusters are ordered by count, then sequence. In every round each cluster, smallest first, goes into the
    first of the ``stop_check`` largest that has more reads than ``small_cutoff`` and at least its own count,
    and differs by no more than the round permits. Counts are conserved, no cluster is ever split.
    """
    rows = rows.sort_values(["cnt", "seq"], ascending=[False, True], kind="stable").reset_index(drop=True)
    seqs, counts = rows["seq"].tolist(), rows["cnt"].to_numpy(float).copy()
    quals = [None if q is None or len(q) != len(s) else list(q) for q, s in zip(rows["qual"], seqs, strict=True)] if "qual" in rows else [None] * len(seqs)
    into = list(range(len(seqs)))
    alive = list(range(len(seqs)))
    known: dict[tuple[int, int], Profile] = {}
    for r in rounds:
        alive.sort(key=lambda k: (-counts[k], seqs[k]))
        for small in alive[::-1]:
            tried = 0
            for large in alive:
                if large == small or tried >= r.stop_check:
                    break
                if into[large] != large:
                    continue
                tried += 1
                if counts[large] <= r.small_cutoff or counts[large] < counts[small]:
                    continue
                key = (large, small)
                if key not in known:
                    known[key] = profile(seqs[large], seqs[small], quals[large], quals[small])
                if r.passes(known[key]):
                    counts[large] += counts[small]
                    into[small] = large
                    break
        alive = [k for k in alive if into[k] == k]

    def root(k: int) -> int:
        while into[k] != k:
            k = into[k]
        return k

    return rows.assign(into=[seqs[root(k)] for k in range(len(seqs))])


def collapse(df: DataFrame, by: list[str], seq: str, count: str, rounds: list[Round], qual: str | None = None) -> DataFrame:
    """(by, seq, cnt, into): every distinct sequence of a key with the one it was collapsed into. Null sequences are left out."""
    unique = df.where(F.col(seq).isNotNull()).groupBy(*by, F.upper(seq).alias("seq"))
    quality = [F.max_by(qual, F.struct(count, "name_" if "name_" in df.columns else count)).alias("qual")] if qual else []
    unique = unique.agg(F.coalesce(F.sum(count), F.lit(0.0)).alias("cnt"), *quality)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", seq string, cnt double, into string"
    groups = unique.groupBy(*by).agg(F.collect_list(F.struct("seq", "cnt", *(["qual"] if qual else []))).alias("_g"))
    # a key with one sequence has nothing to collapse and stays in the JVM
    single = groups.where(F.size("_g") == 1).select(*by, F.col("_g")[0]["seq"].alias("seq"), F.col("_g")[0]["cnt"].alias("cnt"), F.col("_g")[0]["seq"].alias("into"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for row in batch.itertuples(index=False):
                done = collapse_group(pd.DataFrame(list(row[-1])), rounds)[["seq", "cnt", "into"]]
                for i, c in enumerate(by):
                    done.insert(i, c, row[i])
                parts.append(done)
            if parts:
                yield pd.concat(parts)

    return single.unionByName(groups.where(F.size("_g") > 1).select(*by, "_g").mapInPandas(run, schema))


def chimeras(unique: DataFrame, by: list[str], times: int = 2) -> DataFrame:
    """(by, seq, left_parent, right_parent): sequences that are a prefix of one parent followed by a suffix of another.

    Both parents are at least ``times`` as abundant. Exact: the longest prefix common with a parent and the
    longest suffix common with another cover the sequence. Of several pairs the one with the longest prefix counts, then
    the smallest left parent, the longest suffix and the smallest right parent.
    """
    a = unique.select(*by, "seq", "cnt")
    p = unique.select(*by, F.col("seq").alias("parent"), F.col("cnt").alias("p_cnt"))
    met = a.join(p, by).where((F.col("p_cnt") >= times * F.col("cnt")) & (F.col("parent") != F.col("seq")))

    def common(x, y):  # noqa: ANN001, ANN202
        steps = F.sequence(F.lit(1), F.least(F.length(x), F.length(y)))
        different = F.filter(steps, lambda i: F.substring(x, i, F.lit(1)) != F.substring(y, i, F.lit(1)))
        return F.coalesce(F.get(different, F.lit(0)) - 1, F.least(F.length(x), F.length(y)))

    parts = met.withColumns({"pre": common(F.col("seq"), F.col("parent")), "suf": common(F.reverse("seq"), F.reverse("parent"))})
    # two of each side are enough: the best left parent may be the best right one too, and is then no partner of itself
    def best(length: str, name: str) -> DataFrame:
        w = Window.partitionBy(*by, "seq").orderBy(F.desc(length), "parent")
        ranked = parts.where(F.col(length) > 0).withColumn("_r", F.row_number().over(w)).where("_r <= 2")
        return ranked.select(*by, "seq", length, F.col("parent").alias(name))

    both = best("pre", "left_parent").join(best("suf", "right_parent"), [*by, "seq"])
    both = both.where((F.col("left_parent") != F.col("right_parent")) & (F.col("pre") + F.col("suf") >= F.length("seq")))
    chosen = both.groupBy(*by, "seq").agg(F.min(F.struct((-F.col("pre")).alias("p"), "left_parent", (-F.col("suf")).alias("s"), "right_parent")).alias("c"))
    return chosen.select(*by, "seq", "c.left_parent", "c.right_parent")


def difference_table(rows: DataFrame, refs: DataFrame, by: list[str], seq: str, ref: str, count: str) -> DataFrame:
    """(by, pos, ref_base, base, seqs, reads): how sequences of the reference's length differ from it, per position (from 1)."""
    met = rows.select(*by, F.upper(seq).alias("_s"), count).join(refs.select(*by, F.upper(ref).alias("_r")), by).where(F.length("_s") == F.length("_r"))
    # only positions that differ become rows
    pairs = F.arrays_zip(sq.bases(F.col("_r")).alias("r"), sq.bases(F.col("_s")).alias("s"), F.sequence(F.lit(1), F.greatest(F.length("_s"), F.lit(1))).alias("p"))
    long = met.withColumn("_d", F.explode(F.filter(pairs, lambda x: x["r"] != x["s"]))).select(*by, F.col("_d.p").alias("pos"), F.col("_d.r").alias("ref_base"), F.col("_d.s").alias("base"), count)
    return long.groupBy(*by, "pos", "ref_base", "base").agg(F.count("*").alias("seqs"), F.coalesce(F.sum(count), F.lit(0.0)).alias("reads"))


def spanning_edges(unique: DataFrame, by: list[str]) -> DataFrame:
    """(by, a, b, events): a least-events spanning tree over each key's sequences (ties: the smaller names). One row per edge."""
    kinds = dict(unique.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in by) + ", a string, b string, events int"

    def tree(g: pd.DataFrame) -> pd.DataFrame:
        seqs = sorted(g["seq"])
        edges = []
        for i, a in enumerate(seqs):
            for b in seqs[i + 1 :]:
                p = profile(a, b)
                edges.append((p.indel1 + p.indel2 + p.indel_more + p.hq + p.lq, a, b))
        parent = {s: s for s in seqs}

        def find(s: str) -> str:
            while parent[s] != s:
                parent[s] = parent[parent[s]]
                s = parent[s]
            return s

        out = []
        for n, a, b in sorted(edges):
            if find(a) != find(b):
                parent[find(a)] = find(b)
                out.append((*(g[c].iloc[0] for c in by), a, b, n))
        return pd.DataFrame(out, columns=[*by, "a", "b", "events"])

    return unique.groupBy(*by).applyInPandas(tree, schema)


def chimera_by_fraction(rows: DataFrame, by: list[str], count: str, flag: str, cutoff: float = 0.4) -> DataFrame:
    """(by, cnt, chimera): clusters of which a share of ``cutoff`` or more of all reads is marked; a null mark is none, no reads are no chimera."""
    marked = F.coalesce(F.sum(F.when(F.col(flag), F.col(count))), F.lit(0.0))
    per = rows.groupBy(*by).agg(F.sum(count).alias("cnt"), marked.alias("_m"))
    return per.select(*by, "cnt", F.coalesce(F.when(F.col("cnt") != 0, F.col("_m") / F.col("cnt") >= cutoff), F.lit(False)).alias("chimera"))


def snp_breakout(rows: DataFrame, refs: DataFrame, by: list[str], seq: str, ref: str, count: str, *, least: float = 10, share: float = 0.01) -> DataFrame:
    """(by, pos, ref_base, base, reads, fraction): differences carried by ``least`` reads and by that share of the key's reads."""
    table = difference_table(rows, refs, by, seq, ref, count)
    totals = rows.groupBy(*by).agg(F.sum(count).alias("_t"))
    met = table.join(totals, by).where((F.col("reads") >= least) & (F.col("reads") >= share * F.col("_t")))
    return met.select(*by, "pos", "ref_base", "base", "reads", (F.col("reads") / F.col("_t")).alias("fraction"))
