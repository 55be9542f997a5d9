"""Stitching of read pairs: the best ungapped offset between R1 and the reverse complement of R2.

Internal gaps aren't permitted, so a stitch is one offset. All offsets of a pair are scored by array
operations; among equal scores the longer overlap, then the smaller offset wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "status string, seq string, qual array<smallint>, overlap int, hq_mismatches int, lq_mismatches int"


def stitch_pair(r1: str, q1: np.ndarray, r2: str, q2: np.ndarray, *, min_overlap: int = 10, error: float = 0.01, primary: int = 25, max_mismatches: int = 10) -> tuple:
    """(status, seq, qual, overlap, hq, lq) of R1 and R2, both already in R1's direction. NOOVERLAP without a passing offset.

    Statuses: PERFECTOVERLAP, R1ENDSINR2 (the usual one), R1BEGINSINR2 (read-through: only the overlap is kept),
    R1ALLINR2, R2ALLINR1 (of the longer mate's ends only bases of quality ``primary`` or more are kept on one side).
    Overlap bases: equal -> the higher quality; different -> the base of higher quality, ties to R1.
    """
    none = ("NOOVERLAP", None, None, 0, 0, 0)
    n, m = len(r1), len(r2)
    if min(n, m) < min_overlap:
        return none
    a, b = np.frombuffer(r1.upper().encode(), np.uint8), np.frombuffer(r2.upper().encode(), np.uint8)
    # matches of every offset at once: for each letter the correlation of both mates' indicators
    equal = sum(np.correlate((a == c).astype(np.float32), (b == c).astype(np.float32), "full") for c in np.unique(a))
    offsets = np.arange(1 - m, n)
    sizes = np.minimum(offsets + m, n) - np.maximum(offsets, 0)
    scores = np.where(sizes >= min_overlap, 4 * np.rint(equal).astype(np.int64) - 2 * sizes, -(10**9))
    at = int(np.lexsort((offsets, -sizes, -scores))[0])
    offset, size = int(offsets[at]), int(sizes[at])
    lo, hi = max(offset, 0), min(offset + m, n)
    x, y, qx, qy = a[lo:hi], b[lo - offset : hi - offset], q1[lo:hi], q2[lo - offset : hi - offset]
    differ = x != y
    high = (qx >= primary) & (qy >= primary)
    hq, lq = int((differ & high).sum()), int((differ & ~high).sum())
    certain = int(high.sum())
    identity = 1.0 if not certain else 1 - hq / certain
    if identity < 1 - error or hq > max_mismatches or lq > max_mismatches or hq + lq > 2 * max_mismatches:
        return none
    take = qy > qx
    middle, quality = np.where(differ & take, y, x), np.maximum(qx, qy)
    # what sticks out: bases of R1 or R2 before and after the overlap
    front1, front2, back1, back2 = lo > 0, offset < 0, hi < n, offset + m > n
    parts: list[tuple[np.ndarray, np.ndarray]] = [(middle, quality)]
    if not (front1 or front2 or back1 or back2):
        status = "PERFECTOVERLAP"
    elif not front2 and not back1:
        status = "R1ENDSINR2"
        parts = [(a[:lo], q1[:lo]), *parts, (b[hi - offset :], q2[hi - offset :])]
    elif not front1 and not back2:
        status = "R1BEGINSINR2"
    elif front2 and back2:
        status = "R1ALLINR2"
        tail, tail_q = b[hi - offset :], q2[hi - offset :]
        parts.append((tail[tail_q >= primary], tail_q[tail_q >= primary]))
    else:
        status = "R2ALLINR1"
        head, head_q = a[:lo], q1[:lo]
        parts.insert(0, (head[head_q >= primary], head_q[head_q >= primary]))
    seq = np.concatenate([p for p, _ in parts]).tobytes().decode()
    return status, seq, np.concatenate([q for _, q in parts]).astype(np.int16), size, hq, lq


def stitch(pairs: DataFrame, keep: list[str], r1: str, q1: str, r2: str, q2: str, **options: float) -> DataFrame:
    """The ``keep`` columns with status, seq, qual, overlap and mismatches of each pair.

    R2 is given as sequenced and turned here. Missing qualities count as 40; qualities of another length than the
    sequence count as missing. A null mate gives NOOVERLAP. Narrow: no shuffle, Arrow batches in and out.
    """
    kinds = dict(pairs.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in keep) + ", " + SCHEMA
    back = str.maketrans("ACGTacgt", "TGCAtgca")

    def values(q, size: int) -> np.ndarray:  # noqa: ANN001
        return np.asarray(q, np.int16) if q is not None and len(q) == size else np.full(size, 40, np.int16)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for a, qa, b, qb in zip(part["_r1"], part["_q1"], part["_r2"], part["_q2"], strict=True):
                if a is None or b is None:
                    out.append(("NOOVERLAP", None, None, 0, 0, 0))
                    continue
                out.append(stitch_pair(a, values(qa, len(a)), b.translate(back)[::-1], values(qb, len(b))[::-1], **options))
            cols = pd.DataFrame(out, columns=["status", "seq", "qual", "overlap", "hq_mismatches", "lq_mismatches"], index=part.index)
            yield pd.concat([part[keep], cols], axis=1)

    rows = pairs.select(*keep, F.col(r1).alias("_r1"), F.col(q1).alias("_q1"), F.col(r2).alias("_r2"), F.col(q2).alias("_q2"))
    return rows.mapInPandas(run, schema)
