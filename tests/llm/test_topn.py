import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from haplolake.llm import topn


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.sampled_from([0.0, 0.25, 0.5, 1.0, -3.5, 1e300, -0.0])), min_size=1, max_size=60), st.integers(1, 5))
def test_bisection_equals_sorting(rows, n):
    group = np.array([g for g, _ in rows])
    score = np.array([s for _, s in rows])
    rank = np.arange(len(rows))
    got = topn.best_rows(group, score, rank, n)
    want = sorted(k for g in set(group) for k in sorted(np.flatnonzero(group == g), key=lambda k: (-score[k], rank[k]))[:n])
    assert got.tolist() == want


def test_codes_keep_the_order():
    x = np.array([-np.inf, -2.5, -1e-300, 0.0, 1e-300, 0.5, 1.0, np.inf])
    assert (np.diff(topn.score_codes(x).astype(object)) > 0).all()
    assert topn.score_codes(np.array([-0.0]))[0] == topn.score_codes(np.array([0.0]))[0]


def test_against_brute_force(spark):
    r = random.Random(3)
    rows = [(r.choice(["hot"] * 6 + ["a", "b", "c", None]), r.choice(["é", "z", "Z", "", None, *(f"h{k}" for k in range(40))]), r.choice([0.1, 0.5, 0.5, 1.0, float("nan"), None, -1.0, 2.0]), k, "x") for k in range(4000)]
    df = spark.createDataFrame(rows, "s string, h string, c double, g int, score string").repartition(7)
    got = topn.top_n_per_group(df, "s", "h", F.when(F.col("c").between(0, 1), F.col("c")), 3)
    best = defaultdict(dict)
    for s, h, c, *_ in rows:
        if s is not None and h is not None and c is not None and 0 <= c <= 1:
            best[s][h] = max(c, best[s].get(h, 0))
    want = {(s, h, c) for s, hs in best.items() for h, c in sorted(hs.items(), key=lambda x: (-x[1], x[0].encode()))[:3]}
    assert {tuple(x) for x in got.collect()} == want
    assert got.count() == len(want)


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "s string, h string, c double")
    assert topn.top_n_per_group(df, "s", "h", F.col("c"), 3).count() == 0
    with pytest.raises(ValueError, match="positive"):
        topn.top_n_per_group(df, "s", "h", F.col("c"), 0)
