import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haplolake.llm import quantiles as q


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40), min_size=1, max_size=50), min_size=1, max_size=6), st.sampled_from([0.0, 0.1, 0.5, 0.77, 1.0]))
def test_small_domains_stay_exact(parts, p):
    s = q.build(np.array(parts[0]))
    for part in parts[1:]:
        s = q.compress(q.merge(s, q.build(np.array(part))))
    value, error = q.quantile(s, p)
    assert error == 0
    assert value == pytest.approx(np.quantile(np.concatenate(parts), p))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bounds_hold_after_many_merges(seed):
    r = np.random.default_rng(seed)
    parts = [r.normal(size=r.integers(500, 3000)) * 10 for _ in range(40)]
    level = [q.compress(q.build(p), 200) for p in parts]
    while len(level) > 1:
        level = [q.compress(q.merge(*pair), 200) if len(pair) == 2 else pair[0] for pair in (level[k : k + 2] for k in range(0, len(level), 2))]
    (s,) = level
    everything = np.sort(np.concatenate(parts))
    assert s[2][-1] == everything.size
    below = np.searchsorted(everything, s[0], "left")
    upto = np.searchsorted(everything, s[0], "right")
    assert (s[1] <= below).all()
    assert (s[2] >= upto).all()
    for p in (0.01, 0.25, 0.5, 0.9):
        value, error = q.quantile(s, p)
        rank = p * (everything.size - 1) + 1
        assert abs(np.searchsorted(everything, value, "right") - rank) <= error + 1
        assert error <= 0.05 * everything.size
    assert s[0].size <= 202


def test_identity_range_and_null(spark):
    rows = [(1, 1, [10, 20, 30], 0, 0), (1, 1, [10, 20, 30], 1, 1), (1, 2, [99, None, -1, 40], 0, 0), (1, 3, [], 0, 0), (1, 4, None, 0, 0), (2, 5, [7], 0, 0), (None, 6, [8], 0, 0), (3, 7, [70], 0, 0)]
    df = spark.createDataFrame(rows, "run long, id long, q array<smallint>, n int, v int")
    found = q.percentiles(q.combine(q.summarise(df, ["run"], "q", identity=["id"], low=0, high=60), ["run"]), ["run"], {"q50": 0.5}).collect()
    assert {r["run"]: (r["n"], r["q50"]) for r in found} == {1: (4, 25.0), 2: (1, 7.0), None: (1, 8.0)}
    with pytest.raises(ValueError, match="named"):
        q.summarise(df, ["v"], "q")


def test_days_combine_and_empty(spark):
    r = np.random.default_rng(0)
    rows = [(int(k % 3), int(k % 5), [float(x) for x in r.normal(size=20)]) for k in range(200)]
    df = spark.createDataFrame(rows, "run long, day long, x array<double>")
    days = q.combine(q.summarise(df, ["run", "day"], "x", capacity=50), ["run", "day"], capacity=50)
    found = q.percentiles(q.combine(days, ["run"], capacity=50), ["run"], {"m": 0.5}).collect()
    for row in found:
        values = np.sort(np.concatenate([x for run, _, x in rows if run == row["run"]]))
        rank = 0.5 * (values.size - 1) + 1
        assert abs(np.searchsorted(values, row["m"], "right") - rank) <= row["rank_error"] + 1
    assert q.combine(q.summarise(df.limit(0), ["run"], "x"), ["run"]).count() == 0


def test_summaries_passed_on_early_are_the_same(spark):
    rows = [(k % 37, k, [float(k % 5), float(k % 11)]) for k in range(600)]
    df = spark.createDataFrame(rows, "g long, r long, v array<double>").repartition(3)
    whole = q.percentiles(q.combine(q.summarise(df, ["g"], "v", identity=["r"]), ["g"]), ["g"], {"m": 0.5})
    early = q.percentiles(q.combine(q.summarise(df, ["g"], "v", identity=["r"], held=3), ["g"], held=3), ["g"], {"m": 0.5})
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, whole.collect()))
