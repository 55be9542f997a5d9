import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from haplolake.llm import packing as p

VOCABULARY = {"vocabulary": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=120))
def test_no_container_overflows(sizes):
    sizes = np.sort(np.array(sizes))[::-1]
    bins = p.assign(sizes, 50)
    used = np.bincount(bins, weights=sizes)
    assert used.max() <= 50
    assert (used > 0).all() or used.size == -(-sizes.sum() // 50)


def test_fill_is_high():
    sizes = np.sort(np.minimum(np.random.default_rng(0).lognormal(5.5, 0.9, 5000).astype(int) + 1, 2048))[::-1].copy()
    bins = p.assign(sizes, 2048)
    assert sizes.sum() / (np.unique(bins).size * 2048) > 0.985


def test_whole_and_divided_items(spark):
    rows = [(1, 100), (2, 5000), (3, 0), (4, None), (5, 2048), (6, 1), (6, 1), (7, 2049)]
    found = p.pack_items(spark.createDataFrame(rows, "id long, tokens long"), 2048, group_tokens=4000).collect()
    parts = sorted((r["id"], r["part"], r["tokens"]) for r in found)
    assert parts == [(1, 0, 100), (2, 0, 2048), (2, 1, 2048), (2, 2, 904), (3, 0, 0), (4, 0, 0), (5, 0, 2048), (6, 0, 1), (6, 0, 1), (7, 0, 2048), (7, 1, 1)]
    used = {}
    for r in found:
        assert (r["container"] is None) == (r["tokens"] == 0)
        used[r["container"]] = used.get(r["container"], 0) + r["tokens"]
    assert max(used.values()) <= 2048


def test_tokens_of_whole_texts(spark):
    text = "Order, order! " * 9000
    rows = [(1, "Hello world"), (2, ""), (3, None), (4, text), (None, "x")]
    got = {r["id"]: r["tokens"] for r in p.token_counts(spark.createDataFrame(rows, "id long, tokens string"), "id", "tokens", **VOCABULARY).collect()}
    assert got[1] == 2
    assert got[2] == got[3] == 0
    assert got[4] > 27_000
    assert set(got) == {1, 2, 3, 4}


def test_empty_and_wrong(spark):
    df = spark.createDataFrame([], "id long, tokens long")
    assert p.pack_items(df, 10).count() == 0
    assert p.fill_report(p.pack_items(df, 10), 10).first()["containers"] == 0
    with pytest.raises(ValueError, match="positive"):
        p.pack_items(df, 0)
