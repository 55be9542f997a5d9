import itertools
import random
from collections import Counter, defaultdict

import pytest

from haplolake.llm import pairs

SCHEMA = "p string, s string, h string, n_ab int, _a int"


def brute(rows, min_count, min_lift):
    base = {r[:3] for r in rows if None not in r[:3]}
    baskets = defaultdict(set)
    for p, s, h in base:
        baskets[p, s].add(h)
    n, single, both = Counter(), Counter(), Counter()
    for (p, _), items in baskets.items():
        n[p] += 1
        single.update((p, h) for h in items)
        both.update((p, a, b) for a, b in itertools.combinations(sorted(items), 2))
    return {(p, a, b, c) for (p, a, b), c in both.items() if c >= min_count and c * n[p] >= min_lift * single[p, a] * single[p, b]}


@pytest.mark.parametrize(("min_count", "min_lift", "block"), [(1, 0, 2048), (3, 1, 2048), (2, 0, 4), (1, 0, 2)])
def test_against_brute_force(spark, min_count, min_lift, block):
    r = random.Random(min_count)
    rows = [(r.choice("PQ"), f"s{r.randint(0, 25)}", f"h{r.randint(0, 30)}", 1, 2) for _ in range(900)]
    # one basket with everything, repeated rows, nulls
    rows += [("P", "control", f"h{k}", 1, 2) for k in range(31)] + rows[:50] + [(None, "s1", "h1", 1, 1), ("P", None, "h1", 1, 1), ("P", "s1", None, 1, 1), ("P", "s1", "", 1, 1)]
    found = pairs.cooccurring_pairs(spark.createDataFrame(rows, SCHEMA), "p", "s", "h", min_count=min_count, min_lift=min_lift, block=block).collect()
    assert len(found) == len({(x["p"], x["item_a"], x["item_b"]) for x in found})
    assert {(x["p"], x["item_a"], x["item_b"], x["n_ab"]) for x in found} == brute(rows, min_count, min_lift)


def test_ratio_and_empty(spark):
    rows = [("p", f"s{k}", h, 0, 0) for k in range(4) for h in ("a", "b")] + [("p", "s9", "c", 0, 0)]
    (x,) = pairs.cooccurring_pairs(spark.createDataFrame(rows, SCHEMA), "p", "s", "h", min_count=2).collect()
    assert (x["n_ab"], x["n_a"], x["n_b"], x["n"], x["lift"]) == (4, 4, 4, 5, 1.25)
    assert x["odds_ratio"] == pytest.approx(4.5 * 1.5 / (0.5 * 0.5))
    assert pairs.cooccurring_pairs(spark.createDataFrame([], SCHEMA), "p", "s", "h").count() == 0
    with pytest.raises(ValueError, match="min_count"):
        pairs.cooccurring_pairs(spark.createDataFrame([], SCHEMA), "p", "s", "h", min_count=0)


def test_a_block_without_items(spark):
    # three items in two blocks of two: for some choices of items one block is empty
    choices = list(itertools.combinations("abcdefg", 3))
    rows = [("".join(names), "s", h, 0, 0) for names in choices for h in names]
    found = pairs.cooccurring_pairs(spark.createDataFrame(rows, SCHEMA), "p", "s", "h", block=2).collect()
    assert sorted((x["p"], x["item_a"], x["item_b"], x["n_ab"]) for x in found) == sorted(("".join(n), a, b, 1) for n in choices for a, b in itertools.combinations(n, 2))
