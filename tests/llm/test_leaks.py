import random

import numpy as np
import pyarrow as pa
import pytest

from haplolake.llm import leaks

R = random.Random(4)
VOCABULARY = [f"word{k}" for k in range(400)] + ["the", "of", "and", "to"] * 60


def passage(n, r=R):
    return [r.choice(VOCABULARY) for _ in range(n)]


ITEMS = {k: passage(R.randint(45, 160)) for k in range(30)}


def spoil(words, r=R):
    """Case, punctuation, a changed word in twenty, a divided word, something put in between."""
    out = [w.upper() if r.random() < 0.2 else w + r.choice(["", "", ",", "."]) for w in words]
    for k in range(len(out)):
        if r.random() < 0.05:
            out[k] = "changed"
    at = r.randrange(1, len(out))
    out[at] = out[at][:2] + "-\n" + out[at][2:] if len(out[at]) > 4 and out[at].isalnum() else out[at]
    middle = r.randrange(len(out))
    return out[:middle] + (["[", "Hear,", "hear", "]", *passage(12, r)] if r.random() < 0.5 else []) + out[middle:]


def corpus():
    docs, truth = [], set()
    for d in range(240):
        words = passage(R.randint(0, 500))
        if d % 4 == 0:
            item = R.randrange(30)
            size = len(ITEMS[item])
            share = R.choice([1.0, 1.0, 0.8, 0.7])
            a = R.randrange(size - int(size * share) + 1)
            at = R.randrange(len(words) + 1)
            words = words[:at] + spoil(ITEMS[item][a : a + int(size * share)]) + words[at:]
            truth.add((d, item))
        elif d % 4 == 1:  # a short quotation is no case
            item = R.randrange(30)
            words += ITEMS[item][: len(ITEMS[item]) // 4]
        docs.append((d, " ".join(words)))
    return docs, truth


def test_passages_are_found(spark):
    docs, truth = corpus()
    df = spark.createDataFrame([*docs, (900, None), (901, ""), (None, " ".join(ITEMS[0]))], "doc_id long, text string").withColumnRenamed("text", "item_id")
    items = spark.createDataFrame([(k, " ".join(w)) for k, w in ITEMS.items()] + [(77, None), (78, ""), (79, "so short")], "item_id long, text string")
    found = leaks.find_leaks(df, "doc_id", "item_id", items, "item_id", "text")
    got = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert len(got - truth) == 0
    assert len(got & truth) >= 0.97 * len(truth)
    # the same with the index in several files
    blocks = leaks.find_leaks(df, "doc_id", "item_id", items, "item_id", "text", file_words=300)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == got


def test_embedding_turns_edits_into_few_differences():
    r = np.random.default_rng(1)
    a = r.integers(1, 2**63, 400, dtype=np.uint64)
    b = np.concatenate((a[:150], a[151:300], r.integers(1, 2**63, 1, dtype=np.uint64), a[300:]))
    steps = np.arange(leaks.SCALES[-1][1])
    a, b = np.append(a, np.uint64(0)), np.append(b, np.uint64(0))
    ha, hb = (leaks.cgk_hashes(x, leaks.steer(x, 0), [steps])[0][0] for x in (a, b))
    assert (ha[:118] == hb[:118]).all()
    assert np.isin(hb[150:265], ha).all()


def recall(n, every, share=1.0, count=100):
    """Share of found items of n random words, one in ``every`` replaced, each in a document of 160 other words."""
    r = random.Random(n)
    words = [f"w{k}" for k in range(20_000)]
    items = [[r.choice(words) for _ in range(n)] for _ in range(count)]
    docs = []
    for item in items:
        size = -(-int(n * share * 100) // 100)
        at = r.randrange(n - size + 1)
        part = item[at : at + size]
        for c in r.sample(range(size), max(round(size / every), 1) if every else 0):
            part[c] = r.choice(words)
        docs.append(" ".join([*(r.choice(words) for _ in range(80)), *part, *(r.choice(words) for _ in range(80))]))
    rows, found, _ = leaks.find_in_batch([leaks.Items.build(list(range(count)), [" ".join(w) for w in items])], pa.array(docs))
    return len(set(zip(rows, found, strict=True)) & {(k, k) for k in range(count)}) / count


@pytest.mark.parametrize("n", [1, 2, 3, 5, 7, 8, 10, 12, 16, 20, 24, 32, 48, 64, 108, 170])
def test_recall_by_length(n):
    assert recall(n, 0) == 1
    if n >= 8:
        assert recall(n, 0, 0.51) >= 0.95
        assert recall(n, 8) >= 0.9
    if n >= 32:
        assert recall(n, 5) >= 0.8


def test_words_in_order_need_runs():
    places = leaks.Items.build([1], ["a b c d e f g h i j k l"]).grams(0)[1]
    symbols = leaks._Texts(pa.array(["x a b c y f g h z i q k l"])).symbols
    assert leaks.words_in_order(places, 12, leaks.runs_of(symbols, 3).tolist(), 3).tolist() == [0, 1, 2, 5, 6, 7]
    assert leaks.words_in_order(places, 12, [], 3).size == 0


def test_shared_formulas_and_far_parts_are_no_passage():
    item = [f"i{k}" for k in range(60)]
    filler = lambda n: [f"f{R.random()}" for _ in range(n)]
    # every second run of three is there, but half of the words between are not
    formulas = [w for k in range(0, 60, 6) for w in (*item[k : k + 3], *filler(3))]
    apart = [*item[:20], *filler(400), *item[20:40], *filler(400)]
    near = [*item[:20], *filler(30), *item[20:40]]
    rows, _, share = leaks.find_in_batch([leaks.Items.build([5], [" ".join(item)])], pa.array([" ".join(x) for x in (formulas, apart, near)]))
    assert rows == [2]
    assert share[0] == pytest.approx(2 / 3)


def test_long_text_and_empty_tables(spark):
    long = " ".join(passage(60_000)) + " " + " ".join(ITEMS[3])
    index = leaks.Items.build([3], [" ".join(ITEMS[3])])
    assert leaks.find_in_batch([index], pa.array([long, None, ""])) == ([0], [3], [1.0])
    docs, items = spark.createDataFrame([], "d long, t string"), spark.createDataFrame([], "i long, t string")
    assert leaks.find_leaks(docs, "d", "t", items, "i", "t").count() == 0
    assert leaks.find_leaks(docs, "d", "t", spark.createDataFrame([(1, "a b c d"), (2, "...")], "i long, t string"), "i", "t").count() == 0
