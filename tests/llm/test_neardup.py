import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from haplolake.llm import neardup as nd

R = random.Random(5)


def dna(n, r=R):
    return "".join(r.choice("ACGT") for _ in range(n))


def edited(s, k, r=R):
    out = list(s)
    for _ in range(k):
        at = r.randrange(len(out))
        out[at] = r.choice(["A", "C", "G", "T", "", out[at] + r.choice("ACGT")])
    return "".join(out)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances_of_many_pairs():
    left = ["", "A", "ACGT", *(dna(R.randint(0, 270)) for _ in range(40))]
    right = ["", "", "TTTTT", *(edited(a, 9) if a else "C" for a in left[3:])]
    assert nd.edit_distances(left, right).tolist() == [levenshtein(a, b) for a, b in zip(left, right, strict=True)]


def test_moved_stretch_is_near():
    a = dna(200)
    moved = a[:30] + a[90:140] + a[30:90] + a[140:]
    other = dna(200)
    half = a[:110] + dna(90)
    assert nd.near([a, a, a, moved], [edited(moved, 6), other, half, edited(a, 5)]).tolist() == [True, False, False, True]


def table(spark, r):
    primer, tail, inner = dna(18, r), dna(18, r), dna(12, r)
    rows, k = [], 0
    for block in ("one", "two"):
        for _ in range(260):
            body = dna(r.randint(100, 170), r)
            s = primer + body[:50] + inner + body[50:] + tail
            family = [s]
            if r.random() < 0.2:
                family += [edited(s, r.randint(1, 7), r) for _ in range(r.randint(1, 3))]
                family.append(s[:40] + s[80:120] + s[40:80] + s[120:])
            if r.random() < 0.1:
                family += [s.lower()] * 3
            for x in family:
                rows.append((k, block, x, "z"))
                k += 1
    rows += [(k, "one", None, "z"), (k + 1, None, "ACGT", "z"), (None, "one", "ACGT", "z"), (k + 2, "one", "", "z"), (k + 3, "one", "", "z"), (k + 4, "one", "NNNACGT", "z")]
    return rows


def test_all_near_pairs_are_found(spark):
    rows = table(spark, random.Random(11))
    df = spark.createDataFrame(rows, "id long, t string, s string, rep string")
    members, links = nd.near_pairs(df, "id", "t", "s")
    got = {tuple(x) for x in nd.expand(members, links).collect()}
    real = [(i, t, s.upper()) for i, t, s, _ in rows if None not in (i, t, s)]
    close = [(a, b) for a, b in itertools.combinations(real, 2) if a[1] == b[1] and abs(len(a[2]) - len(b[2])) <= 20]
    ok = nd.near([a[2] for a, _ in close], [b[2] for _, b in close])
    want = {(min(a[0], b[0]), max(a[0], b[0])) for (a, b), k in zip(close, ok, strict=True) if k}
    assert got <= want
    assert len(got) >= 0.985 * len(want)
    classes = {r["id"]: r["class"] for r in nd.near_classes(df, "id", "t", "s").collect()}
    assert all(classes[a] == classes[b] for a, b in got)
    assert all(c <= i for i, c in classes.items())


@pytest.mark.parametrize("large", [3])
def test_hot_buckets_lose_nothing(spark, large):
    r = random.Random(2)
    base = dna(180, r)
    rows = [(k, "t", edited(base, 3, r)) for k in range(60)] + [(100 + k, "t", dna(180, r)) for k in range(30)]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    _, links = nd.near_pairs(df, "id", "t", "s", large=large)
    text = dict((i, s) for i, _, s in rows)
    pairs = list(itertools.combinations(sorted(text), 2))
    ok = nd.near([text[a] for a, _ in pairs], [text[b] for _, b in pairs])
    want = {p for p, k in zip(pairs, ok, strict=True) if k}
    got = {(x["a"], x["b"]) for x in links.collect()}
    assert got <= want
    assert len(got) >= 0.99 * len(want)


def test_components_and_empty(spark):
    edges = [(k, k + 1) for k in range(1, 40)] + [(100, 101), (100, 102), (7, 7)]
    found = {r["node"]: r["class"] for r in nd.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[k] for k in range(1, 41)} == {1}
    assert {found[k] for k in (100, 101, 102)} == {100}
    df = spark.createDataFrame([], "id long, t string, s string")
    members, links = nd.near_pairs(df, "id", "t", "s")
    assert nd.expand(members, links).count() == 0
    assert nd.near_classes(df, "id", "t", "s").count() == 0


def test_pairs_with_one_common_signature_that_is_hot(spark):
    r = random.Random(8)
    base = dna(180, r)
    rows = [(k, "t", edited(base, 7, r)) for k in range(70)]
    reps = spark.createDataFrame(rows, "rep long, block string, seq string").withColumn("common", F.lit(None).cast("array<long>"))
    signs: dict = {}
    for x in reps.mapInArrow(nd._sign(nd.PARTS), "sig long, rep long, len int, salt int").collect():
        signs.setdefault(x["sig"], set()).add(x["rep"])
    text = {k: s for k, _, s in rows}
    pairs = list(itertools.combinations(range(70), 2))
    ok = nd.near([text[a] for a, _ in pairs], [text[b] for _, b in pairs])
    real = {p for p, k in zip(pairs, ok, strict=True) if k}
    shared: dict = {}
    for sig, members in signs.items():
        for p in itertools.combinations(sorted(members), 2):
            shared.setdefault(p, []).append(sig)
    once = {p for p, sigs in shared.items() if p in real and len(sigs) == 1 and len(signs[sigs[0]]) > 3}
    assert len(once) > 5
    for block in (2000, 10):
        got = {(x["a"], x["b"]) for x in nd.candidate_pairs(reps, large=3, block=block).collect()}
        assert real & set(shared) <= got


def test_moves_against_brute_force():
    r = random.Random(21)
    left, right = [], []
    for n in (14, 26, 38):
        for k in range(14):
            a = dna(n, r)
            x, y, z = sorted(r.sample(range(n + 1), 3))
            moved = a[:x] + a[y:z] + a[x:y] + a[z:]
            left.append(a)
            right.append(edited(moved, n * 8 // 100 + k % 3, r))
    want = []
    for a, b in zip(left, right, strict=True):
        n, allowed = len(a), max(len(a), len(b)) * 8 // 100
        versions = {a} | {a[:x] + a[y:z] + a[x:y] + a[z:] for x, y, z in itertools.combinations(range(n + 1), 3)}
        want.append(bool((nd.edit_distances(list(versions), [b] * len(versions)) <= allowed).any()))
    assert 10 < sum(want) < len(want)
    assert nd.near(left, right).tolist() == want


def test_moved_stretch_with_as_many_edits_as_permitted():
    r = random.Random(22)
    left, right = [], []
    for n in (150, 180, 220):
        for m in (20, 35, 50):
            a = dna(n, r)
            x, t = 20 + r.randrange(20), 30 + r.randrange(20)
            moved = a[:x] + a[x + m : x + m + t] + a[x : x + m] + a[x + m + t :]
            out = list(moved)
            for at in r.sample(range(n), n * 8 // 100):
                out[at] = r.choice([c for c in "ACGT" if c != out[at]])
            left.append(a)
            right.append("".join(out))
    assert nd.near(left, right).all()
    assert nd.near(right, left).all()


@pytest.mark.parametrize(("n", "edits"), [(20, 1), (30, 2), (40, 3), (60, 4), (63, 5), (66, 5), (100, 8)])
def test_recall_on_short_texts(spark, n, edits):
    r = random.Random(n)
    rows, want = [], set()
    for k in range(200):
        a = dna(n, r)
        rows += [(2 * k, "t", a), (2 * k + 1, "t", edited(a, edits, r))]
    text = {i: s for i, _, s in rows}
    for k in range(200):
        if nd.near([text[2 * k]], [text[2 * k + 1]])[0]:
            want.add((2 * k, 2 * k + 1))
    found = nd.expand(*nd.near_pairs(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s"))
    got = {(x["id_a"], x["id_b"]) for x in found.collect()}
    assert len(got & want) >= 0.95 * len(want)


def test_other_scripts():
    assert nd.edit_distances(["\u4f60\u597d\u4e16\u754c", "naïve", "a\U0001f600b"], ["\u518d\u89c1\u670b\u53cb", "naive", "ab"]).tolist() == [4, 1, 1]
    r = random.Random(3)
    left = ["".join(chr(0x4E00 + r.randrange(3000)) for _ in range(r.randint(1, 90))) for _ in range(40)]
    right = [t[: len(t) // 2] + t[len(t) // 2 + 1 :] for t in left]
    assert nd.edit_distances(left, right).tolist() == [1] * 40
    assert nd.edit_distances(left[:-1], left[1:]).tolist() == [levenshtein(a, b) for a, b in itertools.pairwise(left)]


def test_other_scripts_are_found(spark):
    r = random.Random(6)
    alphabet = "абвгдежзиклмнопрстуфхцчшщэюя"
    rows = []
    for k in range(60):
        a = "".join(r.choice(alphabet) for _ in range(150))
        rows += [(2 * k, "t", a), (2 * k + 1, "t", a[:70] + "ё" + a[71:100] + a[103:])]
    for large in (200, 3):
        _, links = nd.near_pairs(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s", large=large)
        assert {(x["a"], x["b"]) for x in links.collect()} == {(2 * k, 2 * k + 1) for k in range(60)}


def test_signature_hot_in_one_batch_is_salted(spark):
    r = random.Random(12)
    base = dna(180, r)
    texts = list({edited(base, 4, r) for _ in range(900)})
    rows = [(k, "t", t) for k, t in enumerate(texts)]
    reps = spark.createDataFrame(rows, "rep long, block string, seq string").withColumn("common", F.lit(None).cast("array<long>")).repartition(2)
    signed = reps.mapInArrow(nd._sign(nd.PARTS), "sig long, rep long, len int, salt int")
    assert signed.where("salt > 0").count() > 0
    assert signed.where("rep < 0").select("salt").distinct().collect()[0][0] == 0
    some = random.Random(1).sample(range(len(texts)), 120)
    pairs = list(itertools.combinations(sorted(some), 2))
    ok = nd.near([texts[a] for a, _ in pairs], [texts[b] for _, b in pairs])
    got = {(x["a"], x["b"]) for x in nd.candidate_pairs(reps, block=100).collect()}
    missed = [p for p, k in zip(pairs, ok, strict=True) if k and p not in got]
    assert len(missed) <= 0.01 * len(pairs)


def test_copies_are_counted(spark):
    s = dna(120)
    df = spark.createDataFrame([(5, "t", s), (7, "t", s.lower()), (9, "t", s[:60] + "A" + s[60:]), (11, "t", dna(120)), (12, None, s)], "id long, t string, s string")
    got = {r["id"]: (r["class"], r["links"], r["copies"]) for r in nd.near_classes(df, "id", "t", "s").collect()}
    assert got == {5: (5, 1, 2), 7: (5, 1, 2), 9: (5, 1, 1), 11: (11, 0, 1), 12: (12, 0, 1)}


def test_pairs_do_not_depend_on_the_other_texts_of_a_block(spark):
    r = random.Random(31)
    front, back = dna(60, r), dna(60, r)
    rows = []
    for k in range(8):  # all edits lie between the stretches that the block shares
        body = dna(50, r)
        other = list(body)
        for at in range(1, 50, 4):
            other[at] = r.choice([c for c in "ACGT" if c != other[at]])
        rows += [(2 * k, "t", front + body + back), (2 * k + 1, "t", front + "".join(other) + back)]
    more = [(100 + k, "t", front + dna(r.randint(150, 200), r) + back) for k in range(300)]
    want = {(2 * k, 2 * k + 1) for k in range(8)}
    for table in (rows, rows + more):
        _, links = nd.near_pairs(spark.createDataFrame(table, "id long, t string, s string"), "id", "t", "s")
        assert {(x["a"], x["b"]) for x in links.collect()} == want


@pytest.mark.parametrize(("large", "block"), [(3, 2000), (3, 7), (200, 2000)])
def test_candidates_share_a_signature_however_hot(spark, large, block):
    r = random.Random(32)
    front, base = dna(40, r), dna(120, r)
    texts = [front + dna(r.randint(100, 140), r) for _ in range(60)] + [front + edited(base, 6, r) for _ in range(30)]
    rows = [(k - 75, "t", t) for k, t in enumerate(texts)]  # ids below 0 too
    reps = spark.createDataFrame(rows, "rep long, block string, seq string").withColumn("common", F.lit(None).cast("array<long>"))
    signs: dict = {}
    for x in reps.mapInArrow(nd._sign(nd.PARTS, 10**6), "sig long, rep long, len int, salt int").collect():
        signs.setdefault(x["sig"], set()).add(x["rep"])
    shared = {p for members in signs.values() for p in itertools.combinations(sorted(members), 2)}
    text = {k: s for k, _, s in rows}
    pairs = sorted(shared)
    real = {p for p, k in zip(pairs, nd.near([text[a] for a, _ in pairs], [text[b] for _, b in pairs]), strict=True) if k}
    got = {(x["a"], x["b"]) for x in nd.candidate_pairs(reps, large=large, block=block).collect()}
    assert len(real) > 300
    assert real <= got <= shared


def test_pairs_without_a_common_signature_are_found(spark):
    r = random.Random(41)
    rows = []
    for k in range(20):  # edits so close that no feature is left
        a = dna(150, r)
        other = list(a)
        for at in range(6, 150, 12):
            other[at] = r.choice([c for c in "ACGT" if c != a[at]])
        rows += [(2 * k, "t", a), (2 * k + 1, "t", "".join(other))]
    _, links = nd.near_pairs(spark.createDataFrame(rows, "id long, t string, s string"), "id", "t", "s")
    assert {(x["a"], x["b"]) for x in links.collect()} == {(2 * k, 2 * k + 1) for k in range(20)}


def test_whole_blocks_against_brute_force(spark):
    r = random.Random(42)
    front, rows, k = dna(20, r), [], -50
    for block in ("one", "two"):
        for n in (0, 1, 9, 38, 130, 200):
            for _ in range(2):
                a = front[:n] + dna(max(n - 20, 0), r)
                x, y, z = sorted(r.sample(range(n + 3), 3))
                moved = a[:x] + a[y:z] + a[x:y] + a[z:]
                for s in (a, edited(a, n * 8 // 100, r) if a else a, edited(moved, n * 4 // 100, r) if moved else a, a.replace("GA", "Nй")):
                    rows.append((k, block, s))
                    k += 1
    rows += [(k, "one", "AAAA" + front * 3), (k, "one", front * 5), (k + 1, "one", front * 5 + "C"), (k + 2, "three", front), (k + 3, "none", None)]
    df = spark.createDataFrame(rows, "id long, t string, s string")
    reps: dict = {}
    for i, t, s in rows:
        if s is not None:
            reps[t, s.upper()] = min(i, reps.get((t, s.upper()), i))
    pairs = [(x, y) for x, y in itertools.combinations(reps, 2) if x[0] == y[0] and 100 * abs(len(x[1]) - len(y[1])) <= 8 * max(len(x[1]), len(y[1]))]
    ok = nd.near([x[1] for x, _ in pairs], [y[1] for _, y in pairs])
    want = {tuple(sorted((reps[x], reps[y]))) for (x, y), near in zip(pairs, ok, strict=True) if near and reps[x] != reps[y]}
    assert len(want) > 30
    for piece in (None, 700):
        got = [(x["a"], x["b"]) for x in nd.near_pairs(df, "id", "t", "s", piece=piece)[1].collect()]
        assert len(got) == len(set(got))
        assert set(got) == want


def test_sieve_is_never_false_for_near_texts_of_any_length():
    r = random.Random(43)
    texts = []
    for n in (5, 13, 25, 38, 39, 41, 130, 220, 399, 405, 1450, 1600, 5100):
        for _ in range(2):
            a = dna(n, r)
            x, y, z = sorted(r.sample(range(n + 1), 3))
            moved = a[:x] + a[y:z] + a[x:y] + a[z:]
            out = list(moved)
            for at in r.sample(range(n), n * 8 // 100):
                out[at] = r.choice("ACGTN")
            texts.append((a, "".join(out)))
    flat = sorted((t, k) for k, pair in enumerate(texts) for t in pair)
    flat.sort(key=lambda x: len(x[0]))
    size = np.array([len(t) for t, _ in flat])
    zero = np.zeros(size.size, np.int64)
    passed = {tuple(sorted((int(i), int(j)))) for some in nd._sieved(pa.array([t for t, _ in flat]), size, *nd._windows(zero, zero, size)) for i, j in zip(*some, strict=True)}
    twins = {(i, j) for i, j in itertools.combinations(range(len(flat)), 2) if flat[i][1] == flat[j][1]}
    assert twins <= passed


def test_few_unrelated_texts_with_common_primers_pass_the_sieve():
    r = random.Random(44)
    front, inner, back = dna(18, r), dna(12, r), dna(18, r)
    texts = pa.array([front + dna(46, r) + inner + dna(46, r) + back for _ in range(300)])
    q, number = nd.SHARED_GRAMS[0]
    words, bits = nd._gram_bits(texts, q, number)
    i, j = np.triu_indices(300, 1)
    passed = nd._may_be_near(words[:, i], words[:, j], np.maximum(bits[i], bits[j]), np.full(i.size, 140), q)
    assert passed.mean() < 0.01
