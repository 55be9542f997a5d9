import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from haplolake.operators import barcodes, collapse, matching, mixtures, reads, samples, stitch, variants

R = random.Random(9)


def dna(n):
    return "".join(R.choice("ACGT") for _ in range(n))


READS = "id long, run string, s string, q array<smallint>, n double"


def test_cascade_puts_every_row_in_one_case(spark):
    rows = [(k, "r", R.choice([None, "", "ACGT" * 5, "ACNT" * 5, "acgtn", "A" * 90]), R.choice([None, [], [40] * 20, [10] * 20]), 1.0) for k in range(200)]
    df = spark.createDataFrame(rows, READS).withColumn("case", reads.single_end_case("s", "q", F.lit(10), F.lit(50)))
    (c,) = reads.case_counts(df, ["run"]).collect()
    assert c["total"] == 200 == sum(c[x.lower()] for x in reads.CASES)
    assert df.where("s = '' and case != 'MINLENBAD'").count() == 0
    assert reads.case_counts(df.limit(0), ["run"]).count() == 0


def test_dereplicate_keeps_counts(spark):
    rows = [(k, "r", R.choice(["ACGT", "acgt", "GG", None]), None, R.choice([1.0, 2.0, None])) for k in range(100)] + [(None, "r", "GG", None, 1.0)]
    df = spark.createDataFrame(rows, READS)
    found = {r["seq"]: r for r in reads.dereplicate(df, ["run"], "s", "n", "id").collect()}
    assert set(found) == {"ACGT", "GG"}
    assert sum(r["cnt"] for r in found.values()) == sum(n or 0 for _, _, s, _, n in rows if s)


def test_consensus_names_modes(spark):
    df = spark.createDataFrame([(1, "r", "AC", [10, 99], 1.0), (2, "r", "AC", [20, 30], 1.0), (3, "r", "AC", None, 1.0)], READS)
    assert {r["pos"]: (r["q"], r["n"]) for r in reads.quality_consensus(df, ["run"], "q", "average").collect()} == {0: (15.0, 2), 1: (30.0, 1)}
    with pytest.raises(ValueError, match="none of"):
        reads.quality_consensus(df, ["run"], "q", "mode")
    named = reads.number_repeated_names(df, "run", "id").collect()
    assert sorted(r["unique_name"] for r in named) == ["r", "r.1", "r.2"]
    low = reads.remove_low_quality(df, "s", "q", 15).orderBy("id").collect()
    assert [(r["s"], r["q"]) for r in low] == [("C", [99]), ("AC", [20, 30]), ("AC", None)]


def test_demultiplex_outcomes(spark):
    mids = spark.createDataFrame([("m1", "AAAACCCC"), ("m2", "GGGGTTTT"), ("m3", "AAAACCGG"), ("m4", None), ("m5", "")], "mid string, code string")
    rows = [(1, "AAAACCCCTTTTTT"), (2, "TGGGGTTTTAAAA"), (3, "GGGGTTATAAAA"), (4, "CCCCCCCCCCCC"), (5, None), (6, "AAAACCCGTTTT"), (7, ""), (8, "aaaacccctt")]
    df = spark.createDataFrame(rows, "id long, s string")
    found = {r["id"]: (r["mid"], r["outcome"], r["errors"], r["offset"]) for r in matching.demultiplex(df, "id", "s", mids, "mid", "code").collect()}
    assert found == {
        1: ("m1", "MATCH", 0, 0), 2: ("m2", "MATCH", 0, 1), 3: ("m2", "MATCH", 1, 0), 4: (None, "NO_MATCHING", None, None), 5: (None, "NO_MATCHING", None, None),
        6: (None, "AMBIGUOUS", 1, None), 7: (None, "NO_MATCHING", None, None), 8: ("m1", "MATCH", 0, 0),
    }


@pytest.mark.parametrize("broadcast", [10_000, 0])
def test_primers_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(matching, "BROADCAST_ROWS", broadcast)
    primers = {f"t{k}": dna(12) for k in range(6)}
    rows = []
    for k in range(120):
        p = list(primers[f"t{R.randrange(6)}"])
        for _ in range(R.randint(0, 4)):
            p[R.randrange(12)] = R.choice("ACGT")
        rows.append((k, dna(R.randint(0, 8)) + "".join(p) + dna(20)))
    df = spark.createDataFrame(rows, "id long, s string")
    got = {r["id"]: (r["matched"], r["errors"], r["offset"]) for r in matching.match_primers(df, "id", "s", spark.createDataFrame(list(primers.items()), "t string, p string"), "t", "p", errors=2, within=6).collect()}
    for k, s in rows:
        hits = [(sum(a != b for a, b in zip(p, s[o : o + 12], strict=True)), o, t) for t, p in primers.items() for o in range(7) if len(s) >= o + 12]
        best = min((h for h in hits if h[0] <= 2), default=None)
        assert got[k] == ((best[2], best[0], best[1]) if best else ("unrecognized", None, None))


def test_overlaps_against_brute_force(spark):
    a = [(R.choice("xy"), s, s + R.randint(-2, 30)) for s in (R.randint(0, 200) for _ in range(80))]
    b = [(R.choice("xy"), s, s + R.randint(0, 90)) for s in (R.randint(0, 200) for _ in range(60))] + [("x", None, 4)]
    left = spark.createDataFrame(a, "k string, s long, e long")
    right = spark.createDataFrame(b, "k string, s2 long, e2 long")
    got = sorted(tuple(r) for r in matching.interval_overlaps(left, right, "k", "s", "e", "s2", "e2", 25).select("k", "s", "e", "s2", "e2").collect())
    want = sorted((k, s, e, s2, e2) for k, s, e in a for k2, s2, e2 in b if s2 is not None and k == k2 and s < e and s2 < e2 and s < e2 and s2 < e)
    assert got == want


def test_motifs_on_both_strands(spark):
    df = spark.createDataFrame([(1, "TTACGGATT" + "CCGTA" + "A"), (2, None), (3, "")], "id long, s string")
    hits = matching.motif_hits(df, "id", "s", spark.createDataFrame([("m", "TACGG")], "n string, m string"), "n", "m", 0).collect()
    assert sorted((r["strand"], r["start"], r["end"]) for r in hits) == [("+", 1, 6), ("-", 9, 14)]


def test_replicates_population_rescue(spark):
    rows = [("a", 1, "AC", 90.0), ("a", 1, "GG", 10.0), ("a", 2, "ac", 50.0), ("b", 1, "GG", 80.0), ("b", 1, "AC", 20.0), ("c", 1, None, 5.0), ("c", None, "AC", 5.0), ("c", 1, "AC", None)]
    df = spark.createDataFrame(rows, "s string, r int, seq string, cnt double")
    found = samples.replicate_fractions(df, ["s"], "r", "seq", "cnt")
    assert {(x["s"], x["seq"]): (round(x["avg_frac"], 6), x["rep_cnt"], x["reps"]) for x in found.collect()} == {("a", "AC"): (0.95, 2, 2), ("a", "GG"): (0.05, 1, 2), ("b", "GG"): (0.8, 1, 1), ("b", "AC"): (0.2, 1, 1)}
    kept = samples.by_fraction(samples.in_all_replicates(found), ["s"], 0.1)
    assert {(x["s"], round(x["f"], 9)) for x in kept.groupBy("s").agg(F.sum("avg_frac").alias("f")).collect()} == {("a", 1.0), ("b", 1.0)}
    pop = {x["seq"]: x for x in samples.population(found, ["s"], "p").collect()}
    assert pop["AC"]["h_popuid"] == "p.0"
    assert pop["GG"]["h_sampcnt"] == 2
    low = found.where("avg_frac < 0.1")
    assert [x["seq"] for x in samples.rescue(low, found, [], "seq", 0.5).collect()] == ["GG"]
    assert samples.population(found.limit(0), ["s"], "p").count() == 0


def test_one_off_pairs_against_brute_force(spark):
    base = dna(40)
    seqs = {base: 100.0, base[:5] + "A" + base[6:]: 3.0, base[:30] + base[31:]: 2.0, base + "C": 1.0, "T" + base: 1.5, dna(40): 9.0, base[:20] + dna(20): 4.0, "A": 1.0, "": 1.0}
    df = spark.createDataFrame([("s", k, v) for k, v in seqs.items()], "s string, seq string, avg_frac double")
    got = {(x["seq"], x["parent"]) for x in samples.one_off_pairs(df, ["s"]).collect()}

    def one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) - len(short) == 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    want = {(a, b) for a in seqs for b in seqs if len(a) > 1 and one(a, b) and seqs[a] * 10 < seqs[b]}
    assert got == want


def test_mixtures(spark):
    df = spark.createDataFrame([("m", "x", 3.0), ("m", "y", 1.0), ("m", "z", 0.0)], "mix string, strain string, a double")
    assert {r["strain"]: r["relative"] for r in mixtures.normalise(df, "mix", "strain", "a").collect()} == {"x": 0.75, "y": 0.25}
    for bad in ([("m", "x", -1.0)], [("m", "x", 0.0)], [("m", "x", 1.0), ("m", "x", 2.0)]):
        with pytest.raises(Exception, match="mixture m"):
            mixtures.normalise(spark.createDataFrame(bad, df.schema), "mix", "strain", "a").collect()
    obs = spark.createDataFrame([("s", "h1", 0.5), ("s", "h9", 0.5), ("t", "h9", 1.0)], "s string, h string, obs_frac double")
    exp = spark.createDataFrame([("s", "h1", 0.4), ("s", "h2", 0.6)], "s string, h string, exp_frac double")
    m = {r["s"]: r for r in mixtures.metrics(mixtures.compare(obs, exp, ["s"], "h"), ["s"]).collect()}
    assert (m["s"]["recovered"], m["s"]["false_haps"], m["s"]["missing"], m["s"]["recovery_rate"], m["s"]["rmse"]) == (1, 1, 1, 0.5, 0.1)
    assert m["t"]["recovery_rate"] is None
    assert m["t"]["rmse"] is None


def test_alignment_profile():
    assert collapse.align("ACGT", "ACGT")[2] == 8
    a, b, _ = collapse.align("ACGTACGTAC", "ACGTCGTAC")
    assert a == "ACGTACGTAC"
    assert b.count("-") == 1
    p = collapse.profile("ACGTACGTACGTACGT", "ACGTACGTACGTACGT".replace("T", "T"))
    assert p == collapse.Profile(1.0, 0, 0, 0, 0, 0)
    p = collapse.profile("AAAACCCCGGGGTTTT", "AAAACCCGGGGTTTTT"[:15] + "T")
    assert p.hq + p.indel1 >= 1
    low = collapse.profile("ACGT", "ACGA", [40, 40, 40, 10], [40, 40, 40, 40])
    assert (low.hq, low.lq) == (0, 1)


def test_collapse_invariants_and_protection():
    base = dna(60)
    off = base[:10] + ("A" if base[10] != "A" else "C") + base[11:]
    far = dna(60)
    rows = pd.DataFrame({"seq": [base, off, far], "cnt": [100.0, 2.0, 50.0], "qual": [None, None, None]})
    out = collapse.collapse_group(rows, [collapse.Round(100, 3, hq=1)])
    assert dict(zip(out["seq"], out["into"], strict=True)) == {base: base, off: base, far: far}
    assert out["cnt"].sum() == 152
    small = collapse.collapse_group(rows.assign(cnt=[3.0, 2.0, 1.0]), [collapse.Round(100, 3, hq=1)])
    assert (small["seq"] == small["into"]).all()
    strict = collapse.collapse_group(rows, [collapse.Round(100, 3)])
    assert (strict["seq"] == strict["into"]).all()
    rounds = collapse.read_rounds("stopCheck:smallCutoff:id\n100:3:.97\n100:0:.97\n")
    assert [r.identity for r in rounds] == [0.97, 0.97]
    with pytest.raises(ValueError, match="eight"):
        collapse.read_rounds("a:b\n1:2")


def test_collapse_and_chimeras_in_spark(spark):
    a, b = dna(50), dna(50)
    chi = a[:20] + b[20:]
    df = spark.createDataFrame([("s", a, 100.0), ("s", b, 90.0), ("s", chi, 5.0), ("s", None, 1.0), ("t", chi, 5.0)], "s string, seq string, cnt double")
    out = collapse.collapse(df, ["s"], "seq", "cnt", [collapse.Round(100, 3, hq=1)])
    assert out.agg(F.sum("cnt")).first()[0] == 200
    found = collapse.chimeras(df.where("seq is not null"), ["s"]).collect()
    assert [(r["s"], r["seq"], r["left_parent"], r["right_parent"]) for r in found] == [("s", chi, a, b)]
    assert collapse.spanning_edges(df.where("seq is not null"), ["s"]).count() == 2
    # the best left parent is the best right one too, yet another pair covers the sequence
    own = dna(60)
    other = lambda c: "A" if c != "A" else "C"
    p = own[:36] + other(own[36]) + own[30:]
    q = own[:30] + other(own[30]) + other(own[31]) + own[31:]
    far = spark.createDataFrame([("s", own, 1.0), ("s", p, 9.0), ("s", q, 9.0)], "s string, seq string, cnt double")
    assert [(r["seq"], r["left_parent"], r["right_parent"]) for r in collapse.chimeras(far, ["s"]).collect()] == [(own, p, q)]
    assert collapse.collapse(df.limit(0), ["s"], "seq", "cnt", []).count() == 0


Q = "TTACGGATCCAGTTGACCATGCAAGTCCGATTGCAGGCTA"


@pytest.mark.parametrize(
    ("r1", "r2", "status", "seq"),
    [
        (Q, Q, "PERFECTOVERLAP", Q),
        (Q[:25], Q[10:], "R1ENDSINR2", Q),
        (Q[10:], Q[:25], "R1BEGINSINR2", Q[10:25]),
        (Q[10:25], Q, "R1ALLINR2", Q[10:]),
        (Q, Q[10:25], "R2ALLINR1", Q[:25]),
        (Q[:14], Q[26:], "NOOVERLAP", None),
        (Q[:5], Q[:5], "NOOVERLAP", None),
    ],
)
def test_stitching_table(spark, r1, r2, status, seq):
    back = r2[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, r1, None, back, None)], "id long, r1 string, q1 array<smallint>, r2 string, q2 array<smallint>")
    (row,) = stitch.stitch(df, ["id"], "r1", "q1", "r2", "q2").collect()
    assert (row["status"], row["seq"]) == (status, seq)


def test_stitching_takes_the_better_base(spark):
    wrong = Q[:20] + ("A" if Q[20] != "A" else "C") + Q[21:25]
    back = Q[10:][::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, wrong, [40] * 20 + [5] + [40] * 4, back, [40] * 30), (2, None, None, back, None), (3, wrong, [1], back, [])], "id long, r1 string, q1 array<smallint>, r2 string, q2 array<smallint>")
    rows = {r["id"]: r for r in stitch.stitch(df, ["id"], "r1", "q1", "r2", "q2").collect()}
    assert (rows[1]["seq"], rows[1]["lq_mismatches"], rows[1]["overlap"]) == (Q, 1, 15)
    assert rows[2]["status"] == "NOOVERLAP"


def test_barcode_candidates(spark):
    rows = [("t", "AAAA")] * 200 + [("t", "AAAC")] * 6 + [("t", "GGGG")] * 8 + [("t", "CCCC")] * 2 + [("t", "")] * 9
    got = barcodes.candidates(spark.createDataFrame(rows, "target string, code string"), "target", "code").collect()
    assert {(r["barcode"], r["n"]) for r in got} == {("AAAA", 206), ("GGGG", 8)}


def test_translation(spark):
    assert len(variants.codon_table()) == 64
    df = spark.createDataFrame([("h", "ATGAAATGA", "ATGACATGA"), ("e", "", ""), ("n", None, "A")], "h string, s string, r string")
    assert {r["h"]: r["p"] for r in df.select("h", variants.translate(F.col("s")).alias("p")).collect()} == {"h": "MK*", "e": "", "n": None}
    changes = variants.amino_changes(df, ["h"], "s", "r")
    assert [tuple(r) for r in variants.typed(changes, ["h"]).collect()] == [("h", "T2K")]


def test_contamination_both_ways(spark, monkeypatch):
    refs = [("x", dna(40)), ("x", dna(40)), ("y", dna(40)), ("y", None)]
    rows = [(k, R.choice("xyz"), R.choice([None, "", "ACG", refs[0][1][:30] + dna(10), refs[2][1].lower(), dna(30)])) for k in range(60)]
    df, rf = spark.createDataFrame(rows, "id long, t string, s string"), spark.createDataFrame(refs, "t string, r string")
    grams = lambda s: {s[i : i + 5].upper() for i in range(len(s) - 4)}
    want = {}
    for k, t, s in rows:
        own = grams(s or "")
        best = max((len(own & grams(r)) for u, r in refs if u == t and r), default=0)
        if own and best and 2 * best >= len(own):
            want[k] = best
    for limit in (2000, 0):
        monkeypatch.setattr(matching, "BROADCAST_REFS", limit)
        assert {r["id"]: r["best"] for r in matching.kmer_screen(df, "id", "s", rf, "r", ["t"]).collect()} == want
        assert matching.kmer_screen(df, "id", "s", rf, "r", []).count() >= len(want)


def test_manifests(spark):
    from haplolake.operators import manifest

    files = [("/d/a_S1_L001_R1_001.fastq.gz", 5), ("/d/a_S1_L001_R2_001.fastq.gz", 5), ("/d/b_R1.fastq", 1), ("/d/c_1.fq", 0), ("/d/c_2.fq", 3), ("/d/notes.txt", 1)]
    pairs = {r["stub"]: r["problem"] for r in manifest.pair_files(spark.createDataFrame(files, "p string, n long"), "p", "n").collect()}
    assert pairs == {"a_S1_L001_001": None, "b": "no mate", "c": "empty"}
    stubs = spark.createDataFrame([("s1",), ("MIDs1",), ("s1_x",), ("zz",), ("s10",)], "stub string")
    names = spark.createDataFrame([("s1",), ("s10",), (None,)], "s string")
    got = {r["stub"]: (r["sample"], r["outcome"]) for r in manifest.match_files(stubs, "stub", names, "s", prefix=True).collect()}
    assert got == {"s1": ("s1", "matched"), "MIDs1": ("s1", "matched"), "s1_x": ("s1", "matched"), "zz": (None, "unknown"), "s10": ("s10", "matched")}
    assert {r["stub"] for r in manifest.match_files(stubs, "stub", names, "s").where("outcome = 'unknown'").collect()} == {"s1_x", "zz"}
    every = spark.createDataFrame([("t1",), ("t2",)], "t string")
    m = spark.createDataFrame([("i", "t1, t9"), ("j", None), ("k", "all")], "i string, ts string")
    assert sorted(map(tuple, manifest.targets_of_index(m, "i", "ts", every, "t").collect())) == [("i", "t1"), ("i", "t9"), ("j", "t1"), ("j", "t2"), ("k", "t1"), ("k", "t2")]
    p = spark.createDataFrame([("t", "ARn"), ("u", None)], "t string, p string")
    assert [r["seq"] for r in manifest.primers_as_records(p, "t", "p").collect()] == ["AAA", "AAC", "AAG", "AAT", "AGA", "AGC", "AGG", "AGT"]
    rows = spark.createDataFrame([("k", "ACGT"), ("k", None), ("z", "A")], "k string, s string")
    exp = spark.createDataFrame([("k", "n2", "ACGA"), ("k", "n1", "ACGA")], "k string, n string, r string")
    assert {r["k"]: (r["best"], r["distance"]) for r in manifest.best_expected(rows, ["k"], "s", exp, "n", "r").collect()} == {"k": ("n1", 1), "z": (None, None)}
    assert {r["best"] for r in manifest.best_expected(rows, ["k"], "s", exp, "n", "r", 0).collect()} == {None}


def test_numbers_follow_the_order(spark):
    from haplolake.operators import ranking
    from haplolake.session import drop_scratch

    rows = [(R.choice(["hot"] * 5 + ["a", None]), R.randint(0, 50), k) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, v int, k int").repartition(5)
    got = ranking.number_within(df, ["g"], [F.desc("v"), "k"])
    for g in ("hot", "a", None):
        own = sorted(((r["rank"], r["k"]) for r in got.collect() if r["g"] == g))
        assert [k for _, k in own] == [k for _, _, k in sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))]
        assert [n for n, _ in own] == list(range(len(own)))
    assert ranking.number_rows(df.limit(0), ["k"]).count() == 0
    assert drop_scratch(spark) > 0


@pytest.mark.parametrize("limit", [2000, 0])
def test_contamination_with_repeated_rows(spark, monkeypatch, limit):
    ref, other = "ACGTTGCAAGTCCTAGGATC", "TTGACCGGTAAACTCAGCAT"
    # 1: three of eleven k-mers shared, 2: whole, 3: one id with two texts of equal size, four k-mers each of another half
    low = ref[:7] + "GGGGGGGG"
    one, two = ref[:8] + "CCCCCCC", ref[-8:] + "TTTTTTT"
    rows = [(1, "x", low), (1, "x", low), (2, "x", ref), (2, "x", ref.lower()), (3, "x", one), (3, "x", two), (4, "y", ref), (None, "x", ref)]
    refs = [("x", ref), ("x", ref.lower()), ("x", ref), ("y", other), ("y", other), ("y", None)]
    grams = lambda s: {s[i : i + 5].upper() for i in range(len(s) - 4)}
    want = {}
    for k, t, s in rows:
        own = grams(s)
        best = max(len(own & grams(r)) for u, r in refs if u == t and r)
        if best and 2 * best >= len(own):
            want[k] = max(best, want.get(k, 0))
    monkeypatch.setattr(matching, "BROADCAST_REFS", limit)
    df, rf = spark.createDataFrame(rows, "id long, t string, s string"), spark.createDataFrame(refs, "t string, r string")
    assert {r["id"]: r["best"] for r in matching.kmer_screen(df, "id", "s", rf, "r", ["t"]).collect()} == want


def test_in_row_and_joined_matching_agree(spark, monkeypatch):
    r = random.Random(31)
    primers = {f"p{k}": "".join(r.choice("ACGT") for _ in range(r.choice([8, 9]))) for k in range(6)}
    rows = []
    for k in range(120):
        p = list(r.choice(list(primers.values())))
        for _ in range(r.randint(0, 2)):
            p[r.randrange(len(p))] = r.choice("ACGTN")
        rows.append((k, "".join(r.choice("ACGT") for _ in range(r.randint(0, 3))) + "".join(p) + "ACGTTTGACCA"))
    rows += [(500, None), (501, ""), (502, "AC"), (503, "é" * 20)]
    df = spark.createDataFrame(rows, "id long, s string")
    codes = spark.createDataFrame([*primers.items(), ("p0", primers["p1"]), ("z", None), ("y", "")], "t string, p string")
    both = []
    for few in (500, 0):
        monkeypatch.setattr(matching, "IN_ROW", few)
        demux = matching.demultiplex(df, "id", "s", codes, "t", "p", errors=1)
        primer = matching.match_primers(df, "id", "s", codes, "t", "p", errors=2, within=4)
        back = matching.match_primers(df, "id", "s", codes, "t", "p", errors=2, within=4, reverse=True)
        turned = matching.match_oriented(df, "id", "s", codes, "t", "p", errors=2, within=4)
        pairs = matching.match_primer_pairs(df, "id", "s", codes, "t", "p", "p", errors=2, within=4)
        both.append([sorted(map(str, x.select(sorted(x.columns)).collect())) for x in (demux, primer, back, turned, pairs)])
    assert both[0] == both[1]
    assert len(both[0][0]) == len(rows)


def test_complement_retry_and_dual_barcodes(spark):
    targets = spark.createDataFrame([("x", "ACGTACGGTT"), ("y", "TTGGCCAATC")], "t string, p string")
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, "ACGTACGGTTAAAA"), (2, back("TTGGCCAATCGGG")), (3, "GGGGGGGGGGGG"), (4, None)], "id long, s string")
    found = {r["id"]: (r["label"], r["complement"]) for r in matching.match_oriented(df, "id", "s", targets, "t", "p", errors=0).collect()}
    assert found == {1: ("x", False), 2: ("y_Comp", True), 3: ("unrecognized", False), 4: ("unrecognized", False)}
    counts = {r["target"]: (r["forward"], r["complement"], r["complement_share"]) for r in matching.orientation_counts(matching.match_oriented(df, "id", "s", targets, "t", "p", errors=0)).collect()}
    assert counts == {"x": (1, 0, 0.0), "y": (0, 1, 1.0)}
    one = spark.createDataFrame([(1, "a", "MATCH"), (2, "a", "MATCH"), (3, None, "AMBIGUOUS"), (4, "a", "MATCH")], "id long, mid string, outcome string")
    two = spark.createDataFrame([(1, "a", "MATCH"), (2, "b", "MATCH"), (3, "a", "MATCH"), (4, None, "NO_MATCHING")], "id long, mid string, outcome string")
    dual = {r["id"]: (r["mid"], r["outcome"]) for r in matching.dual_barcodes(one, two, "id").collect()}
    assert dual == {1: ("a", "MATCH"), 2: (None, "MISMATCHED"), 3: (None, "AMBIGUOUS"), 4: (None, "NO_MATCHING")}


def test_paired_screen_both_ways(spark, monkeypatch):
    ref, other = dna(60), dna(60)
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    df = spark.createDataFrame([(1, "k", ref[:30], back(ref[30:])), (2, "k", ref[:30], back(other[30:])), (3, "k", None, back(ref)), (4, "k", "AC", "GT"), (5, "q", ref[:30], back(ref[30:]))], "id long, g string, a string, b string")
    refs = spark.createDataFrame([("k", ref), ("k", ref), ("k", other), ("k", None)], "g string, r string")
    for most in (2000, 0):
        monkeypatch.setattr(matching, "BROADCAST_REFS", most)
        assert [r["id"] for r in matching.paired_screen(df, "id", "a", "b", refs, "r", ["g"]).collect()] == [1]


def test_small_things(spark):
    df = spark.createDataFrame([("a", "ACGT", 2), ("a", "AC", None), ("b", None, 1), (None, "A" * 60, 3)], "k string, s string, m int")
    cut = reads.trim_to_longest(df, "s", F.col("m")).collect()
    assert [r["s"] for r in cut] == ["AC", "AC", None, "AAA"]
    assert [r["x"] for r in df.select(reads.is_small("s", 3).alias("x")).collect()] == [False, True, None, False]
    assert {(r["k"], r["small_bin"]) for r in reads.mark_small_bins(df, ["k"], 1).collect()} == {("a", False), ("b", True), (None, True)}
    assert [r["k"] for r in reads.exclude_named(df, "k", ["a"]).collect()] == ["b", None]
    assert [tuple(r) for r in reads.sorted_counts(df, ["k"]).collect()] == [("a", 2), (None, 1), ("b", 1)]
    out = reads.outcome_counts(df.withColumn("st", F.lit("GOOD")), ["k"], "st", ["GOOD", "BAD"]).where("k = 'a'").first()
    assert (out["total"], out["good"], out["bad"]) == (2, "2(100.00%)", "0(0.00%)")
    seqs = spark.createDataFrame([("s1",), ("s2",)], "id string")
    hit = spark.createDataFrame([("s1", "x"), ("s1", "x")], "id string, target string")
    targets = spark.createDataFrame([("x",), ("y",)], "t string")
    got = {tuple(r) for r in matching.pcr_counts(seqs, "id", targets, "t", hit, hit.limit(1), hit.limit(0)).collect()}
    assert got == {("s1", "x", 2, 1, 0), ("s1", "y", 0, 0, 0)}


def test_two_hop_and_trimmed_mates(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3), ("c", 4)], "k string, n int")
    first = spark.createDataFrame([("a", "u2"), ("a", "u1"), ("b", "u9"), (None, "u1")], "key string, uid string")
    second = spark.createDataFrame([("u1", "t"), (None, "x")], "uid string, typed string")
    assert {(r["n"], r["uid"], r["typed"]) for r in samples.two_hop(rows, "k", first, second).collect()} == {(1, "u1", "t"), (2, "u9", ""), (3, "", ""), (4, "", "")}
    mates = spark.createDataFrame([("ACGT", [1, 2, 3, 4], "TTGCA", [9, 8, 7, 6, 5]), ("A", [1], None, None), ("", [], "C", [3])], "a string, p array<int>, b string, q array<int>")
    cut = [tuple(r) for r in reads.trim_mates(mates, ("a", "p"), ("b", "q"), 1, 2, mate_rc=True).collect()]
    assert cut == [("ACG", [1, 2, 3], "GCA", [7, 6, 5]), ("", [], None, None), ("", [], "", [])]
    plain = reads.trim_mates(mates, ("a", "p"), ("b", "q")).first()
    assert tuple(plain) == ("ACG", [1, 2, 3], "TTGC", [9, 8, 7, 6])
