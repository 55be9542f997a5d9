import random

import pytest
from pyspark.sql import functions as F

from haplolake.functions import names, quality, register
from haplolake.functions import sequence as sq


def one(spark, column, **values):
    kinds = {str: "string", list: "array<int>"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first()["x"]


def test_revcomp_twice_is_the_same(spark):
    r = random.Random(1)
    rows = [("".join(r.choice("ACGTRYNacgtn") for _ in range(r.randint(0, 80))),) for _ in range(100)]
    df = spark.createDataFrame(rows, "s string")
    assert df.where(sq.revcomp(sq.revcomp(F.col("s"))) != F.col("s")).count() == 0
    assert one(spark, sq.revcomp(F.col("s")), s="AACGTn") == "nACGTT"


def test_case_kmers_hamming(spark):
    s = F.col("s")
    assert one(spark, sq.remove_lower(s), s="ACgtT") == "ACT"
    assert one(spark, sq.keep_upper_qualities(s, F.col("q")), s="ACgtT", q=[1, 2, 3, 4, 5]) == [1, 2, 5]
    assert one(spark, sq.keep_upper_qualities(s, F.col("q")), s="ACg", q=[1]) is None
    assert one(spark, sq.kmers(s, 3), s="ACGTA") == ["ACG", "CGT", "GTA"]
    assert one(spark, sq.kmers(s, 3), s="AC") == []
    assert one(spark, sq.hamming(s, F.col("t")), s="ACGT", t="AGGA") == 2
    assert one(spark, sq.hamming(s, F.col("t")), s="ACGT", t="A") is None
    assert one(spark, sq.count_base(s, "n"), s="ANnG") == 2
    assert one(spark, sq.homopolymer_runs(s), s="AACGGG") == ["AA", "C", "GGG"]


def test_motifs_and_trims(spark):
    s = F.col("s")
    assert one(spark, sq.motif_errors(s, "ARN"), s="AGT") == 0
    assert one(spark, sq.motif_errors(s, "ARN"), s="CCT") == 2
    assert sq.motif_regex("ARC") == "A[AG]C"
    assert sq.expand_motif("AR") == ["AA", "AG"]
    with pytest.raises(ValueError, match="stands for"):
        sq.expand_motif("N" * 10)
    assert one(spark, sq.trim_ends(s, 1, 2), s="ACGTA") == "CG"
    assert one(spark, sq.trim_ends(s, 3, 3), s="ACGTA") == ""
    assert one(spark, sq.trim_at(s, "GG"), s="AAGGTTGGC") == "AAGGTT"
    assert one(spark, sq.trim_at(s, "GG", include=True), s="AAGGTTGGC") == "AAGGTTGG"
    assert one(spark, sq.trim_at(s, "CCC"), s="AAGG") == "AAGG"


def test_qualities(spark):
    q = F.col("q")
    assert one(spark, quality.encode(quality.decode(F.col("s"))), s="!5I") == "!5I"
    assert one(spark, quality.mean_error(q), q=[10, 20]) == pytest.approx(0.055)
    assert one(spark, quality.mean_error(q), q=[]) is None
    assert one(spark, quality.fraction_ok(q), q=[30] * 9 + [2]) is True
    assert one(spark, quality.fraction_ok(q), q=[]) is False
    assert one(spark, quality.first_at_most(q), q=[30, 2, 40]) == 2
    assert one(spark, quality.failing_windows(q, 2, 1, 25), q=[30, 30, 10, 30, 40]) == [2, 3]
    assert one(spark, quality.windows_ok(q), q=[1, 1]) is True
    assert one(spark, quality.window_trim_length(q, 2, 1, 25), q=[30, 30, 10, 30]) == 1
    assert one(spark, quality.flatten_runs(F.col("s"), q), s="AAC", q=[10, 20, 7]) == [15, 15, 7]


def test_names(spark):
    n = F.col("n")
    good = "M01380:70:000000000-B9CJY:1:2118:15005:24494 1:N:0:AGGAGTCC+TAGATCGC"
    backup = "M01380:70:000000000-B9CJY:1:2118:15005:24494 1:N:0:hu136 AGGAGTCC|0|TAGATCGC|0"
    assert one(spark, names.illumina(n)["lane"], n=good) == "1"
    assert one(spark, names.sample_number(n), n=backup) == "AGGAGTCC|0|TAGATCGC|0"
    assert one(spark, names.sample_number(n), n=good) == "AGGAGTCC+TAGATCGC"
    assert one(spark, names.sample_number(n), n=good.replace("AGGAGTCC+TAGATCGC", "ACGT+TTGA moved-code more")) == "moved-code"
    assert one(spark, names.sample_number(n), n=good.replace("AGGAGTCC+TAGATCGC", "17")) == "17"
    assert one(spark, names.sample_number(n), n="junk") == ""
    assert one(spark, names.sample_number(n), n=None) == ""
    assert one(spark, names.meta(n), n="x[a=1;b=c=d]") == {"a": "1", "b": "c=d"}
    assert one(spark, names.meta(n), n="x") == {}
    assert one(spark, names.with_meta(n, {"k": F.lit(3)}), n="x[a=1]") == "x[k=3]"
    assert one(spark, names.read_count(n), n="s.00_t12") == 12
    assert one(spark, names.read_count(n), n="s") == 1
    assert one(spark, names.percent(F.lit(1), F.lit(3)), n="") == "1(33.33%)"
    assert one(spark, names.strip_percent(n), n="1(33.33%)") == "1"


def test_sql_functions(spark):
    assert "kmers" in register.register_functions(spark)
    row = spark.sql("select revcomp('AAC') a, hamming('AC', 'AG') b, kmer_similarity('ACGTA', 'ACGTT', 3) c, qual_window_ok(array(30S, 10S), 1, 1, 25) d, qual_fraction_ok(array(30S), 30, 90) e, mean_error(array(10S)) f").first()
    assert (row["a"], row["b"], row["d"], row["e"]) == ("GTT", 1, False, True)
    assert row["c"] == pytest.approx(2 / 3)
    assert row["f"] == pytest.approx(0.1)
    assert [tuple(r) for r in spark.sql("select * from kmers('ACGT', 3)").collect()] == [(1, "ACG"), (2, "CGT")]
