from haplolake.llm import formatting as f

ROWS = [
    (1, "[a=1; B = x2]", "ACGT", "l"),
    (2, ">b:X2 | A:1", "ac gt\n", "k"),
    (3, '(B="x2", a=1;)', "--ACGT*", None),
    (4, "[a=2; b=x2]", "ACGT", "l"),
    (5, "[a=1; b=x2]", "ACGA", "l"),
    (6, "[a=1; b=x2; c=3]", "ACGT", "l"),
    (7, None, "ACGT", "l"),
    (8, None, "acgt", "l"),
    (9, "", "ACGT", "l"),
    (10, None, None, "l"),
    (11, "[a=1; b=x2]", None, "l"),
    (12, "[a = 1;\tb = x2]", "A CGT", "l"),
    (None, "[a=1; b=x2]", "ACGT", "l"),
]
SCHEMA = "id long, header string, seq string, root string"


def test_repeats(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, f.repeated_records(df, "id", "header", "seq").collect())) == [(1, 2), (1, 3), (1, 12), (7, 8)]
    copies = {r["first_rec_id"]: r["copies"] for r in f.collapse_formatting(df, "id", "header", "seq").collect()}
    assert copies == {1: 5, 4: 1, 5: 1, 6: 1, 7: 2, 9: 1, 10: 1, 11: 1}


def test_equal_digest_of_other_structure_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(f, "root_digest", lambda fields, seq: F.lit("same"))
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sorted(map(tuple, f.repeated_records(df, "id", "header", "seq").collect())) == [(1, 2), (1, 3), (1, 12), (7, 8)]
    copies = {r["first_rec_id"]: r["copies"] for r in f.collapse_formatting(df, "id", "header", "seq").collect()}
    assert copies == {1: 5, 4: 1, 5: 1, 6: 1, 7: 2, 9: 1, 10: 1, 11: 1}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert f.repeated_records(df, "id", "header", "seq").count() == 0
    assert f.collapse_formatting(df, "id", "header", "seq").count() == 0
