import gzip
import json

import pytest
from pyspark.sql import functions as F

from haplolake.sources import fastx, tables


def test_round_trips(spark, tmp_path):
    rows = [("t1", "a 1", "ACGTN", [40, 2, 0, 93, 7]), ("t2", "b", "GG", [1, 2]), ("t1", "c", "A", [30]), ("t1", None, "A", [30])]
    df = spark.createDataFrame(rows, "target string, name string, seq string, qual array<smallint>")
    fastx.write(df, str(tmp_path / "out"), "name", "seq", "qual", by=["target"])
    assert sorted(p.name for p in (tmp_path / "out").glob("target=*")) == ["target=t1", "target=t2"]
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").rglob("*.txt")))
    (tmp_path / "x.fastq.gz").write_bytes(gzip.compress(text.encode()))
    (tmp_path / "y.fasta").write_text(">n1\nAC\nGT\n>n2\n\n")
    back = fastx.read(spark, str(tmp_path / "x.fastq.gz")).select("name", "seq", "qual")
    assert sorted(map(tuple, back.collect())) == sorted((n, s, q) for _, n, s, q in rows if n)
    both = {(r["name"], r["seq"], r["ordinal"]) for r in fastx.read(spark, str(tmp_path)).where("qual is null").collect()}
    assert both == {("n1", "ACGT", 0), ("n2", "", 1)}


def test_pairs_and_broken_files(spark, tmp_path):
    (tmp_path / "lib_R1.fastq").write_text("@r1\nACGT\n+\nIIII\n@r2\nAAAA\n+\nIIII\n")
    (tmp_path / "lib_R2.fastq").write_text("@r1\nTTTA\n+\nIII!\n@r2\nCCCC\n+\nIIII\n")
    pairs = fastx.read_pairs(spark, str(tmp_path / "lib_R1.fastq"), str(tmp_path / "lib_R2.fastq"), mate_rc=True).orderBy("ordinal").collect()
    assert [(r["library"], r["r1"], r["r2"]) for r in pairs] == [("lib", "ACGT", "TAAA"), ("lib", "AAAA", "GGGG")]
    assert pairs[0]["q2"] == [0, 40, 40, 40]
    (tmp_path / "bad.fastq").write_text("@r1\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="broken record"):
        fastx.read(spark, str(tmp_path / "bad.fastq")).collect()
    with pytest.raises(ValueError, match="no known sequence format"):
        fastx.format_of("x.txt")


def test_id_files(spark, tmp_path):
    text = "# ids\ntarget forward reverse\nt1 ACGT GGTT\n\nid barcode\nMID1 AACC\nMID2 GGTT CCAA\n"
    targets, mids = tables.parse_ids(text)
    assert tables.parse_ids(tables.format_ids(targets, mids)) == (targets, mids)
    for bad, why in (("t1 A C", "before any section"), ("target f r\nt A", "3 columns"), ("target f r\nt A C\nt A C", "twice"), ("id b\nM", "2 or 3"), ("id b\nM A\nM A", "twice")):
        with pytest.raises(ValueError, match=why):
            tables.parse_ids(bad)
    (tmp_path / "ids.txt").write_text(text)
    a, b = tables.read_ids(spark, str(tmp_path / "ids.txt"))
    assert (a.count(), b.count()) == (1, 2)
    assert tables.parse_overlap_statuses("target status\nt R1ENDSINR2,perfectoverlap\n") == {"t": ["R1ENDSINR2", "PERFECTOVERLAP"]}
    with pytest.raises(ValueError, match="permitted"):
        tables.parse_overlap_statuses("target status\nt NOOVERLAP,AUTO\n")


def test_tables(spark, tmp_path):
    (tmp_path / "a.tab.txt").write_text("#Name\tX\na\t1\nb\t2\n")
    (tmp_path / "b.tab.txt").write_text("Name\tY\nc\t3\n")
    df = tables.read_delimited(spark, str(tmp_path / "a.tab.txt"), lower=True, required=["name"])
    assert df.columns == ["name", "x"]
    with pytest.raises(ValueError, match="lacks the columns z"):
        tables.read_delimited(spark, str(tmp_path / "a.tab.txt"), required=["z"])
    assert tables.union_tables(spark, str(tmp_path), r"\.tab\.txt$").count() == 3
    (tmp_path / "w.txt").write_text("target  min\tmax\nt1 10   20\n")
    assert [tuple(r) for r in tables.read_delimited(spark, str(tmp_path / "w.txt"), "whitespace").collect()] == [("t1", "10", "20")]
    (tmp_path / "g.gff").write_text("##gff\nchr1\tsrc\tgene\t11\t20\t.\t+\t.\tID=g1;Name=x\n")
    (g,) = tables.read_gff(spark, str(tmp_path / "g.gff")).collect()
    assert (g["start"], g["end"], g["attributes"]["ID"]) == (10, 20, "g1")
    (tmp_path / "r.bed").write_text("track x\nchr1\t5\t9\nchr1\t7\t9\tn\t0\t-\n")
    bed = tables.read_bed(spark, str(tmp_path / "r.bed"))
    assert [(r["start"], r["strand"]) for r in bed.collect()] == [(5, None), (7, "-")]
    tables.write_bed(bed, str(tmp_path / "out.bed"))
    (tmp_path / "c.json").write_text(json.dumps({"name": "p"}))
    assert tables.read_json(spark, str(tmp_path / "c.json"), "name string, dir string", ["name"]).first()["name"] == "p"
    with pytest.raises(Exception, match="lacks dir"):
        tables.read_json(spark, str(tmp_path / "c.json"), "name string, dir string", ["dir"]).collect()
    assert tables.expand_commands("run {A} {B}", {"A": ["1", "2"], "B": ["x"], "C": ["y"]}) == ["run 1 x", "run 2 x"]
    tables.write_delimited(spark.range(2).select(F.col("id")), str(tmp_path / "t"), compression="gzip")


def test_paired_and_routed_writers(spark, tmp_path):
    rows = [("t", "b", "ACGT", [40] * 4, "TTGG", [30] * 4, "R1ENDSINR2", ["R1ENDSINR2"]), ("t", "a", "AC", [40, 2], "GG", [9, 9], "NOOVERLAP", ["R1ENDSINR2"]), ("u", "c", "A", [1], None, None, None, None)]
    df = spark.createDataFrame(rows, "t string, n string, r1 string, q1 array<smallint>, r2 string, q2 array<smallint>, st string, ex array<string>").coalesce(1)
    fastx.write_pairs(df, str(tmp_path / "pairs"), "n", ("r1", "q1"), ("r2", "q2"), by=["t"])
    names = {side: [line for f in (tmp_path / "pairs" / side).rglob("part*") for line in f.read_text().splitlines() if line.startswith("@")] for side in ("R1", "R2")}
    assert names["R1"] == names["R2"] == ["@a", "@b"]
    fastx.write_by_status(df, str(tmp_path / "routed"), "n", "r1", "q1", "st", "ex")
    assert sorted(f"{p.parent.name}/{p.name}" for p in (tmp_path / "routed").glob("*/*") if p.is_dir()) == ["route=bad/status=NONE", "route=bad/status=NOOVERLAP", "route=good/status=R1ENDSINR2"]
    places = spark.createDataFrame([("t", "one"), ("x", "two"), (None, "z")], "key string, location string")
    keyed = df.withColumn("lib", F.when(F.col("n") == "a", "x_R1").when(F.col("n") == "c", "nowhere").otherwise("t"))
    fastx.write_to_locations(keyed, str(tmp_path / "extra"), "n", "r1", "q1", "lib", places)
    assert sorted(p.name for p in (tmp_path / "extra").glob("location=*")) == ["location=one", "location=two"]


def test_tree_json_and_observed(spark, tmp_path):
    edges = spark.createDataFrame([("k", "A", "B", 1), ("k", "B", "C", 2)], "s string, a string, b string, events int")
    tables.write_tree_json(edges, str(tmp_path / "tree"), by=["s"])
    tree = json.loads("".join(f.read_text() for f in (tmp_path / "tree").glob("part*")))
    assert tree == {"s": "k", "nodes": ["A", "B", "C"], "links": [{"source": "A", "target": "B", "value": 1}, {"source": "B", "target": "C", "value": 2}]}
    df, seen = tables.observed(edges, "run", events=F.sum("events"))
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "events": 3}
