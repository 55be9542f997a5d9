import importlib
import os
import sys

import pytest
from pyspark.sql import functions as F

from haplolake.plans import api, pipeline, registry
from haplolake.streaming import landing

DATA = "/root/testdata/sf0.001"


def entry():
    import __spark_entry__

    return __spark_entry__


def test_every_core_query_runs_and_matches(spark):
    import duckdb

    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    entry()
    con = duckdb.connect()
    for p in sorted(os.listdir(DATA)):
        con.execute(f"create view {p.removesuffix('.parquet')} as select * from '{DATA}/{p}'")
    for name, q in registry.QUERIES.items():
        df = q(spark, DATA)
        rows = df.collect()
        assert not any(isinstance(v, float) and v != v for r in rows for v in r), f"{name} gives NaN"
        got = sorted(repr(tuple(str(r[c]) for c in sorted(df.columns))) for r in rows)
        if name in registry.SQL:
            found = con.execute(registry.SQL[name])
            columns = [d[0] for d in found.description]
            assert sorted(columns) == sorted(df.columns), name
            want = sorted(repr(tuple(str(r[columns.index(c)]) for c in sorted(columns))) for r in found.fetchall())
            assert got == want, name


def test_entry(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert entry().entry(spark).count() > 0
    assert set(entry().oracle_sql()) <= set(entry().queries())


def test_the_rest_stands_without_the_corpus_operators(monkeypatch):
    for name in [m for m in sys.modules if m.startswith("haplolake.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "haplolake.llm", None)
    import haplolake

    monkeypatch.delattr(haplolake, "llm", raising=False)
    module = importlib.reload(entry())
    try:
        assert module._llm is None
        assert not [n for n in module.queries() if n.startswith("p1_")]
    finally:
        monkeypatch.undo()
        importlib.reload(module)


def test_store(spark):
    rows = [("p", "s1", "h1", 5, 0.5), ("p", "s1", "h2", 5, float("nan")), ("p", "s2", "h1", 3, 1.0), ("q", "s3", "h3", 1, 1.0), ("p", None, "h1", 1, 1.0), (None, "s1", None, 1, 1.0)]
    store = api.ResultStore(spark.createDataFrame(rows, "project_name string, s_sample string, h_popuid string, c_readcnt long, c_averagedfrac double"), profile=spark.createDataFrame([("5(3.00%)", 1)], "good string, n int"))
    assert sorted(r[0] for r in store.projects().collect()) == ["p", "q"]
    assert {r["h_popuid"]: (r["samples"], r["reads"]) for r in store.populations("p", ["h1"]).collect()} == {"h1": (2, 9)}
    assert {r["h_popuid"]: (r["s1"], r["s2"], r["nobody"]) for r in store.matrix("p", [], ["s1", "s2", "nobody"]).collect()} == {"h1": (0.5, 1.0, 0.0), "h2": (0.0, 0.0, 0.0)}
    assert store.samples("none", ["s1"], ["h_popuid"]).count() == 0
    assert store.extraction("profile").first()["good"] == "5"
    with pytest.raises(ValueError, match="more than 1 rows"):
        api.rows(store.projects(), 1)
    assert api.rows(store.projects().where("project_name = 'q'")) == '[{"project_name": "q"}]'


def test_pipeline_end_to_end(spark):
    import random

    r = random.Random(3)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    primer = dna(16)
    haps = [primer + dna(80) for _ in range(2)]
    pairs = []
    for sample in ("a", "b"):
        for k in range(60):
            h = haps[k % 3 == 0]
            back = h[30:][::-1].translate(str.maketrans("ACGT", "TGCA"))
            pairs.append((len(pairs), sample, 1 + k % 2, h[:70], [40] * 70, back, [40] * len(back)))
    df = spark.createDataFrame(pairs, "id long, sample string, rep int, r1 string, q1 array<smallint>, r2 string, q2 array<smallint>")
    targets = spark.createDataFrame([("t", primer, 50, 200)], "target_name string, fwd_primer string, minlen int, maxlen int")
    p = pipeline.Pipeline(pipeline.Config(), targets)
    stitched = p.stitched(df, ["id", "sample", "rep"])
    assert {r_["status"] for r_ in stitched.select("status").distinct().collect()} == {"R1ENDSINR2"}
    good = p.classified(stitched, "id", "seq", "qual").where("case = 'GOOD'").withColumn("one", F.lit(1.0)).withColumnRenamed("matched", "target")
    clusters = p.clustered(good, ["target", "sample", "rep"], "seq", "one")
    pop = p.population(clusters, "target", "sample", "rep").orderBy("h_popuid").collect()
    assert [(x["seq"], x["h_sampcnt"]) for x in pop] == [(haps[0], 2), (haps[1], 2)]
    with pytest.raises(ValueError, match="errors can't be negative"):
        pipeline.Config(barcode_errors=-1)


def test_pipeline_sorts_out_barcodes_primers_contamination_and_chimeras(spark):
    import random

    r = random.Random(4)
    dna = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    back = lambda s: s[::-1].translate(str.maketrans("ACGT", "TGCA"))
    mid, fwd, rev, one, two = dna(8), dna(16), dna(16), dna(60), dna(60)
    good = mid + fwd + one + back(rev)
    rows = [(1, good), (2, dna(8) + good[8:]), (3, mid + fwd + one + dna(16)), (4, mid + fwd + dna(60) + back(rev)), (5, mid + dna(92)), (6, mid + fwd + two + back(rev)), (7, None)]
    df = spark.createDataFrame([(k, s, [40] * len(s or "")) for k, s in rows], "id long, seq string, qual array<smallint>")
    targets = spark.createDataFrame([("t", fwd, rev, 50, 200)], "target_name string, fwd_primer string, rev_primer string, minlen int, maxlen int")
    mids = spark.createDataFrame([("m", mid)], "mid string, barcode string")
    refs = spark.createDataFrame([("t", fwd + one + back(rev)), ("t", fwd + two + back(rev))], "target_name string, ref string")
    p = pipeline.Pipeline(pipeline.Config(contamination_halves=2), targets, barcodes=mids, references=refs)
    got = {x["id"]: x for x in p.classified(df, "id", "seq", "qual").collect()}
    assert {k: x["case"] for k, x in got.items()} == {1: "GOOD", 2: "NO_MATCHING", 3: "BADREVERSE", 4: "CONTAMINATION", 5: "UNRECOGNIZED", 6: "GOOD", 7: "NO_MATCHING"}
    assert (got[1]["mid"], got[1]["seq"], len(got[1]["qual"])) == ("m", good[8:], len(good) - 8)
    mixed = one[:30] + two[30:]
    clusters = spark.createDataFrame([("t", "a", 1, s, n) for s, n in ((one, 100.0), (two, 90.0), (mixed, 10.0))], "target string, sample string, rep int, seq string, cnt double")
    assert {x["seq"] for x in p.population(clusters, "target", "sample", "rep").collect()} == {one, two}


def test_landing_stream_counts_each_read_once(spark, tmp_path):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    rows = spark.read.parquet(f"{DATA}/seq_reads.parquet").where("run_id is not null")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    run = lambda: landing.ingest(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "out"), str(tmp_path / "check"), minlen=50, maxlen=400, late="5000 days")
    run().awaitTermination(120)
    # a last file far later closes all days
    late = rows.limit(1).withColumn("loaded_at", F.lit("2060-01-01").cast("timestamp_ntz" if "ntz" in dict(rows.dtypes)["loaded_at"] else "timestamp")).withColumn("read_id", F.lit(-1).cast("long"))
    late.write.mode("append").parquet(str(tmp_path / "in"))
    run().awaitTermination(120)
    run().awaitTermination(120)
    total = spark.read.parquet(str(tmp_path / "out")).agg(F.sum("reads")).first()[0]
    assert total == rows.select("run_id", "read_id").distinct().count()
