"""Manifests: files, mates, samples, targets and their agreement; comparison with expected sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sequence as sq

# fixed values: file names of paired reads, SAMPLE[_S1][_L001]_R1[_001].fastq[.gz]
MATE = r"^(.+?)(_S[0-9]+)?(_L[0-9]+)?_(R?[12])(_[0-9]+)?\.(?:fastq|fq)(?:\.gz)?$"


def pair_files(files: DataFrame, path: str, size: str) -> DataFrame:
    """(stub, r1, r2, problem): mates of files by the name before R1 or R2; problem is 'no mate', 'empty' or null.

    Files of another name form are left out.
    """
    base = F.regexp_extract(path, r"([^/]+)$", 1)
    rows = files.select(F.col(path).alias("_p"), F.col(size).alias("_s"), base.alias("_b")).where(F.col("_b").rlike(MATE))
    mate = F.right(F.regexp_extract("_b", MATE, 4), F.lit(1))
    stub = F.concat(*(F.regexp_extract("_b", MATE, k) for k in (1, 2, 3)), F.regexp_extract("_b", MATE, 5))
    keyed = rows.select(stub.alias("stub"), mate.alias("_m"), "_p", "_s")
    one = keyed.where("_m = '1'").select("stub", F.col("_p").alias("r1"), F.col("_s").alias("_s1"))
    two = keyed.where("_m = '2'").select("stub", F.col("_p").alias("r2"), F.col("_s").alias("_s2"))
    both = one.join(two, "stub", "full")
    problem = F.when(F.col("r1").isNull() | F.col("r2").isNull(), "no mate").when((F.col("_s1") == 0) | (F.col("_s2") == 0), "empty")
    return both.select("stub", "r1", "r2", problem.alias("problem"))


def match_files(stubs: DataFrame, stub: str, expected: DataFrame, sample: str, *, prefix: bool = False) -> DataFrame:
    """(stub, sample, outcome): exact name or MID + name first, else (``prefix``) the one sample whose name starts the stub.

    Outcome: matched, ambiguous (several prefixes; sample null) or unknown. Exact names are an equi-join; prefixes are met
    through all prefixes of the stub, also an equi-join.
    """
    names = expected.select(F.col(sample).alias("_n")).where(F.col(sample).isNotNull()).distinct()
    files = stubs.select(F.col(stub).alias("stub")).distinct()
    exact = files.join(names.select("_n", F.explode(F.array("_n", F.concat(F.lit("MID"), "_n"))).alias("stub")), "stub").groupBy("stub").agg(F.min("_n").alias("sample"))
    if not prefix:
        return files.join(exact, "stub", "left").withColumn("outcome", F.when(F.col("sample").isNotNull(), "matched").otherwise("unknown"))
    cuts = files.where(F.length("stub") > 0).withColumn("_n", F.explode(F.transform(F.sequence(F.lit(1), F.length("stub")), lambda k: F.substring("stub", F.lit(1), k))))
    starts = cuts.join(names, "_n").groupBy("stub").agg(F.min("_n").alias("_first"), F.count("*").alias("_k"))
    met = files.join(exact, "stub", "left").join(starts, "stub", "left")
    outcome = F.when(F.col("sample").isNotNull() | (F.col("_k") == 1), "matched").when(F.col("_k") > 1, "ambiguous").otherwise("unknown")
    return met.select("stub", F.coalesce("sample", F.when(F.col("_k") == 1, F.col("_first"))).alias("sample"), outcome.alias("outcome"))


def disagreement(left: DataFrame, right: DataFrame, key: str, left_name: str, right_name: str) -> DataFrame:
    """(key, missing_in): keys that only one side has."""
    a = left.select(key).where(F.col(key).isNotNull()).distinct()
    b = right.select(key).where(F.col(key).isNotNull()).distinct()
    return a.join(b, key, "left_anti").withColumn("missing_in", F.lit(right_name)).unionByName(b.join(a, key, "left_anti").withColumn("missing_in", F.lit(left_name)))


def targets_of_index(manifest: DataFrame, index: str, targets: str, every: DataFrame, target: str) -> DataFrame:
    """(index, target): the comma list of an index spread to rows; an empty or null list, or 'all', stands for every target."""
    lists = manifest.select(index, F.filter(F.split(F.coalesce(targets, F.lit("")), r"\s*,\s*"), lambda t: (t != "") & (F.lower(t) != "all")).alias("_t"))
    named = lists.where(F.size("_t") > 0).select(index, F.explode("_t").alias(target))
    whole = lists.where(F.size("_t") == 0).select(index).crossJoin(F.broadcast(every.select(target).distinct()))
    return named.unionByName(whole).distinct()


def primers_as_records(targets: DataFrame, target: str, primer: str) -> DataFrame:
    """(name, seq): a primer with its IUPAC codes written out, one record per plain sequence, numbered from 0."""
    table = F.create_map(*(F.lit(x) for c, s in sq.IUPAC.items() for x in (c, s)))
    letters = F.transform(sq.bases(F.upper(primer)), lambda c: sq.bases(F.coalesce(F.try_element_at(table, c), c)))
    spread = F.aggregate(letters, F.array(F.lit("")), lambda done, nxt: F.flatten(F.transform(done, lambda p: F.transform(nxt, lambda c: F.concat(p, c)))))
    rows = targets.where(F.col(primer).isNotNull()).select(target, F.posexplode(spread).alias("_i", "seq"))
    return rows.select(F.concat_ws(".", target, F.col("_i").cast("string")).alias("name"), "seq")


def best_expected(rows: DataFrame, by: list[str], seq: str, expected: DataFrame, name: str, ref: str, within: int | None = None) -> DataFrame:
    """(by, seq, best, distance): the expected sequence of the key with the least edit distance (ties: the smaller name).

    Each distinct sequence is compared once, with the few expected ones of its key; beyond ``within`` edits ``best`` is null.
    """
    unique = rows.where(F.col(seq).isNotNull()).select(*by, F.upper(seq).alias("seq")).distinct()
    refs = expected.where(F.col(ref).isNotNull()).select(*by, F.col(name).alias("_n"), F.upper(ref).alias("_r"))
    met = unique.join(refs, by, "left").withColumn("distance", F.levenshtein("seq", "_r"))
    found = met.groupBy(*by, "seq").agg(F.min(F.when(F.col("distance").isNotNull(), F.struct("distance", "_n"))).alias("_b"))
    out = found.select(*by, "seq", F.col("_b._n").alias("best"), F.col("_b.distance").alias("distance"))
    return out if within is None else out.withColumn("best", F.when(F.col("distance") <= within, F.col("best")))


def pairwise_distances(rows: DataFrame, by: list[str], seq: str) -> DataFrame:
    """(by, a, b, distance): all pairs a < b of a key's distinct sequences. Meant for final clusters of one sample, a bounded set."""
    unique = rows.where(F.col(seq).isNotNull()).select(*by, F.upper(seq).alias("_s")).distinct()
    met = unique.select(*by, F.col("_s").alias("a")).join(unique.select(*by, F.col("_s").alias("b")), by).where("a < b")
    return met.withColumn("distance", F.levenshtein("a", "b"))
