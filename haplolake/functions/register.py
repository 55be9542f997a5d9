"""SQL names for the column functions, as SQL-bodied functions (inlined by the optimizer) and one table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name -> (arguments, result, body); temporary functions that the optimizer inlines
SQL_FUNCTIONS = {
    "revcomp": ("s STRING", "STRING", "translate(reverse(s), 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn')"),
    "hamming": ("a STRING, b STRING", "INT", "CASE WHEN length(a) = length(b) THEN aggregate(zip_with(split(a, ''), split(b, ''), (x, y) -> IF(x = y, 0, 1)), 0, (s, x) -> s + x) END"),
    "kmer_list": ("s STRING, k INT", "ARRAY<STRING>", "CASE WHEN length(s) >= k THEN transform(sequence(1, length(s) - k + 1), i -> substring(s, i, k)) ELSE array() END"),
    "kmer_similarity": (
        "a STRING, b STRING, k INT",
        "DOUBLE",
        "try_divide(size(array_intersect(kmer_list(a, k), kmer_list(b, k))), size(array_distinct(kmer_list(a, k))))",
    ),
    "mean_error": ("q ARRAY<SMALLINT>", "DOUBLE", "CASE WHEN size(q) > 0 THEN aggregate(q, 0D, (s, x) -> s + pow(10D, -x / 10D)) / size(q) END"),
    "qual_fraction_ok": ("q ARRAY<SMALLINT>, cutoff INT, percent INT", "BOOLEAN", "coalesce(size(q) > 0 AND size(filter(q, x -> x >= cutoff)) * 100 >= size(q) * percent, false)"),
    "qual_window_ok": (
        "q ARRAY<SMALLINT>, width INT, step INT, mean INT",
        "BOOLEAN",
        "size(q) < width OR forall(sequence(1, greatest(size(q) - width + 1, 1), step), i -> aggregate(slice(q, i, width), 0, (s, x) -> s + int(x)) >= width * mean)",
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the temporary functions and the table function ``kmers(seq, k)``; the names that now exist."""
    from pyspark.sql.functions import udtf

    for name, (arguments, result, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")

    @udtf(returnType="pos int, kmer string", useArrow=True)
    class Kmers:
        def eval(self, seq: str, k: int):  # noqa: ANN201
            for i in range(len(seq or "") - k + 1):
                yield i + 1, seq[i : i + k]

    spark.udtf.register("kmers", Kmers)
    return [*SQL_FUNCTIONS, "kmers"]
