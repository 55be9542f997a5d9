"""Queries of the corpus operators on the test tables, and the SQL that checks them."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from . import abuse, formatting, leaks, neardup, packing, pairs, quantiles, topn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Whole texts, over all cores even if they came in one small file."""
    return spread(_table(spark, sf_dir, "documents").select(*columns))


# --- 1 ---------------------------------------------------------------------------------------


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.cooccurring_pairs(_table(spark, sf_dir, "sample_info"), "project_name", "s_sample", "h_popuid", min_count=8, min_lift=2)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).select(F.col("item_a").alias("h_popuid_a"), F.col("item_b").alias("h_popuid_b"))


def p1_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p1(spark, sf_dir).withColumns({"lift": F.round("lift", 6), "odds_ratio": F.round("odds_ratio", 6)})


# --- 2 ---------------------------------------------------------------------------------------


def p2_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("c_averagedfrac").between(0, 1), F.col("c_averagedfrac"))
    return topn.top_n_per_group(_table(spark, sf_dir, "sample_info"), "s_sample", "h_popuid", score, 3)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_top3(spark, sf_dir).drop("score")


# --- 3 ---------------------------------------------------------------------------------------

QUANTILES = {"q10": 0.1, "q25": 0.25, "q50": 0.5, "q75": 0.75, "q90": 0.9}


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of all base qualities of a run, with the run's way of making consensus qualities."""
    parts = quantiles.summarise(_table(spark, sf_dir, "seq_reads"), ["run_id"], "qual_", identity=["read_id"], low=0, high=60)
    found = quantiles.percentiles(quantiles.combine(parts, ["run_id"]), ["run_id"], QUANTILES)
    runs = _table(spark, sf_dir, "cluster_runs").select("run_id", F.lower(F.trim("qualrep")).alias("qualrep"))
    return found.join(runs, "run_id", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_percentiles(spark, sf_dir).where(quantiles.is_named("qualrep", "median") & (F.col("q50") < 25)).select("run_id")


def p3_days_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries kept per run and day of loading, then combined: the run's percentiles without reading any value again.

    A read that was delivered on two days counts on the first.
    """
    reads = _table(spark, sf_dir, "seq_reads").where(F.size("qual_") > 0).withColumn("day", F.to_date("loaded_at"))
    first = reads.groupBy("run_id", "read_id").agg(F.min("day").alias("day"))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("run_id", "read_id", "day")]
    reads = reads.alias("r").join(first.alias("f"), same).select("r.*")
    daily = quantiles.combine(quantiles.summarise(reads, ["run_id", "day"], "qual_", identity=["read_id"], low=0, high=60), ["run_id", "day"])
    return quantiles.percentiles(quantiles.combine(daily, ["run_id"]), ["run_id"], QUANTILES)


# --- 4 ---------------------------------------------------------------------------------------


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = neardup.near_pairs(_table(spark, sf_dir, "clusters"), "cluster_id", "target_name", "seq_")
    return neardup.expand(members, links).select(F.col("id_a").alias("cluster_id_a"), F.col("id_b").alias("cluster_id_b"))


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_classes(_table(spark, sf_dir, "clusters"), "cluster_id", "target_name", "seq_")
    return found.withColumnRenamed("id", "cluster_id").withColumnRenamed("class", "class_id")


# --- 5 ---------------------------------------------------------------------------------------


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.repeated_records(_table(spark, sf_dir, "seq_records"), "rec_id", "header", "seq_")


def p5_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formatting.collapse_formatting(_table(spark, sf_dir, "seq_records"), "rec_id", "header", "seq_").drop("root")


# --- 6 ---------------------------------------------------------------------------------------

CAPACITY = 2048


def _vocabulary() -> dict[str, str]:
    """Path of a public vocabulary and its word pattern; HAPLOLAKE_VOCABULARY and HAPLOLAKE_WORD_PATTERN name others."""
    named, pattern = os.environ.get("HAPLOLAKE_VOCABULARY"), os.environ.get("HAPLOLAKE_WORD_PATTERN")
    if not (named and pattern):
        import public_tokenizers

        named, pattern = named or public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern or public_tokenizers.PATTERN
    return {"vocabulary": named, "pattern": pattern}


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = packing.token_counts(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", **_vocabulary())
    return packing.pack_items(counts, CAPACITY).withColumnRenamed("id", "doc_id").withColumnRenamed("container", "container_id")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_packed(spark, sf_dir).withColumnRenamed("container_id", "container"), CAPACITY)


# --- 7 ---------------------------------------------------------------------------------------


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and test item it carries, with the share of the item's words."""
    found = leaks.find_leaks(_documents(spark, sf_dir, "doc_id", "text"), "doc_id", "text", _table(spark, sf_dir, "eval_items"), "item_id", "item_text")
    return found.withColumn("share", F.round("share", 6))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).select("doc_id", "item_id")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item with the number of documents that carry it, whole (nine words of ten) or in part."""
    per = p7_leaks(spark, sf_dir).groupBy("item_id").agg(F.count("*").alias("docs"), F.count_if(F.col("share") >= 0.9).alias("whole"))
    items = _table(spark, sf_dir, "eval_items").select("item_id", "task_kind")
    return items.join(per, "item_id", "left").select("item_id", "task_kind", F.coalesce("docs", F.lit(0)).alias("docs"), F.coalesce("whole", F.lit(0)).alias("whole"))


# --- 8 ---------------------------------------------------------------------------------------


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, by a model fitted on the reviewers' marks (a bounded sample of them)."""
    marks = abuse.labelled_sample(_table(spark, sf_dir, "doc_labels"), _table(spark, sf_dir, "documents"), "doc_id", "text", "toxic", "kind_mark")
    return abuse.score_abuse(_documents(spark, sf_dir, "doc_id", "source", "text"), ["doc_id", "source"], "text", abuse.fit(*marks))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_scores(spark, sf_dir).where(F.col("score") >= abuse.THRESHOLD).select("doc_id")


def p8_source_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return abuse.rates(p8_scores(spark, sf_dir), "source")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [p1_found, p1_odds, p2_found, p2_top3, p3_found, p3_percentiles, p3_days_combined, p4_found, p4_classes, p5_found, p5_copies]
    found += [p6_packed, p6_fill, p7_found, p7_leaks, p7_items, p8_found, p8_scores, p8_source_rates]
    return {f.__name__: f for f in found}


_PAIRS = """
with base as (select distinct project_name p, s_sample s, h_popuid h from sample_info
              where project_name is not null and s_sample is not null and h_popuid is not null),
n as (select p, count(distinct s) n from base group by p),
c as (select p, h, count(*) c from base group by p, h),
ab as (select a.p, a.h ha, b.h hb, count(*) n_ab from base a join base b on a.p = b.p and a.s = b.s and a.h < b.h group by 1, 2, 3 having count(*) >= 8),
found as (select ab.p, ha, hb, n_ab, x.c n_a, y.c n_b, n.n from ab join n on n.p = ab.p
          join c x on x.p = ab.p and x.h = ha join c y on y.p = ab.p and y.h = hb where n_ab * n.n >= 2 * x.c * y.c)
"""
_BEST = """
with best as (select s_sample, h_popuid, max(c_averagedfrac) score from sample_info
              where s_sample is not null and h_popuid is not null and not isnan(c_averagedfrac) and c_averagedfrac between 0 and 1 group by 1, 2),
ranked as (select *, row_number() over (partition by s_sample order by score desc, h_popuid) r from best)
"""
_QUALITIES = """
with reads as (select run_id, read_id, min(qual_) qual_ from seq_reads where len(qual_) > 0 group by 1, 2),
q as (select run_id, unnest(qual_) x from reads),
found as (select run_id, count(*) n, quantile_cont(x::double, 0.1) q10, quantile_cont(x::double, 0.25) q25, quantile_cont(x::double, 0.5) q50,
          quantile_cont(x::double, 0.75) q75, quantile_cont(x::double, 0.9) q90, 0::bigint rank_error from q where x between 0 and 60 group by 1)
"""
_RECORDS = r"""
with parts as (select rec_id, list_transform(regexp_extract_all(header, '[\pL\pN_.\- ]+?\s*[=:]\s*("[^"]*"|[^;|,\]\)\[\(\r\n\t]*)'),
  lambda x: lower(regexp_replace(regexp_extract(x, '^([^=:]*)[=:]', 1), '[^\pL\pN]+', '', 'g')) || '=' || lower(regexp_replace(regexp_extract(x, '^[^=:]*[=:](.*)$', 1, 's'), '[^\pL\pN]+', '', 'g'))) f,
  lower(regexp_replace(seq_, '[^\pL\pN]+', '', 'g')) s from seq_records),
keyed as (select rec_id, array_to_string(list_sort(list_distinct(f)), '|') h, s from parts),
g as (select h, s, min(rec_id) first_rec_id, count(*) copies from keyed group by 1, 2)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _PAIRS + "select ha h_popuid_a, hb h_popuid_b from found",
        "p1_odds": _PAIRS
        + "select p project_name, ha item_a, hb item_b, n_ab, n_a, n_b, n, round(n_ab * n / (n_a * n_b), 6) lift, "
        + "round((n_ab + 0.5::double) * (n - n_a - n_b + n_ab + 0.5::double) / ((n_a - n_ab + 0.5::double) * (n_b - n_ab + 0.5::double)), 6) odds_ratio from found",
        "p2_found": _BEST + "select s_sample, h_popuid from ranked where r <= 3",
        "p2_top3": _BEST + "select s_sample, h_popuid, score from ranked where r <= 3",
        "p3_found": _QUALITIES + "select run_id from found join cluster_runs using (run_id) where lower(trim(qualrep)) = 'median' and q50 < 25",
        "p3_percentiles": _QUALITIES + "select found.*, lower(trim(qualrep)) qualrep from found left join cluster_runs using (run_id)",
        "p3_days_combined": _QUALITIES + "select * from found",
        "p5_found": _RECORDS + "select first_rec_id, rec_id from keyed join g using (h, s) where rec_id > first_rec_id",
        "p5_copies": _RECORDS + "select first_rec_id, copies from g",
    }
