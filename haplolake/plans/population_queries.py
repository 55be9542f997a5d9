"""Queries over samples, populations, groups and control mixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import collapse, mixtures, reads, samples
from .registry import query, table

_FRAC = """with per as (select target_name, s_sample, replicate_no, upper(seq_) seq, sum(cnt_) cnt from clusters where replicate_no is not null and seq_ is not null and cnt_ is not null and s_sample is not null and target_name is not null group by all),
 f as (select *, case when sum(cnt) over w > 0 then cnt / sum(cnt) over w else 0 end frac from per window w as (partition by target_name, s_sample, replicate_no)),
 reps as (select target_name, s_sample, count(distinct replicate_no) reps from per group by all),
 found as (select target_name, s_sample, seq, count(distinct replicate_no) rep_cnt, sum(cnt) reads, sum(frac) sf from f group by all),
 hap as (select found.*, reps, sf / reps avg_frac from found join reps using (target_name, s_sample)) """
_KEY = ["target_name", "s_sample"]


def _haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clusters").where("s_sample is not null and target_name is not null")
    return samples.replicate_fractions(rows, _KEY, "replicate_no", "seq_", "cnt_")


@query(_FRAC + "select target_name, s_sample, seq, rep_cnt, reads, reps, round(avg_frac, 9) avg_frac from hap")
def sample_replicate_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _haps(spark, sf_dir).withColumn("avg_frac", F.round("avg_frac", 9))


@query("""with c as (select * from clusters where cnt_ >= 10), m as (select *, sum(cnt_) over (partition by target_name, s_sample) s, sum(cnt_) over (partition by target_name, s_sample, replicate_no) r from c)
          select cluster_id from m where s >= 50 and r >= 50""")
def prefilter_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.prefilter(table(spark, sf_dir, "clusters"), _KEY, "replicate_no", "cnt_", sample_least=50).select("cluster_id")


@query(_FRAC + "select target_name, s_sample, seq from hap where rep_cnt >= reps")
def exclude_by_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.in_all_replicates(_haps(spark, sf_dir)).select(*_KEY, "seq")


@query(_FRAC + "select target_name, s_sample, seq, round(avg_frac / sum(avg_frac) over (partition by target_name, s_sample), 9) avg_frac from hap where round(avg_frac, 12) >= 0.3")
def exclude_low_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _haps(spark, sf_dir).withColumn("avg_frac", F.round("avg_frac", 12))
    kept = samples.by_fraction(found, _KEY, 0.3)
    return kept.select(*_KEY, "seq", F.round("avg_frac", 9).alias("avg_frac"))


@query(_FRAC + """, custom as (select target_name, s_sample, 0.5::double cutoff from hap where s_sample like '%0' group by all)
          select target_name, s_sample, seq from hap left join custom using (target_name, s_sample) where round(avg_frac, 12) >= coalesce(cutoff, 0.25)""")
def custom_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut-offs named for some samples, a default for the others."""
    found = _haps(spark, sf_dir).withColumn("avg_frac", F.round("avg_frac", 12))
    custom = found.where(F.col("s_sample").endswith("0")).select(*_KEY).distinct().withColumn("cutoff", F.lit(0.5))
    return samples.by_fraction(found, _KEY, 0.25, custom).select(*_KEY, "seq")


@query(_FRAC + """, r as (select *, row_number() over (partition by target_name, s_sample order by round(avg_frac, 9) desc, seq) - 1 rank, count(*) over (partition by target_name, s_sample) n from hap)
          select target_name, s_sample, seq, rank::int rank, target_name || '.' || s_sample || '.' || lpad(rank::varchar, length(n::varchar)::int, '0') name from r""")
def rank_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _haps(spark, sf_dir).withColumn("avg_frac", F.round("avg_frac", 9))
    return samples.rank_clusters(found, _KEY).select(*_KEY, "seq", "rank", "name")


@query("""with u as (select target_name, upper(seq_) seq, sum(cnt_) avg_frac from clusters where seq_ is not null group by all)
          select a.target_name, a.seq, b.seq parent from u a join u b on a.target_name = b.target_name and a.avg_frac * 3 < b.avg_frac and abs(length(a.seq) - length(b.seq)) <= 1 and levenshtein(a.seq, b.seq) = 1""")
def one_off_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences one edit away from one of their target that has more than three times the reads."""
    unique = table(spark, sf_dir, "clusters").where("seq_ is not null").groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("avg_frac"))
    return samples.one_off_pairs(unique, ["target_name"], 3)


_POP = _FRAC + """, pop as (select target_name, seq, count(distinct s_sample) h_sampcnt, round(sum(avg_frac), 9) total_frac, sum(reads) reads from hap group by all),
 n as (select target_name, count(distinct s_sample) n_samples from hap group by 1),
 ranked as (select pop.*, n_samples, row_number() over (partition by target_name order by h_sampcnt desc, total_frac desc, seq) - 1 r, count(*) over (partition by target_name) k from pop join n using (target_name)) """


@query(_POP + "select target_name, seq, h_sampcnt, total_frac, reads, n_samples, 'pop-' || target_name || '.' || lpad(r::varchar, length(k::varchar)::int, '0') h_popuid, round(h_sampcnt / n_samples, 6) h_sampfrac from ranked")
def population_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.population(_haps(spark, sf_dir), ["s_sample"], "pop", ["target_name"])


@query(_FRAC + """, low as (select * from hap where round(avg_frac, 12) < 0.3), major as (select distinct target_name, seq from hap where round(avg_frac, 12) >= 0.5)
          select target_name, s_sample, seq from low where (target_name, seq) in (select (target_name, seq) from major)""")
def rescue_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes excluded for a low fraction that are major in another sample."""
    found = _haps(spark, sf_dir).withColumn("avg_frac", F.round("avg_frac", 12))
    return samples.rescue(found.where("avg_frac < 0.3"), found, ["target_name"], "seq", 0.5).select(*_KEY, "seq")


@query("""select h_popuid, min(s_sample) s_sample, count(*) n_rows from sample_info where h_popuid is not null and s_sample is not null group by 1 having count(distinct s_sample) = 1""")
def one_sample_only_haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_info").where("h_popuid is not null and s_sample is not null")
    return rows.groupBy("h_popuid").agg(F.min("s_sample").alias("s_sample"), F.max("s_sample").alias("_m"), F.count("*").alias("n_rows")).where("s_sample = _m").drop("_m")


@query("""with h as (select project_name, h_popuid, count(distinct s_sample) n, max(c_averagedfrac) filter (not isnan(c_averagedfrac)) top from sample_info where h_popuid is not null group by all)
          select project_name, h_popuid from h where n >= 3 and top < 0.05""")
def commonly_low_haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes of several samples that are never frequent."""
    frac = F.when(~F.isnan("c_averagedfrac"), F.col("c_averagedfrac"))
    h = table(spark, sf_dir, "sample_info").where("h_popuid is not null").groupBy("project_name", "h_popuid").agg(F.count_distinct("s_sample").alias("n"), F.max(frac).alias("top"))
    return h.where("n >= 3 and top < 0.05").select("project_name", "h_popuid")


@query("""with per as (select project_name, s_sample, count(distinct h_popuid) coi from sample_info where h_popuid is not null and s_sample is not null group by all),
          h as (select project_name, count(distinct h_popuid) haplotypes from sample_info where s_sample is not null group by 1)
          select project_name, count(*) samples, round(avg(coi), 6) mean_coi, median(coi)::double median_coi, min(coi) min_coi, max(coi) max_coi, any_value(haplotypes) haplotypes from per join h using (project_name) group by 1""")
def coi_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.coi_summary(table(spark, sf_dir, "sample_info").where("project_name is not null"), ["project_name"], "s_sample", "h_popuid")


@query("""with r as (select substr(s_sample, 1, 1) grp, s_sample, h_popuid from sample_info where h_popuid is not null and s_sample is not null), g as (select h_popuid, count(distinct grp) n, min(grp) grp from r group by 1),
          o as (select grp, count(*) only_here from g where n = 1 group by 1)
          select grp, count(distinct s_sample) samples, count(distinct h_popuid) haplotypes, coalesce(any_value(only_here), 0) only_here from r left join o using (grp) group by 1""")
def group_exclusive_haps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "sample_info").where("s_sample is not null").withColumn("grp", F.substring("s_sample", 1, 1))
    return samples.group_report(rows, "grp", "s_sample", "h_popuid")


@query("""with r as (select distinct project_name, substr(s_sample, 1, 1) grp, s_sample, h_popuid from sample_info where h_popuid is not null and s_sample is not null)
          select project_name, grp, count(distinct s_sample) samples, count(distinct h_popuid) haplotypes, grouping(project_name)::int all_projects, grouping(grp)::int all_groups
          from r group by grouping sets ((project_name, grp), (project_name), ())""")
def group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "sample_info").where("h_popuid is not null and s_sample is not null").select("project_name", F.substring("s_sample", 1, 1).alias("grp"), "s_sample", "h_popuid").distinct()
    sets = [[F.col("project_name"), F.col("grp")], [F.col("project_name")], []]
    return r.groupingSets(sets, "project_name", "grp").agg(
        F.count_distinct("s_sample").alias("samples"), F.count_distinct("h_popuid").alias("haplotypes"), F.grouping("project_name").cast("int").alias("all_projects"), F.grouping("grp").cast("int").alias("all_groups")
    )


@query("""select h_popuid, count(distinct case when c_repcnt = 1 then s_sample end) rep1, count(distinct case when c_repcnt = 2 then s_sample end) rep2, count(distinct case when c_repcnt = 3 then s_sample end) rep3
          from sample_info where h_popuid is not null group by 1""")
def replicate_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotype x replicate count as a matrix with a fixed list of columns."""
    rows = table(spark, sf_dir, "sample_info").where("h_popuid is not null")
    return rows.groupBy("h_popuid").agg(*(F.count_distinct(F.when(F.col("c_repcnt") == k, F.col("s_sample"))).alias(f"rep{k}") for k in (1, 2, 3)))


@query("""select h_popuid, s_sample, max(c_averagedfrac) filter (not isnan(c_averagedfrac)) frac from sample_info where h_popuid is not null and s_sample is not null group by all""")
def hap_id_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The haplotype x sample matrix in long form; a pivot is taken only for samples somebody asks for (query API)."""
    frac = F.when(~F.isnan("c_averagedfrac"), F.col("c_averagedfrac"))
    return table(spark, sf_dir, "sample_info").where("h_popuid is not null and s_sample is not null").groupBy("h_popuid", "s_sample").agg(F.max(frac).alias("frac"))


@query("""with r as (select distinct s_sample, replicate_no from clusters where replicate_no is not null and s_sample is not null), l as (select s_sample, list_sort(list(replicate_no)) v from r group by 1)
          select s_sample, v[1] run1, v[2] run2, v[3] run3, len(v)::int runs from l""")
def replicate_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.wide_runs(table(spark, sf_dir, "clusters").where("s_sample is not null"), ["s_sample"], "replicate_no")


@query("""select upper(seq_) seq, string_agg(distinct s_sample, ':' order by s_sample) names, count(*) n from clusters where seq_ is not null and s_sample is not null group by 1""")
def joined_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clusters").where("seq_ is not null and s_sample is not null").select(F.upper("seq_").alias("seq"), "s_sample")
    return samples.joined_names(rows, "seq", "s_sample")


@query("""with m as (select target_name, fwd_primer, rev_primer, dense_rank() over (order by fwd_primer, rev_primer) r, count(*) over () n from targets)
          select target_name, 'MID' || lpad(r::varchar, length(n::varchar)::int, '0') mid from m""")
def manifest_mid_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode pairs named by their rank in order; the manifest is a small table by nature."""
    t = table(spark, sf_dir, "targets")
    pairs = t.select("fwd_primer", "rev_primer").distinct()
    rank = F.row_number().over(Window.orderBy("fwd_primer", "rev_primer"))
    named = pairs.withColumn("_r", rank).crossJoin(F.broadcast(t.agg(F.count("*").alias("_n"))))
    return t.join(named, ["fwd_primer", "rev_primer"]).select("target_name", F.concat(F.lit("MID"), F.lpad(F.col("_r").cast("string"), F.length(F.col("_n").cast("string")), F.lit("0"))).alias("mid"))


@query("""select s_sample, 'no_info' problem from (select distinct s_sample from clusters where s_sample is not null) where s_sample not in (select s_sample from sample_info where s_sample is not null)
          union all select s_sample, 'no_clusters' from (select distinct s_sample from sample_info where s_sample is not null) where s_sample not in (select s_sample from clusters where s_sample is not null)""")
def metadata_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = table(spark, sf_dir, "clusters"), table(spark, sf_dir, "sample_info")
    one = mixtures.unknown_references(a, b, "s_sample").withColumn("problem", F.lit("no_info"))
    return one.unionByName(mixtures.unknown_references(b, a, "s_sample").withColumn("problem", F.lit("no_clusters")))


@query("""select s_sample from cluster_runs where s_sample is not null intersect select s_sample from clusters""")
def set_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cluster_runs").select("s_sample").where("s_sample is not null").intersect(table(spark, sf_dir, "clusters").select("s_sample"))


@query("""select s_sample from sample_info where s_sample is not null except select s_sample from cluster_runs""")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "sample_info").select("s_sample").where("s_sample is not null").subtract(table(spark, sf_dir, "cluster_runs").select("s_sample"))


@query("""select s_sample, target_name, cnt_ n, null::bigint run_id, 'clusters' src from clusters union all select s_sample, target_name, null, run_id, 'runs' from cluster_runs""")
def union_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "clusters").select("s_sample", "target_name", F.col("cnt_").alias("n"), F.lit("clusters").alias("src"))
    b = table(spark, sf_dir, "cluster_runs").select("s_sample", "target_name", "run_id", F.lit("runs").alias("src"))
    return a.unionByName(b, allowMissingColumns=True)


_MIX = """with m as (select o_orderpriority mix, o_orderstatus strain, sum(case when o_totalprice > 1000 then 1 else 0 end) amount from orders group by all) """


def _mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("mix"), F.col("o_orderstatus").alias("strain")).agg(F.sum(F.when(F.col("o_totalprice") > 1000, 1).otherwise(0)).alias("amount"))


@query(_MIX + "select mix, strain, amount, amount / sum(amount) over (partition by mix) relative from m where amount > 0")
def mixture_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures.normalise(_mix(spark, sf_dir), "mix", "strain", "amount")


@query(_MIX + "select mix, strain, amount, amount / sum(amount) over (partition by mix) relative from m where amount > 0 and strain <> 'P'")
def mixture_without_strain(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = spark.createDataFrame([("P",)], "strain string")
    return mixtures.without_strains(_mix(spark, sf_dir), "mix", "strain", "amount", removed)


_BENCH = """with v as (select project_name, s_sample, h_popuid, max(c_averagedfrac) obs_frac from sample_info where project_name is not null and s_sample is not null and h_popuid is not null and not isnan(c_averagedfrac) and c_averagedfrac between 0 and 1 group by all),
 p as (select project_name, h_popuid, count(*) n from v group by all),
 e as (select project_name, h_popuid, n from p qualify row_number() over (partition by project_name order by n desc, h_popuid) <= 3),
 exp as (select e.project_name, s_sample, e.h_popuid, n / sum(n) over (partition by e.project_name, s_sample) exp_frac from e join (select distinct project_name, s_sample from v) using (project_name)),
 c as (select project_name, s_sample, h_popuid, obs_frac, exp_frac, case when exp_frac is null then 'false' when obs_frac is null then 'missing' else 'recovered' end state from v full join exp using (project_name, s_sample, h_popuid)) """


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observed fractions of every sample against an expectation: the three commonest haplotypes of its project."""
    info = table(spark, sf_dir, "sample_info").where("project_name is not null and s_sample is not null and h_popuid is not null and not isnan(c_averagedfrac) and c_averagedfrac between 0 and 1")
    obs = info.groupBy("project_name", "s_sample", "h_popuid").agg(F.max("c_averagedfrac").alias("obs_frac"))
    common = obs.groupBy("project_name", "h_popuid").agg(F.count("*").alias("n"))
    top = common.withColumn("_r", F.row_number().over(Window.partitionBy("project_name").orderBy(F.desc("n"), "h_popuid"))).where("_r <= 3")
    total = top.groupBy("project_name").agg(F.sum("n").alias("_t"))
    expected = top.join(total, "project_name").join(obs.select("project_name", "s_sample").distinct(), "project_name").select("project_name", "s_sample", "h_popuid", (F.col("n") / F.col("_t")).alias("exp_frac"))
    return mixtures.compare(obs, expected, ["project_name", "s_sample"], "h_popuid")


@query(_BENCH + """select project_name, s_sample, count(*) filter (state = 'recovered') recovered, count(*) filter (state = 'false') false_haps, count(*) filter (state = 'missing') missing,
 count(*) filter (state <> 'missing') total, count(*) filter (state <> 'false') expected, round(count(*) filter (state = 'recovered') / nullif(count(*) filter (state <> 'false'), 0), 6) recovery_rate,
 round(count(*) filter (state = 'false') / nullif(count(*) filter (state <> 'missing'), 0), 6) false_rate,
 round(sqrt(sum(case when state = 'recovered' then pow(obs_frac - exp_frac, 2) end) / nullif(count(*) filter (state = 'recovered'), 0)), 6) rmse from c group by all""")
def benchmark_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixtures.metrics(_compared(spark, sf_dir), ["project_name", "s_sample"])


@query(_BENCH + "select project_name, s_sample, h_popuid, exp_frac from c where state = 'missing'")
def missing_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir).where("state = 'missing'").select("project_name", "s_sample", "h_popuid", "exp_frac")


@query(_BENCH + """, f as (select c.project_name, c.s_sample, c.h_popuid, e.h_popuid other, abs(c.obs_frac - e.exp_frac) d from c join exp e on c.project_name = e.project_name and c.s_sample = e.s_sample where c.state = 'false')
 select project_name, s_sample, h_popuid, other, round(d, 9) d, d = min(d) over (partition by project_name, s_sample, h_popuid) best from f""")
def false_hap_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every false haplotype against its sample's expected ones, the nearest fraction marked."""
    c = _compared(spark, sf_dir)
    false = c.where("state = 'false'").select("project_name", "s_sample", "h_popuid", "obs_frac")
    expected = c.where("state != 'false'").select("project_name", "s_sample", F.col("h_popuid").alias("other"), "exp_frac")
    met = false.join(expected, ["project_name", "s_sample"]).withColumn("d", F.abs(F.col("obs_frac") - F.col("exp_frac"))).withColumn("_near", -F.col("d"))
    return mixtures.best_flag(met, ["project_name", "s_sample", "h_popuid"], "_near").select("project_name", "s_sample", "h_popuid", "other", F.round("d", 9).alias("d"), "best")


@query(_BENCH + "select project_name, s_sample, h_popuid, case when obs_frac = max(obs_frac) over (partition by project_name, s_sample) then 'major' else 'minor' end class from v")
def major_minor(spark: SparkSession, sf_dir: str) -> DataFrame:
    obs = _compared(spark, sf_dir).where("obs_frac is not null")
    return mixtures.classed(obs, ["project_name", "s_sample"], "obs_frac").select("project_name", "s_sample", "h_popuid", "class")


@query("""with m as (select s_sample, count(*) n, sum(cnt_) reads from clusters where s_sample is not null group by 1) select s.s_sample, coalesce(n, 0) n, coalesce(reads, 0) reads
          from (select distinct s_sample from sample_info where s_sample is not null) s left join m using (s_sample)""")
def samples_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "clusters").groupBy("s_sample").agg(F.count("*").alias("n"), F.sum("cnt_").alias("reads"))
    return mixtures.fill_missing_samples(counts, table(spark, sf_dir, "sample_info").where("s_sample is not null"), ["s_sample"], ["n", "reads"])


@query("""with e as (select target_name, upper(seq_) seq, string_agg(distinct cluster_id::varchar, ',' order by cluster_id::varchar) name, sum(cnt_) frac from clusters where seq_ is not null group by all)
          select * from e""")
def merge_identical_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clusters").where("seq_ is not null").select("target_name", F.upper("seq_").alias("seq"), F.col("cluster_id").cast("string").alias("name"), F.col("cnt_").alias("frac"))
    return mixtures.merge_identical(rows, ["target_name"], "seq", "name", "frac")


@query("""with u as (select target_name, upper(seq_) seq, min(cluster_id) id, sum(cnt_) cnt from clusters where seq_ is not null group by all), r as (select * from u qualify row_number() over (partition by target_name, length(seq) order by cnt desc, seq) = 1),
          d as (select u.target_name, length(r.seq) len, u.cnt, u.seq, r.seq ref from u join r on u.target_name = r.target_name and length(u.seq) = length(r.seq)),
          x as (select target_name, len, cnt, i pos, substr(ref, i, 1) ref_base, substr(seq, i, 1) base from d, lateral (select unnest(range(1, len + 1)) i))
          select target_name, len, pos::int pos, ref_base, base, count(*) seqs, sum(cnt) reads from x where ref_base <> base group by all""")
def snp_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of sequences to the most abundant one of their target and length."""
    unique = table(spark, sf_dir, "clusters").where("seq_ is not null").groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt")).withColumn("len", F.length("seq"))
    refs = unique.groupBy("target_name", "len").agg(F.min_by("seq", F.struct(-F.col("cnt"), "seq")).alias("ref"))
    return collapse.difference_table(unique, refs, ["target_name", "len"], "seq", "ref", "cnt")


_UNIQUE = """u0 as (select target_name, replicate_no, s_sample, upper(seq_) seq, sum(cnt_) cnt from clusters where seq_ is not null and s_sample is not null and replicate_no is not null and target_name is not null group by all)"""
_PARENTS = """
 m as (select a.target_name, a.s_sample, a.replicate_no, a.seq, p.seq parent, coalesce(list_min(list_filter(range(1, least(length(a.seq), length(p.seq)) + 1), lambda i: a.seq[i] <> p.seq[i])) - 1, least(length(a.seq), length(p.seq))) pre,
 coalesce(list_min(list_filter(range(1, least(length(a.seq), length(p.seq)) + 1), lambda i: a.seq[-i] <> p.seq[-i])) - 1, least(length(a.seq), length(p.seq))) suf
 from u a join u p on a.target_name = p.target_name and a.s_sample = p.s_sample and a.replicate_no = p.replicate_no and p.cnt >= 2 * a.cnt and a.seq <> p.seq),
 b as (select l.target_name, l.s_sample, l.replicate_no, l.seq, min((-l.pre, l.parent, -r.suf, r.parent)) x from m l join m r using (target_name, s_sample, replicate_no, seq)
 where l.pre > 0 and r.suf > 0 and l.parent <> r.parent and l.pre + r.suf >= length(seq) group by all)
 select target_name, s_sample, replicate_no, seq, x[2] left_parent, x[4] right_parent from b"""


_CHI = f"with {_UNIQUE}, u as (select * from u0)," + _PARENTS
_PLANTED = f"""with {_UNIQUE}, o as (select *, row_number() over (partition by target_name, s_sample, replicate_no order by cnt desc, seq) r from u0),
 pl as (select a.target_name, a.replicate_no, a.s_sample, substr(a.seq, 1, 60) || substr(b.seq, 61) seq, 0::double cnt from o a join o b using (target_name, s_sample, replicate_no) where a.r = 1 and b.r = 2),
 u as (select target_name, replicate_no, s_sample, seq, sum(cnt) cnt from (select * from u0 union all by name select * from pl) group by all),""" + _PARENTS


@query(_CHI)
def chimera_two_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = ["target_name", "s_sample", "replicate_no"]
    return collapse.chimeras(_unique(spark, sf_dir, key), key)


def _unique(spark: SparkSession, sf_dir: str, key: list[str]) -> DataFrame:
    return table(spark, sf_dir, "clusters").where("seq_ is not null").dropna(subset=key).groupBy(*key, F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt"))


@query(_PLANTED)
def chimera_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``chimera_two_parent``, after the front of every key's commonest sequence was joined to the end of its second one."""
    key = ["target_name", "s_sample", "replicate_no"]
    unique = _unique(spark, sf_dir, key)
    ranked = unique.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("cnt"), "seq"))).where("r <= 2")
    one, two = ranked.where("r = 1").select(*key, F.col("seq").alias("a")), ranked.where("r = 2").select(*key, F.col("seq").alias("b"))
    planted = one.join(two, key).select(*key, F.concat(F.substring("a", 1, 60), F.expr("substr(b, 61)")).alias("seq"), F.lit(0.0).alias("cnt"))
    return collapse.chimeras(unique.unionByName(planted).groupBy(*key, "seq").agg(F.sum("cnt").alias("cnt")), key)


@query("""select target_name, count(*) clusters, count(*) filter (chimera) chimeras, sum(cnt_) reads, coalesce(sum(cnt_) filter (chimera), 0) chimera_reads,
          printf('%d(%.2f%%)', count(*) filter (chimera), count(*) filter (chimera) * 100.0::double / count(*)) share from clusters group by 1""")
def chimera_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.names import percent

    c = table(spark, sf_dir, "clusters").groupBy("target_name").agg(
        F.count("*").alias("clusters"), F.count_if("chimera").alias("chimeras"), F.sum("cnt_").alias("reads"), F.coalesce(F.sum(F.when(F.col("chimera"), F.col("cnt_"))), F.lit(0.0)).alias("chimera_reads")
    )
    return c.withColumn("share", percent(F.col("chimeras"), F.col("clusters")))


@query()
def collapse_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-tolerant collapse of each target's sequences of a sample: one mismatch or one-base gap, then up to three."""
    rounds = [collapse.Round(100, 3, hq=1, indel1=1), collapse.Round(100, 3, hq=3, lq=5, indel1=2)]
    rows = table(spark, sf_dir, "clusters").dropna(subset=_KEY)
    return collapse.collapse(rows, _KEY, "seq_", "cnt_", rounds, "qual_")


@query()
def otu_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse.collapse(table(spark, sf_dir, "clusters").dropna(subset=_KEY), _KEY, "seq_", "cnt_", [collapse.Round(100, 0, identity=0.97)] * 2)


@query()
def spanning_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = table(spark, sf_dir, "clusters").where("seq_ is not null").dropna(subset=_KEY).select(*_KEY, F.upper("seq_").alias("seq")).distinct()
    return collapse.spanning_edges(unique, _KEY)


@query("""with r as (select run_id, upper(seq_) s, count(*) n from seq_reads where seq_ is not null group by all) select run_id, count(*) uniques, count(*) filter (n = 1) singles, max(n) largest from r group by 1""")
def singletons_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = reads.dereplicate(table(spark, sf_dir, "seq_reads"), ["run_id"], "seq_", "cnt_", "read_id")
    return unique.groupBy("run_id").agg(F.count("*").alias("uniques"), F.count_if(F.col("reads") == 1).alias("singles"), F.max("reads").alias("largest"))


@query("""with c as (select s_sample, count(*) filter (contains(name_, '_t1')) marked, count(*) reads from clusters where s_sample is not null group by 1) select *, marked * 100 > reads * 98 and reads > 1 dropped from c""")
def one_direction_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.one_direction_clusters(table(spark, sf_dir, "clusters").where("s_sample is not null"), ["s_sample"], "name_", "_t1")


@query("""select target_name, greatest(min(length(seq_)) - 20, 0) minlen, max(length(seq_)) + 20 maxlen, max(length(seq_)) + 20 > 250 no_overlap,
          case when min(length(seq_)) < 150 then 'R1BEGINSINR2' when max(length(seq_)) < 290 then 'R1ENDSINR2' else 'NOOVERLAP' end status from clusters where seq_ is not null group by 1""")
def reference_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length limits and the overlap to expect with reads of 150 bases, from a target's sequences."""
    n = F.length("seq_")
    c = table(spark, sf_dir, "clusters").where("seq_ is not null").groupBy("target_name").agg(F.min(n).alias("_lo"), F.max(n).alias("_hi"))
    status = F.when(F.col("_lo") < 150, "R1BEGINSINR2").when(F.col("_hi") < 290, "R1ENDSINR2").otherwise("NOOVERLAP")
    return c.select("target_name", F.greatest(F.col("_lo") - 20, F.lit(0)).alias("minlen"), (F.col("_hi") + 20).alias("maxlen"), (F.col("_hi") + 20 > 250).alias("no_overlap"), status.alias("status"))


@query("""with s as (select target_name, case when length(seq_) < 150 then 'R1BEGINSINR2' when length(seq_) < 290 then 'R1ENDSINR2' else 'NOOVERLAP' end st, count(*) n from clusters where seq_ is not null group by all)
          select target_name, arg_max(st, (n, -case st when 'R1ENDSINR2' then 0 when 'R1BEGINSINR2' then 1 else 2 end)) status, sum(n) total from s group by 1""")
def auto_overlap_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The overlap status of most reads of a target; on equal counts the usual one comes first."""
    n = F.length("seq_")
    st = F.when(n < 150, "R1BEGINSINR2").when(n < 290, "R1ENDSINR2").otherwise("NOOVERLAP")
    order = F.when(F.col("st") == "R1ENDSINR2", 0).when(F.col("st") == "R1BEGINSINR2", 1).otherwise(2)
    s = table(spark, sf_dir, "clusters").where("seq_ is not null").groupBy("target_name", st.alias("st")).agg(F.count("*").alias("n"))
    return s.groupBy("target_name").agg(F.max_by("st", F.struct("n", -order)).alias("status"), F.sum("n").alias("total"))


@query("""with u as (select distinct target_name, upper(seq_) s from clusters where seq_ is not null)
          select target_name, s seq, array_to_string(list_transform(range(1, length(s) - 1, 3), lambda i: case when regexp_full_match(substr(s, i, 3), '[ACGT]{3}') then
          substr('FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG', (16 * (strpos('TCAG', s[i]) - 1) + 4 * (strpos('TCAG', s[i + 1]) - 1) + strpos('TCAG', s[i + 2]))::int, 1) else 'X' end), '') protein from u""")
def translated_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import variants

    unique = table(spark, sf_dir, "clusters").where("seq_ is not null").select("target_name", F.upper("seq_").alias("seq")).distinct()
    return unique.withColumn("protein", variants.translate(F.col("seq")))


@query("""with h as (select project_name, h_popuid, count(distinct s_sample) n from sample_info where project_name is not null and h_popuid is not null and s_sample is not null group by all),
          t as (select project_name, sum(n) s, count(*) haplotypes, sum(n * n) q from h group by 1)
          select project_name, haplotypes, round(s / (s - 1) * (1 - q / (s * s)), 6) he, round(1 / (q / (s * s)), 6) effective from t""")
def population_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import variants

    rows = table(spark, sf_dir, "sample_info").where("project_name is not null and h_popuid is not null and s_sample is not null")
    return variants.diversity(rows.groupBy("project_name", "h_popuid").agg(F.count_distinct("s_sample").alias("n")), ["project_name"], "n")


@query()
def candidate_barcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First eight bases of every run's reads, collapsed into candidate barcodes."""
    from ..operators import barcodes

    starts = table(spark, sf_dir, "seq_reads").where("length(seq_) >= 8").select("run_id", F.upper(F.substring("seq_", 1, 8)).alias("start"))
    return barcodes.candidates(starts, "run_id", "start")


@query("""select s_sample, n_name, count(*) n from (select s_sample, regexp_replace(lower(trim(s_name)), '[^a-z0-9]+', '-', 'g') n_name from sample_info where s_sample is not null and s_name is not null) group by all""")
def sample_name_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display names brought to one form, with the number of rows of each."""
    rows = table(spark, sf_dir, "sample_info").where("s_sample is not null and s_name is not null")
    return rows.groupBy("s_sample", F.regexp_replace(F.lower(F.trim("s_name")), "[^a-z0-9]+", "-").alias("n_name")).agg(F.count("*").alias("n"))


@query("""select h_popuid, max(h_sampcnt) stated, count(distinct s_sample) counted from sample_info where h_popuid is not null group by 1 having max(h_sampcnt) is distinct from count(distinct s_sample)""")
def stale_sample_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes whose stated number of samples isn't the number found."""
    h = table(spark, sf_dir, "sample_info").where("h_popuid is not null").groupBy("h_popuid").agg(F.max("h_sampcnt").alias("stated"), F.count_distinct("s_sample").alias("counted"))
    return h.where(~F.col("stated").eqNullSafe(F.col("counted")))


@query("""with u as (select target_name, upper(seq_) seq, sum(cnt_) cnt from clusters where seq_ is not null and target_name is not null group by all),
          r as (select target_name, seq, 'e' || row_number() over (partition by target_name order by cnt desc, seq) n from u qualify row_number() over (partition by target_name order by cnt desc, seq) <= 3),
          b as (select u.target_name, u.seq, min((levenshtein(u.seq, r.seq)::int, n)) x from u join r on u.target_name = r.target_name group by all)
          select target_name, seq, x[2] best, x[1] distance from b""")
def best_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest of the three most abundant sequences of the target."""
    from ..operators import manifest

    rows = table(spark, sf_dir, "clusters").where("seq_ is not null and target_name is not null")
    unique = rows.groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("target_name").orderBy(F.desc("cnt"), "seq"))
    top = unique.withColumn("_r", rank).where("_r <= 3").withColumn("n", F.concat(F.lit("e"), F.col("_r").cast("string")))
    return manifest.best_expected(rows, ["target_name"], "seq_", top, "n", "seq")


@query("""with u as (select distinct target_name, s_sample, upper(seq_) s from clusters where seq_ is not null and target_name is not null and s_sample is not null)
          select x.target_name, x.s_sample, x.s a, y.s b, levenshtein(x.s, y.s)::int distance from u x join u y on x.target_name = y.target_name and x.s_sample = y.s_sample and x.s < y.s""")
def all_by_all_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import manifest

    return manifest.pairwise_distances(table(spark, sf_dir, "clusters").dropna(subset=_KEY), _KEY, "seq_")


@query("""select target_name, 'runs' missing_in from (select distinct target_name from targets where target_name not in (select target_name from cluster_runs where target_name is not null))
          union all select target_name, 'targets' from (select distinct target_name from cluster_runs where target_name is not null and target_name not in (select target_name from targets))""")
def target_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import manifest

    return manifest.disagreement(table(spark, sf_dir, "targets"), table(spark, sf_dir, "cluster_runs"), "target_name", "targets", "runs")


@query("""select target_name || '.0' name, upper(fwd_primer) seq from targets where regexp_full_match(upper(fwd_primer), '[ACGT]+')""")
def primers_as_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators import manifest

    plain = table(spark, sf_dir, "targets").where("upper(fwd_primer) rlike '^[ACGT]+$'")
    return manifest.primers_as_records(plain, "target_name", "fwd_primer")


@query("select s_sample, h_popuid, count(*) n from sample_info where s_sample is null or s_sample not in ('MIXCTRL-00') group by all")
def excluded_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything but the control sample."""
    return reads.exclude_named(table(spark, sf_dir, "sample_info"), "s_sample", ["MIXCTRL-00"]).groupBy("s_sample", "h_popuid").agg(F.count("*").alias("n"))


@query("""with u as (select target_name, s_sample, upper(seq_) seq, sum(cnt_) cnt, coalesce(sum(cnt_) filter (chimera), 0) chi from clusters where seq_ is not null and target_name is not null and s_sample is not null group by all)
          select target_name, s_sample, seq, cnt, coalesce(chi / nullif(cnt, 0) >= 0.4, false) chimera from u""")
def chimera_by_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cluster is a chimera if two fifths of its reads came from chimeric ones."""
    rows = table(spark, sf_dir, "clusters").where("seq_ is not null and target_name is not null and s_sample is not null").withColumn("seq", F.upper("seq_"))
    return collapse.chimera_by_fraction(rows, ["target_name", "s_sample", "seq"], "cnt_", "chimera", 0.4)


@query("""with u as (select target_name, upper(seq_) seq, sum(cnt_) cnt from clusters where seq_ is not null and target_name is not null group by all), r as (select * from u qualify row_number() over (partition by target_name, length(seq) order by cnt desc, seq) = 1),
          d as (select u.target_name, length(r.seq) len, u.cnt, u.seq, r.seq ref from u join r on u.target_name = r.target_name and length(u.seq) = length(r.seq)), t as (select target_name, len, sum(cnt) total from d group by all),
          x as (select target_name, len, cnt, i pos, substr(ref, i, 1) ref_base, substr(seq, i, 1) base from d, lateral (select unnest(range(1, len + 1)) i)),
          p as (select target_name, len, pos::int pos, ref_base, base, sum(cnt) reads from x where ref_base <> base group by all)
          select target_name, len, pos, ref_base, base, reads, round(reads / total, 6) fraction from p join t using (target_name, len) where reads >= 10 and reads >= 0.05 * total""")
def snp_breakout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions at which so many reads differ from the commonest sequence that it should be broken up: ten, and a twentieth."""
    unique = table(spark, sf_dir, "clusters").where("seq_ is not null and target_name is not null").groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt")).withColumn("len", F.length("seq"))
    refs = unique.groupBy("target_name", "len").agg(F.min_by("seq", F.struct(-F.col("cnt"), "seq")).alias("ref"))
    return collapse.snp_breakout(unique, refs, ["target_name", "len"], "seq", "ref", "cnt", least=10, share=0.05).withColumn("fraction", F.round("fraction", 6))


@query("""with f as (select project_name, s_sample, h_popuid, max(c_averagedfrac) filter (not isnan(c_averagedfrac)) avg_frac from sample_info where project_name is not null and s_sample is not null and h_popuid is not null group by all),
          major as (select distinct project_name, h_popuid from f where avg_frac >= 0.5) select project_name, s_sample, h_popuid, avg_frac from f where avg_frac < 0.1 and (project_name, h_popuid) in (select (project_name, h_popuid) from major)""")
def rescued_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Haplotypes of a low fraction that are major in another sample of their project."""
    rows = table(spark, sf_dir, "sample_info").dropna(subset=["project_name", "s_sample", "h_popuid"])
    frac = F.max(F.when(~F.isnan("c_averagedfrac"), F.col("c_averagedfrac")))
    found = rows.groupBy("project_name", "s_sample", "h_popuid").agg(frac.alias("avg_frac"))
    return samples.rescue(found.where("avg_frac < 0.1"), found, ["project_name"], "h_popuid")


@query("""with a as (select c_name, min(h_popuid) uid from sample_info where c_name is not null group by 1), b as (select h_popuid, min(h_aatyped) typed from sample_info where h_popuid is not null group by 1),
          r as (select distinct s_sample, c_name from sample_info) select s_sample, c_name, coalesce(uid, '') uid, coalesce(typed, '') typed from r left join a using (c_name) left join b on b.h_popuid = a.uid""")
def typed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cluster with its haplotype and that haplotype's translation, by two lookups."""
    info = table(spark, sf_dir, "sample_info")
    first, second = info.select(F.col("c_name").alias("key"), F.col("h_popuid").alias("uid")), info.select(F.col("h_popuid").alias("uid"), F.col("h_aatyped").alias("typed"))
    return samples.two_hop(info.select("s_sample", "c_name").distinct(), "c_name", first, second)


@query("select s_sample, h_popuid, count(*) n from sample_info group by all")
def commonest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per sample and haplotype, the commonest first."""
    return reads.sorted_counts(table(spark, sf_dir, "sample_info"), ["s_sample", "h_popuid"])
