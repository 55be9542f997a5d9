"""Queries over raw reads and clusters: filters, cascades, dereplication, consensus, matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, quality
from ..functions import sequence as sq
from ..operators import matching, reads
from .registry import query, spread_table, table

_Q = "list_transform(qual_, lambda x: x::int)"
_REVCOMP = "translate(reverse({}), 'ACGTRYSWKMBDHVNacgtryswkmbdhvn', 'TGCAYRSWMKVHDBNtgcayrswmkvhdbn')"


@query("""select run_id, upper(seq_) seq, count(*) reads, coalesce(sum(cnt_), 0) cnt, min(read_id) first_id
          from seq_reads where seq_ is not null group by all""")
def dereplicate_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.dereplicate(table(spark, sf_dir, "seq_reads"), ["run_id"], "seq_", "cnt_", "read_id")


@query("""with u as (select target_name, upper(seq_) seq, sum(cnt_) cnt from clusters where seq_ is not null and target_name is not null group by all),
          f as (select *, cnt / sum(cnt) over (partition by target_name) frac,
                row_number() over (partition by target_name order by cnt desc, seq) r from u)
          select target_name, seq, cnt, round(frac, 9) frac, r rank from f where r <= 10""")
def flagship_top_haplotypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dereplicated sequences of each target with their share of its reads; the ten most abundant of every target."""
    from pyspark.sql import Window

    unique = table(spark, sf_dir, "clusters").where("seq_ is not null and target_name is not null").groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt"))
    total = unique.groupBy("target_name").agg(F.sum("cnt").alias("total"))
    w = Window.partitionBy("target_name").orderBy(F.desc("cnt"), "seq")
    top = unique.withColumn("rank", F.row_number().over(w)).where("rank <= 10")
    return top.join(total, "target_name").select("target_name", "seq", "cnt", F.round(F.col("cnt") / F.col("total"), 9).alias("frac"), "rank")


@query(f"""select read_id, run_id, loaded_at, regexp_replace(seq_, '[a-z]', '', 'g') seq,
           case when length(seq_) = len(qual_) then len(list_filter({_Q}, lambda q, i: seq_[i] between 'A' and 'Z')) end n_qual from seq_reads""")
def lower_case_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "seq_reads", "read_id", "run_id", "loaded_at", "seq_", "qual_")
    return rows.select("read_id", "run_id", "loaded_at", sq.remove_lower(F.col("seq_")).alias("seq"), F.size(sq.keep_upper_qualities(F.col("seq_"), F.col("qual_"))).alias("n_qual")).replace(-1, None, ["n_qual"])


@query(f"""with t as (select read_id, loaded_at, least(coalesce(nullif(list_position(list_transform({_Q}, lambda x: coalesce(x <= 2, false)), true), 0) - 1, length(seq_)), length(seq_)) trimmed_len
           from seq_reads) select *, coalesce(trimmed_len = 0, false) starts_bad from t""")
def trim_first_bad_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.trim_first_bad(table(spark, sf_dir, "seq_reads"), "seq_", "qual_").select("read_id", "loaded_at", "trimmed_len", "starts_bad")


@query(f"""select read_id, loaded_at, coalesce(len(qual_) > 0 and len(list_filter({_Q}, lambda x: x >= 30)) * 100 >= len(qual_) * 90, false) ok from seq_reads""")
def quality_fraction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seq_reads").select("read_id", "loaded_at", quality.fraction_ok(F.col("qual_")).alias("ok"))


@query(f"""with w as (select read_id, loaded_at, len(qual_) n, list_filter(range(1, greatest(len(qual_) - 48, 2), 5), lambda i: len(qual_) >= 50 and
           coalesce(list_sum(list_slice({_Q}, i, i + 49)), 0) < 1250) bad from seq_reads)
           select read_id, loaded_at, len(bad) = 0 ok, case when len(bad) > 0 then bad[1] - 1 else n end keep from w where n is not null""")
def quality_window_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of 50 by 5 at a mean of 25: whether all pass, and how many bases a trim keeps."""
    q = F.col("qual_")
    rows = spread_table(spark, sf_dir, "seq_reads", "read_id", "loaded_at", "qual_").where(q.isNotNull())
    return rows.select("read_id", "loaded_at", quality.windows_ok(q).alias("ok"), quality.window_trim_length(q).cast("long").alias("keep"))


@query(f"""with w as (select read_id, loaded_at, list_filter(range(1, greatest(len(qual_) - 3, 2)), lambda i: len(qual_) >= 5 and
           coalesce(list_sum(list_slice({_Q}, i, i + 4)), 0) < 125) bad from seq_reads where qual_ is not null)
           select read_id, loaded_at, bad[1] first_bad, bad[-1] last_bad, len(bad) n_bad from w""")
def failing_quality_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last failing window of five bases, as used to retry an overlap."""
    rows = spread_table(spark, sf_dir, "seq_reads", "read_id", "loaded_at", "qual_").where("qual_ is not null").withColumn("_bad", quality.failing_windows(F.col("qual_"), 5, 1, 25))
    return rows.select("read_id", "loaded_at", F.get("_bad", F.lit(0)).cast("long").alias("first_bad"), F.try_element_at("_bad", F.lit(-1)).cast("long").alias("last_bad"), F.size("_bad").cast("long").alias("n_bad"))


_CASE = """case when length(seq_) < minlen then 'MINLENBAD' when regexp_matches(seq_, '[Nn]') then 'CONTAINSNS' when length(seq_) > maxlen then 'MAXLENBAD'
           when not coalesce(len(qual_) > 0 and len(list_filter(qual_, lambda x: x >= 30)) * 100 >= len(qual_) * 90, false) then 'QUALITYFAILED' else 'GOOD' end"""
_PCASE = """case when regexp_matches(seq_, '[Nn]') then 'CONTAINSNS'
           when not coalesce(len(qual_) > 0 and len(list_filter(qual_, lambda x: x >= 30)) * 100 >= len(qual_) * 90, false) then 'QUALITYFAILED'
           when length(seq_) < minlen then 'MINLENBAD' when length(seq_) > maxlen then 'MAXLENBAD' else 'GOOD' end"""
_COUNTS = "count(*) filter (c = 'GOOD') good, count(*) filter (c = 'MINLENBAD') minlenbad, count(*) filter (c = 'CONTAINSNS') containsns, count(*) filter (c = 'MAXLENBAD') maxlenbad, count(*) filter (c = 'QUALITYFAILED') qualityfailed, count(*) total"


def _with_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "clusters").join(table(spark, sf_dir, "targets").select("target_name", "minlen", "maxlen"), "target_name")


@query(f"with x as (select target_name, {_CASE} c from clusters join targets using (target_name)) select target_name, {_COUNTS} from x group by 1")
def filter_cascade_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_limits(spark, sf_dir).withColumn("case", reads.single_end_case("seq_", "qual_", F.col("minlen"), F.col("maxlen")))
    return reads.case_counts(rows, ["target_name"])


@query(f"with x as (select target_name, {_PCASE} c from clusters join targets using (target_name)) select target_name, {_COUNTS} from x group by 1")
def filter_cascade_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _with_limits(spark, sf_dir).withColumn("case", reads.paired_case("seq_", "qual_", F.col("minlen"), F.col("maxlen")))
    return reads.case_counts(rows, ["target_name"])


@query(f"""with x as (select target_name, {_CASE} c from clusters join targets using (target_name)), t as (select target_name, count(*) total, count(*) filter (c = 'GOOD') good,
           count(*) filter (c <> 'GOOD') bad, count(*) filter (c = 'CONTAINSNS') ns, count(*) filter (c = 'QUALITYFAILED') q from x group by 1)
           select target_name, total, printf('%d(%.2f%%)', good, good * 100.0::double / total) good, printf('%d(%.2f%%)', bad, bad * 100.0::double / total) bad,
           printf('%d(%.2f%%)', ns, case when bad > 0 then ns * 100.0::double / bad else 0 end) ns, printf('%d(%.2f%%)', q, case when bad > 0 then q * 100.0::double / bad else 0 end) low_quality from t""")
def extraction_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with percentages: good and bad of all, the kinds of bad of all bad ones."""
    c = filter_cascade_counts(spark, sf_dir).withColumn("bad", F.col("total") - F.col("good"))
    p = names.percent
    return c.select(
        "target_name", "total", p(F.col("good"), F.col("total")).alias("good"), p(F.col("bad"), F.col("total")).alias("bad"),
        p(F.col("containsns"), F.col("bad")).alias("ns"), p(F.col("qualityfailed"), F.col("bad")).alias("low_quality"),
    )


@query("""with m as (select target_name, median(length(seq_)) med from clusters where seq_ is not null group by 1)
          select target_name, med::double median_len, greatest(floor(med) - floor(med * 20 / 100), 0)::bigint minlen, (floor(med) + floor(med * 20 / 100))::bigint maxlen from m""")
def length_cutoffs_median20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.length_cutoffs(table(spark, sf_dir, "clusters"), ["target_name"], "seq_")


@query(f"select cluster_id, {_REVCOMP.format('seq_')} rc, array_to_string(list_reverse(qual_), ',') quals, len(qual_) n from clusters")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "clusters")
    back = F.array_join(F.transform(F.reverse("qual_"), lambda q: q.cast("string")), ",")
    return rows.select("cluster_id", sq.revcomp(F.col("seq_")).alias("rc"), back.alias("quals"), F.when(F.col("qual_").isNotNull(), F.size("qual_")).cast("long").alias("n"))


@query("""with k as (select distinct cluster_id, target_name, substr(upper(seq_), i, 5) kmer from clusters, lateral (select unnest(range(1, length(seq_) - 3)) i) where length(seq_) >= 5)
          select target_name, kmer, count(*) n, count(*) <= 1 is_low from k group by all""")
def kmer_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.kmer_spectrum(spread_table(spark, sf_dir, "clusters", "target_name", "seq_"), ["target_name"], "seq_")


_SCREEN = """with f as (select target_name, min(cluster_id) cluster_id from clusters where seq_ is not null group by 1),
 k as (select distinct cluster_id, target_name, substr(upper(seq_), i, 5) kmer from clusters, lateral (select unnest(range(1, length(seq_) - 3)) i) where length(seq_) >= 5),
 own as (select cluster_id, count(*) own from k group by 1),
 r as (select k.target_name, k.kmer from k join f using (cluster_id)),
 s as (select k.cluster_id, count(*) shared from k join r on k.target_name = r.target_name and k.kmer = r.kmer group by 1) """


def _first_refs(rows: DataFrame) -> DataFrame:
    first = rows.where("seq_ is not null").groupBy("target_name").agg(F.min_by("seq_", "cluster_id").alias("ref"))
    return first


@query(_SCREEN + "select cluster_id, shared best from s join own using (cluster_id) where 2 * shared >= own.own")
def contamination_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences that share half of their 5-mers with the reference of their target."""
    rows = spread_table(spark, sf_dir, "clusters", "cluster_id", "target_name", "seq_")
    return matching.kmer_screen(rows, "cluster_id", "seq_", _first_refs(rows), "ref", ["target_name"])


@query(_SCREEN + "select cluster_id from clusters where cluster_id not in (select cluster_id from s join own using (cluster_id) where 2 * shared >= own.own)")
def contamination_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "clusters", "cluster_id", "target_name", "seq_")
    passed = matching.kmer_screen(rows, "cluster_id", "seq_", _first_refs(rows), "ref", ["target_name"])
    return rows.select("cluster_id").join(passed, "cluster_id", "left_anti")


_DEMUX = """with b as (select target_name, upper(substr(fwd_primer, 1, 8)) bc from targets), r as (select distinct cluster_id, upper(seq_) s from clusters),
 h as (select cluster_id, target_name, min((hamming(substr(s, o + 1, 8), bc), o)) e from r, b, (select unnest([0, 1, 2]) o) where length(s) >= o + 8 and hamming(substr(s, o + 1, 8), bc) <= 1 group by 1, 2),
 m as (select cluster_id, min(e[1]) errors from h group by 1),
 w as (select h.cluster_id, min(h.target_name) mid, count(*) n, min(m.errors) errors, min(e[2]) o from h join m on h.cluster_id = m.cluster_id and h.e[1] = m.errors group by 1),
 d as (select cluster_id, case when n = 1 then mid end mid, case when n = 1 then 'MATCH' when n > 1 then 'AMBIGUOUS' else 'NO_MATCHING' end outcome, errors::int errors, case when n = 1 then o end::int "offset" from clusters left join w using (cluster_id)) """


def _demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    barcodes = table(spark, sf_dir, "targets").select("target_name", F.substring("fwd_primer", 1, 8).alias("barcode"))
    return matching.demultiplex(spread_table(spark, sf_dir, "clusters", "cluster_id", "target_name", "seq_"), "cluster_id", "seq_", barcodes, "target_name", "barcode")


@query(_DEMUX + "select * from d")
def barcode_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight primer bases as barcodes: within one error at an offset of 0 to 2."""
    return _demux(spark, sf_dir)


@query(_DEMUX + "select target_name, count(mid) n, (select count(mid) from d) total, round(count(mid) / (select count(mid) from d), 6) fraction from (select distinct target_name from targets) t left join d on d.mid = target_name group by 1")
def barcode_counts_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = _demux(spark, sf_dir).where("mid is not null")
    return matching.zero_filled_counts(table(spark, sf_dir, "targets"), "target_name", hit, "mid")


@query(_DEMUX + "select outcome, count(*) n, round(count(*) * 100 / sum(count(*)) over (), 6) percent from d group by 1")
def barcode_failure_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _demux(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select("outcome", "n", F.round(F.col("n") * 100 / F.col("_t"), 6).alias("percent"))


def _primer_sql(oriented: str, motif: str, out: str) -> str:
    return f"""{out} as (select c.cluster_id, coalesce(min((hamming(substr(s, o + 1, length(p)), p), o, h.target_name))[3], 'unrecognized') matched, min((hamming(substr(s, o + 1, length(p)), p), o, h.target_name))[1]::int errors,
 min((hamming(substr(s, o + 1, length(p)), p), o, h.target_name))[2]::int "offset" from clusters c left join (select cluster_id, {oriented} s, o, p, q.target_name from clusters,
 (select unnest(range(0, 11)) o), (select target_name, upper({motif}) p from targets) q where length(seq_) >= o + length(p) and hamming(substr({oriented}, o + 1, length(p)), p) <= 3) h using (cluster_id) group by 1)"""


_FWD = "with " + _primer_sql("upper(seq_)", "fwd_primer", "f")
_BOTH = _FWD + ", " + _primer_sql("translate(reverse(upper(seq_)), 'ACGT', 'TGCA')", "translate(reverse(upper(rev_primer)), 'ACGT', 'TGCA')", "r")


_TURNED = "case when cluster_id % 2 = 1 then translate(reverse(upper(seq_)), 'ACGT', 'TGCA') else upper(seq_) end"
_RETRY = "with " + _primer_sql(_TURNED, "fwd_primer", "f") + ", " + _primer_sql(f"translate(reverse({_TURNED}), 'ACGT', 'TGCA')", "fwd_primer", "r")
_RETRY += """, p as (select f.cluster_id, f.matched = 'unrecognized' and r.matched <> 'unrecognized' complement, f.matched fm, r.matched rm, f.errors fe, r.errors re, f."offset" fo, r."offset" ro from f join r using (cluster_id)),
 o as (select cluster_id, complement, case when complement then rm else fm end matched, case when complement then re else fe end errors, case when complement then ro else fo end "offset", case when complement then rm || '_Comp' else fm end label from p) """


def _oriented(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_")
    turned = rows.select("cluster_id", F.when(F.col("cluster_id") % 2 == 1, sq.revcomp(F.upper("seq_"))).otherwise(F.upper("seq_")).alias("seq"))
    return matching.match_oriented(turned, "cluster_id", "seq", table(spark, sf_dir, "targets"), "target_name", "fwd_primer")


def _forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_primers(spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_"), "cluster_id", "seq_", table(spark, sf_dir, "targets"), "target_name", "fwd_primer")


@query(_FWD + " select * from f")
def primer_match_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forward(spark, sf_dir)


@query(_BOTH + """ select f.cluster_id, f.matched fwd, r.matched rev, case when 'unrecognized' in (f.matched, r.matched) then 'unrecognized' when f.matched = r.matched then 'matched' else 'mismatched' end pair
          from f join r using (cluster_id)""")
def primer_pair_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.match_primer_pairs(spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_"), "cluster_id", "seq_", table(spark, sf_dir, "targets"), "target_name", "fwd_primer", "rev_primer")


@query(_BOTH + """ select f.matched fwd, r.matched rev, count(*) n, round(avg(length(seq_)), 6) mean_len from f join r using (cluster_id) join clusters using (cluster_id)
          where f.matched = 'unrecognized' or r.matched = 'unrecognized' or f.matched <> r.matched group by all""")
def failed_primer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = primer_pair_consistency(spark, sf_dir).where("pair != 'matched'")
    rows = failed.join(table(spark, sf_dir, "clusters").select("cluster_id", F.length("seq_").alias("_l")), "cluster_id")
    return rows.groupBy("fwd", "rev").agg(F.count("*").alias("n"), F.round(F.avg("_l"), 6).alias("mean_len"))


@query(_FWD + """ , t as (select matched target_name, "offset" preceding, count(*) n from f where matched <> 'unrecognized' group by all)
          select *, row_number() over (partition by target_name order by n desc, preceding) = 1 most_common from t""")
def preceding_base_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bases before the primer: a histogram per target with its commonest length marked."""
    from pyspark.sql import Window

    hist = _forward(spark, sf_dir).where("matched != 'unrecognized'").groupBy(F.col("matched").alias("target_name"), F.col("offset").alias("preceding")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("target_name").orderBy(F.desc("n"), "preceding"))
    return hist.withColumn("most_common", first == 1)


@query(_RETRY + """ , c as (select count(*) filter (matched <> 'unrecognized' and not complement) fwd, count(*) filter (complement) comp, count(*) filter (matched <> 'unrecognized') n,
          count(*) filter (matched <> 'unrecognized' and "offset" > 0) moved from o)
          select fwd, comp, moved, n >= 250 and comp >= 0.2 * n check_complement, n >= 250 and moved > 0.1 * n random_bases,
          case when n >= 250 and comp >= 0.2 * n then '--checkRevComplement' else '' end || case when n >= 250 and moved > 0.1 * n then ' --trimFront' else '' end flags from c""")
def recommend_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an investigation of the reads suggests: search the complement, expect bases before the primer."""
    hit = F.col("matched") != "unrecognized"
    counts = [F.count_if(hit & ~F.col("complement")).alias("fwd"), F.count_if(F.col("complement")).alias("comp"), F.count_if(hit).alias("_n"), F.count_if(hit & (F.col("offset") > 0)).alias("moved")]
    c = _oriented(spark, sf_dir).agg(*counts)
    comp, moved = (F.col("_n") >= 250) & (F.col("comp") >= 0.2 * F.col("_n")), (F.col("_n") >= 250) & (F.col("moved") > 0.1 * F.col("_n"))
    flags = F.concat(F.when(comp, "--checkRevComplement").otherwise(""), F.when(moved, " --trimFront").otherwise(""))
    return c.select("fwd", "comp", "moved", comp.alias("check_complement"), moved.alias("random_bases"), flags.alias("flags"))


@query(_RETRY + "select cluster_id, matched, errors, \"offset\", complement, label from o")
def complement_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forward primer on the read, else on its complement. Every other sequence is turned round first, so both occur."""
    return _oriented(spark, sf_dir)


@query(_RETRY + """ , t as (select matched target, count(*) filter (not complement) forward, count(*) filter (complement) complement, count(*) total from o where matched <> 'unrecognized' group by 1)
          select *, round(complement / total, 6) complement_share, round(total / (select sum(total) from t), 6) fraction, total >= 250 and complement >= 0.2 * total check_complement from t""")
def orientation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.orientation_counts(_oriented(spark, sf_dir))


@query("select upper(substr(seq_, 1, 20)) start, count(*) n from seq_reads where seq_ is not null group by 1 order by n desc, start limit 10")
def top_read_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.top_starts(table(spark, sf_dir, "seq_reads"), "seq_")


_ILL = names.ILLUMINA.replace("'", "''")
_PART = f"case when regexp_matches(name_, '{_ILL}') then str_split(replace(name_, ' ', ':'), ':')[{{}}] else '' end"


@query("select read_id, loaded_at, " + ", ".join(f"{_PART.format(i + 1)} {f}" for i, f in enumerate(names.ILLUMINA_FIELDS)) + " from seq_reads where name_ is not null")
def illumina_header_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "seq_reads").where("name_ is not null").select("read_id", "loaded_at", names.illumina(F.col("name_")).alias("f")).select("read_id", "loaded_at", "f.*")


@query(f"""with s as (select *, {_PART.format(11)} n from seq_reads where name_ is not null), c as (select run_id, n, count(*) k from s group by all),
           m as (select run_id, n from c qualify row_number() over (partition by run_id order by k desc, n desc) = 1)
           select read_id, run_id, loaded_at from s join m using (run_id, n)""")
def modal_sample_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "seq_reads").where("name_ is not null")
    return reads.keep_modal_sample_number(rows, ["run_id"], "name_").select("read_id", "run_id", "loaded_at")


@query("""select read_id, run_id from (select distinct read_id, run_id from seq_reads) qualify row_number() over (partition by run_id order by (read_id * 2654435761 + 40503) % 4294967296, read_id) <= 50""")
def deterministic_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.downsample(table(spark, sf_dir, "seq_reads").select("read_id", "run_id").distinct(), ["run_id"], "read_id", 50)


@query("""with n as (select read_id, loaded_at, run_id, name_, row_number() over (partition by name_ order by read_id, loaded_at) - 1 k from seq_reads)
          select read_id, loaded_at, case when k > 0 then name_ || '.' || k else name_ end unique_name from n""")
def repeated_names_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "seq_reads").withColumn("_o", F.struct("read_id", "loaded_at"))
    return reads.number_repeated_names(rows, "name_", "_o").select("read_id", "loaded_at", "unique_name")


@query(f"""select read_id, loaded_at, round(list_sum(list_transform({_Q}, lambda x: pow(10.0::double, -x / 10.0::double))) / len(qual_), 8) mean_error
           from seq_reads where len(qual_) > 0 and len(list_filter(qual_, lambda x: x is null)) = 0""")
def mean_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "seq_reads", "read_id", "loaded_at", "qual_").where((F.size("qual_") > 0) & ~F.exists("qual_", lambda q: q.isNull()))
    return rows.select("read_id", "loaded_at", F.round(quality.mean_error(F.col("qual_")), 8).alias("mean_error"))


@query("""with l as (select target_name, unnest(qual_) q, generate_subscripts(qual_, 1) - 1 pos from clusters)
          select target_name, pos::int pos, median(q)::double q, count(*) n from l where q between 0 and 60 group by all""")
def quality_consensus_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.quality_consensus(spread_table(spark, sf_dir, "clusters", "target_name", "qual_"), ["target_name"], "qual_")


@query("""with l as (select target_name, unnest(qual_) q, generate_subscripts(qual_, 1) - 1 pos from clusters)
          select target_name, pos::int pos, min(q)::double worst, max(q)::double best from l where q between 0 and 60 group by all""")
def quality_consensus_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread_table(spark, sf_dir, "clusters", "target_name", "qual_")
    worst = reads.quality_consensus(rows, ["target_name"], "qual_", "worst").select("target_name", "pos", F.col("q").alias("worst"))
    best = reads.quality_consensus(rows, ["target_name"], "qual_", "bestQual").select("target_name", "pos", F.col("q").alias("best"))
    return worst.join(best, ["target_name", "pos"])


@query("""with x as (select run_id, len(list_filter(qual_, lambda q: q >= 30)) / len(qual_) f from seq_reads where len(qual_) > 0)
          select run_id, count(*) n, round(avg(f), 6) mean, round(median(f), 6) median, round(min(f), 6) least, round(max(f), 6) most, round(stddev_samp(f), 6) sd from x group by 1""")
def qc_dry_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the fraction of bases of quality 30 or more, per run."""
    f = quality.count_at_least(F.col("qual_"), 30) / F.size("qual_")
    rows = table(spark, sf_dir, "seq_reads").where(F.size("qual_") > 0).select("run_id", f.alias("f"))
    r = lambda c: F.round(c, 6)
    return rows.groupBy("run_id").agg(F.count("*").alias("n"), r(F.avg("f")).alias("mean"), r(F.median("f")).alias("median"), r(F.min("f")).alias("least"), r(F.max("f")).alias("most"), r(F.stddev_samp("f")).alias("sd"))


@query("""with b as (select cluster_id, upper(seq_) s from clusters), h as (select cluster_id, target_name, o start, hamming(substr(s, o + 1, 18), upper(fwd_primer)) e
          from b, targets, lateral (select unnest(range(0, length(s) - 17)) o) where length(s) >= 18 and hamming(substr(s, o + 1, 18), upper(fwd_primer)) <= 2),
          r as (select cluster_id, target_name, o r_start, hamming(substr(s, o + 1, 18), upper(rev_primer)) e from b, targets, lateral (select unnest(range(0, length(s) - 17)) o)
          where length(s) >= 18 and hamming(substr(s, o + 1, 18), upper(rev_primer)) <= 2)
          select h.cluster_id, h.target_name target, (h.start + 18)::int ins_start, r_start::int ins_end, h.e::int f_err, r.e::int r_err from h join r on h.cluster_id = r.cluster_id and h.target_name = r.target_name
          where r_start > h.start + 18 and r_start - h.start - 18 <= 1000""")
def primer_pair_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In-silico PCR: places of both primers within two errors, paired where they can amplify."""
    rows, targets = spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_"), table(spark, sf_dir, "targets")
    hit = lambda p: matching.motif_hits(rows, "cluster_id", "seq_", targets, "target_name", p, 2).where("strand = '+'").withColumnRenamed("target_name", "target")
    forward, reverse = hit("fwd_primer"), hit("rev_primer").withColumn("strand", F.lit("-"))
    return matching.amplicons(forward, reverse, "cluster_id").select("cluster_id", "target", "ins_start", "ins_end", "f_err", "r_err")


@query("""with a as (select target_name, replicate_no, min(length(seq_)) lo, max(length(seq_)) + 1 hi from clusters where seq_ is not null group by all)
          select target_name, replicate_no, lo, hi, minlen, maxlen from a join targets using (target_name) where lo < maxlen and minlen < hi and minlen < maxlen""")
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of cluster lengths that overlap the lengths a target permits."""
    a = table(spark, sf_dir, "clusters").where("seq_ is not null").groupBy("target_name", "replicate_no").agg(F.min(F.length("seq_")).alias("lo"), (F.max(F.length("seq_")) + 1).alias("hi"))
    b = table(spark, sf_dir, "targets").select("target_name", "minlen", "maxlen")
    return matching.interval_overlaps(a, b, "target_name", "lo", "hi", "minlen", "maxlen", 50)


@query("""select cluster_id, upper(seq_) seq, 'R1ENDSINR2' status, 240 - length(seq_) "overlap" from clusters where length(seq_) between 121 and 230 and regexp_matches(seq_, '^[ACGTacgt]+$')""")
def pair_stitch_ungapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates of 120 bases cut from both ends of a cluster are stitched back into it."""
    from ..operators import stitch

    rows = spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_").where("length(seq_) between 121 and 230 and seq_ rlike '^[ACGTacgt]+$'")
    mates = rows.select("cluster_id", F.upper(F.substring("seq_", 1, 120)).alias("r1"), sq.revcomp(F.upper(F.right("seq_", F.lit(120)))).alias("r2"), F.lit(None).cast("array<smallint>").alias("q"))
    return stitch.stitch(mates, ["cluster_id"], "r1", "q", "r2", "q").select("cluster_id", "seq", "status", "overlap")


@query("""select target_name, (length(seq_) // 20)::varchar || ':' || ((length(seq_) - length(replace(replace(upper(seq_), 'G', ''), 'C', ''))) * 10 // length(seq_))::varchar bin, count(*) n
          from clusters where length(seq_) > 0 group by all""")
def composition_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences binned by length and share of G and C in tenths: the coarse pre-binning before comparisons."""
    gc = F.length("seq_") - F.length(F.translate(F.upper("seq_"), "GC", ""))
    name = F.concat_ws(":", F.floor(F.length("seq_") / 20).cast("string"), F.floor(gc * 10 / F.length("seq_")).cast("string"))
    return table(spark, sf_dir, "clusters").where("length(seq_) > 0").groupBy("target_name", name.alias("bin")).agg(F.count("*").alias("n"))


@query(_FWD + """ , s as (select substr(upper(seq_), 1, 10) start, substr(upper(seq_), -10) finish, count(*) n from clusters join f using (cluster_id) where matched = 'unrecognized' and length(seq_) >= 10 group by all)
          select *, round(n / (select sum(n) from s), 6) fraction from s""")
def unrecognized_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last bases of sequences without a primer, with their share."""
    lost = _forward(spark, sf_dir).where("matched = 'unrecognized'").select("cluster_id")
    rows = table(spark, sf_dir, "clusters").where("length(seq_) >= 10").join(lost, "cluster_id", "left_semi")
    counts = rows.groupBy(F.substring(F.upper("seq_"), 1, 10).alias("start"), F.right(F.upper("seq_"), F.lit(10)).alias("finish")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select("start", "finish", "n", F.round(F.col("n") / F.col("_t"), 6).alias("fraction"))


@query("select event_type, count(*) n, count(json_extract(props, '$.k')) with_k, max((props ->> '$.k')::bigint) top from events group by 1")
def json_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of JSON texts, parsed by schema; a text that can't be parsed has none."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.max(k).alias("top"))


@query("""select s_sample, target_name, arg_max(qualrep, (started_at, run_id)) qualrep, max(started_at) started_at, count(*) runs from cluster_runs where s_sample is not null and target_name is not null group by all""")
def latest_run_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parameters of each sample's last run of a target."""
    rows = table(spark, sf_dir, "cluster_runs").where("s_sample is not null and target_name is not null")
    last = F.max(F.when(F.col("qualrep").isNotNull(), F.struct("started_at", "run_id", "qualrep")))["qualrep"]
    return rows.groupBy("s_sample", "target_name").agg(last.alias("qualrep"), F.max("started_at").alias("started_at"), F.count("*").alias("runs"))


@query("""select distinct case when coalesce(targets_, '') = '' then t.target_name else u end target_name, run_id from (select run_id, case when run_id % 2 = 0 then '' else target_name end targets_ from cluster_runs) r
          left join lateral (select unnest(str_split(r.targets_, ',')) u) x on true left join (select distinct target_name from targets) t on coalesce(r.targets_, '') = ''""")
def targets_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets named for a run, all of them where none is named (here: even runs name none)."""
    from ..operators import manifest

    runs = table(spark, sf_dir, "cluster_runs").select("run_id", F.when(F.col("run_id") % 2 == 0, "").otherwise(F.col("target_name")).alias("targets_"))
    return manifest.targets_of_index(runs, "run_id", "targets_", table(spark, sf_dir, "targets"), "target_name").select("target_name", "run_id")


_DUAL = _DEMUX + """, b2 as (select target_name, substr(translate(reverse(upper(rev_primer)), 'ACGT', 'TGCA'), 1, 8) bc from targets), r2 as (select distinct cluster_id, translate(reverse(upper(seq_)), 'ACGT', 'TGCA') s from clusters),
 h2 as (select cluster_id, target_name, min((hamming(substr(s, o + 1, 8), bc), o)) e from r2, b2, (select unnest([0, 1, 2]) o) where length(s) >= o + 8 and hamming(substr(s, o + 1, 8), bc) <= 1 group by 1, 2),
 m2 as (select cluster_id, min(e[1]) errors from h2 group by 1),
 w2 as (select h2.cluster_id, min(h2.target_name) mid, count(*) n from h2 join m2 on h2.cluster_id = m2.cluster_id and h2.e[1] = m2.errors group by 1),
 d2 as (select cluster_id, case when n = 1 then mid end mid, case when n = 1 then 'MATCH' when n > 1 then 'AMBIGUOUS' else 'NO_MATCHING' end outcome from clusters left join w2 using (cluster_id)),
 u as (select d.cluster_id, d.mid, case when d.outcome = 'MATCH' and d2.outcome = 'MATCH' then case when d.mid = d2.mid then 'MATCH' else 'MISMATCHED' end when 'AMBIGUOUS' in (d.outcome, d2.outcome) then 'AMBIGUOUS' else 'NO_MATCHING' end outcome from d join d2 using (cluster_id)) """


@query(_DUAL + "select cluster_id, case when outcome = 'MATCH' then mid end mid, outcome from u")
def dual_barcode_demux(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight bases of either primer as a pair of barcodes, the second at the start of the reverse complement."""
    back = table(spark, sf_dir, "targets").select("target_name", F.substring(sq.revcomp(F.upper("rev_primer")), 1, 8).alias("barcode"))
    turned = spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_").select("cluster_id", sq.revcomp(F.upper("seq_")).alias("seq"))
    return matching.dual_barcodes(_demux(spark, sf_dir), matching.demultiplex(turned, "cluster_id", "seq", back, "target_name", "barcode"), "cluster_id")


@query("""with c as (select cluster_id, substr(seq_, 1, coalesce(maxlen, length(seq_))) s, maxlen from clusters left join targets using (target_name) where seq_ is not null)
          select cluster_id, s seq, length(s) < 50 small from c""")
def trimmed_to_maxlen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences cut at their target's greatest length (uncut without one), and whether they are small fragments."""
    limits = table(spark, sf_dir, "targets").select("target_name", "maxlen")
    return reads.trim_to_longest(table(spark, sf_dir, "clusters").where("seq_ is not null").join(limits, "target_name", "left"), "seq_", F.col("maxlen")).select("cluster_id", F.col("seq_").alias("seq"), reads.is_small("seq_", 50).alias("small"))


@query("""with c as (select target_name, s_sample, count(*) n from clusters where target_name is not null and s_sample is not null group by all)
          select cluster_id, target_name, s_sample, n <= 5 small_bin from clusters join c using (target_name, s_sample)""")
def small_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of bins of five or fewer go to a side output: here they are marked."""
    return reads.mark_small_bins(table(spark, sf_dir, "clusters").dropna(subset=["target_name", "s_sample"]), ["target_name", "s_sample"], 5).select("cluster_id", "target_name", "s_sample", "small_bin")


@query("""with f as (select cluster_id, target_name, seq_, upper(seq_) s from clusters), t as (select target_name, minlen, maxlen, upper(rev_primer) rp from targets),
 x as (select cluster_id, f.target_name, case when length(s) < 50 then 'SMALLFRAGMENT' when length(s) >= length(rp) and hamming(right(s, length(rp)), rp) > 3 then 'BADREVERSE' when length(s) < minlen then 'MINLENBAD' when length(s) - length(replace(s, 'N', '')) >= 1 then 'CONTAINSNS' when length(s) > maxlen then 'MAXLENBAD' else 'GOOD' end c from f left join t using (target_name))
 select target_name, c "case", count(*) n from x where target_name is not null group by all""")
def first_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failure of every sequence: small fragment, reverse primer, lengths and Ns."""
    limits = table(spark, sf_dir, "targets").select("target_name", "minlen", "maxlen", F.upper("rev_primer").alias("rp"))
    rows = spread_table(spark, sf_dir, "clusters", "target_name", "seq_").where("target_name is not null").join(limits, "target_name", "left").withColumn("s", F.upper("seq_"))
    bad = (F.length("s") >= F.length("rp")) & (sq.hamming(F.substr("s", F.length("s") - F.length("rp") + 1), F.col("rp")) > 3)
    case = reads.cascade([("SMALLFRAGMENT", reads.is_small("s", 50)), ("BADREVERSE", bad), ("MINLENBAD", F.length("s") < F.col("minlen")), ("CONTAINSNS", sq.count_base(F.col("s"), "N") >= 1), ("MAXLENBAD", F.length("s") > F.col("maxlen"))])
    return rows.withColumn("case", case).groupBy("target_name", "case").agg(F.count("*").alias("n"))


@query("""with b as (select cluster_id, upper(seq_) s from clusters), h as (select cluster_id, target_name, count(*) f from (select cluster_id, target_name, hamming(substr(s, o + 1, 18), upper(fwd_primer)) e
          from b, targets, lateral (select unnest(range(0, length(s) - 17)) o) where length(s) >= 18) where e <= 2 group by all),
          r as (select cluster_id, target_name, count(*) f from (select cluster_id, target_name, hamming(substr(s, o + 1, 18), upper(rev_primer)) e from b, targets, lateral (select unnest(range(0, length(s) - 17)) o)
          where length(s) >= 18) where e <= 2 group by all), k as (select cluster_id, target_name from (select cluster_id from h union select cluster_id from r), (select distinct target_name from targets))
          select cluster_id, k.target_name target, coalesce(h.f, 0) forward, coalesce(r.f, 0) reverse from k left join h using (cluster_id, target_name) left join r using (cluster_id, target_name)""")
def pcr_hit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of both primers within two errors for every sequence that has any and every target, zeros included."""
    rows, targets = spread_table(spark, sf_dir, "clusters", "cluster_id", "seq_"), table(spark, sf_dir, "targets")
    hit = lambda p: matching.motif_hits(rows, "cluster_id", "seq_", targets, "target_name", p, 2).where("strand = '+'").withColumnRenamed("target_name", "target")
    forward, reverse = hit("fwd_primer"), hit("rev_primer")
    none = forward.select("cluster_id", "target").limit(0)
    return matching.pcr_counts(rows, "cluster_id", targets, "target_name", forward, reverse, none).drop("amplicons")


@query("""with r as (select target_name, min(seq_) ref from clusters where seq_ is not null and cluster_id in (select min(cluster_id) from clusters where seq_ is not null group by target_name) group by 1),
 h as (select cluster_id, c.target_name, upper(substr(seq_, 1, 80)) a, upper(right(seq_, 80)) b, upper(ref) ref from clusters c join r using (target_name) where length(seq_) >= 5),
 k as (select cluster_id, list_distinct(list_transform(range(1, length(a) - 3), lambda i: substr(a, i, 5))) ka, list_distinct(list_transform(range(1, length(b) - 3), lambda i: substr(b, i, 5))) kb,
 list_distinct(list_transform(range(1, length(ref) - 3), lambda i: substr(ref, i, 5))) kr from h)
 select cluster_id from k where 2 * len(list_intersect(ka, kr)) >= len(ka) and 2 * len(list_intersect(kb, kr)) >= len(kb)""")
def paired_contamination_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ends of a sequence as mates: each shares half of its 5-mers with the reference of its target."""
    rows = spread_table(spark, sf_dir, "clusters", "cluster_id", "target_name", "seq_")
    mates = rows.select("cluster_id", "target_name", F.substring("seq_", 1, 80).alias("a"), sq.revcomp(F.upper(F.right("seq_", F.lit(80)))).alias("b"))
    return matching.paired_screen(mates, "cluster_id", "a", "b", _first_refs(rows), "ref", ["target_name"])


@query("""with x as (select target_name, case when length(seq_) < 150 then 'SHORT' when length(seq_) > 200 then 'LONG' else 'USUAL' end st from clusters where seq_ is not null and target_name is not null),
          t as (select target_name, count(*) total, count(*) filter (st = 'SHORT') s, count(*) filter (st = 'USUAL') u, count(*) filter (st = 'LONG') l from x group by 1)
          select target_name, total, printf('%d(%.2f%%)', s, s * 100.0::double / total) short, printf('%d(%.2f%%)', u, u * 100.0::double / total) usual, printf('%d(%.2f%%)', l, l * 100.0::double / total) long from t""")
def outcome_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of an outcome with percentages per target: here three classes of length."""
    length = F.length("seq_")
    rows = table(spark, sf_dir, "clusters").where("seq_ is not null and target_name is not null").withColumn("st", F.when(length < 150, "SHORT").when(length > 200, "LONG").otherwise("USUAL"))
    return reads.outcome_counts(rows, ["target_name"], "st", ["SHORT", "USUAL", "LONG"])


@query(f"""select cluster_id, substr(seq_, 1, greatest(length(seq_) - 1, 0)) r1, substr({_REVCOMP.format('seq_')}, 3, greatest(length(seq_) - 2, 0)) r2, len(qual_[:greatest(len(qual_) - 1, 0)]) n1, len(qual_[3:]) n2 from clusters where seq_ is not null""")
def trimmed_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sequence and its complement as mates: the first loses its last base, the second, turned round already, its first two."""
    mates = table(spark, sf_dir, "clusters").where("seq_ is not null").select("cluster_id", F.col("seq_").alias("r1"), F.col("qual_").alias("q1"), sq.revcomp(F.col("seq_")).alias("r2"), F.reverse("qual_").alias("q2"))
    cut = reads.trim_mates(mates, ("r1", "q1"), ("r2", "q2"), 1, 2, mate_rc=True)
    size = lambda q: F.when(F.col(q).isNotNull(), F.size(q)).cast("long")
    return cut.select("cluster_id", "r1", "r2", size("q1").alias("n1"), size("q2").alias("n2"))
