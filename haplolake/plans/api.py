"""Read-only queries over result tables, as a service would ask them. Functions return DataFrames; ``rows`` makes JSON of them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.names import strip_percent
from .registry import query, table


class ResultStore:
    """Result tables of all projects: ``sample_info`` with a project column, other tables by name."""

    def __init__(self, sample_info: DataFrame, project: str = "project_name", **tables: DataFrame):
        self.info, self.project, self.tables = sample_info, project, tables

    def projects(self) -> DataFrame:
        return self.info.select(self.project).where(F.col(self.project).isNotNull()).distinct()

    def _of(self, project: str) -> DataFrame:
        return self.info.where(F.col(self.project) == project)

    def sample_names(self, project: str) -> DataFrame:
        return self._of(project).select("s_sample").where("s_sample is not null").distinct()

    def samples(self, project: str, names: list[str], columns: list[str]) -> DataFrame:
        """Rows of the samples asked for, in the columns asked for, NaN as null; unknown samples give nothing."""
        kinds = dict(self.info.dtypes)
        shown = (F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in columns)
        return self._of(project).where(F.col("s_sample").isin(names)).select(*shown)

    def populations(self, project: str, uids: list[str]) -> DataFrame:
        """One row per haplotype asked for (all without a list) with its number of samples and reads."""
        rows = self._of(project).where("h_popuid is not null")
        rows = rows.where(F.col("h_popuid").isin(uids)) if uids else rows
        return rows.groupBy("h_popuid").agg(F.count_distinct("s_sample").alias("samples"), F.sum("c_readcnt").alias("reads"))

    def matrix(self, project: str, uids: list[str], names: list[str]) -> DataFrame:
        """Haplotype x sample with one column per sample asked for, 0 where it isn't found."""
        rows = self._of(project).where(F.col("s_sample").isin(names) & F.col("h_popuid").isNotNull())
        rows = rows.where(F.col("h_popuid").isin(uids)) if uids else rows
        frac = F.when(~F.isnan("c_averagedfrac"), F.col("c_averagedfrac"))
        return rows.groupBy("h_popuid").pivot("s_sample", names).agg(F.max(frac)).fillna(0.0)

    def groups(self, meta: DataFrame, project: str, field: str) -> DataFrame:
        """Per value of a metadata field: samples and haplotypes of the project."""
        met = self._of(project).join(meta.select("s_sample", field), "s_sample")
        return met.groupBy(F.col(field).alias("g_groupname")).agg(F.count_distinct("s_sample").alias("samples"), F.count_distinct("h_popuid").alias("haplotypes"))

    def long_name(self, configs: DataFrame, project: str) -> str:
        """The display name of a project, '' for an unknown one; ``configs`` has short_name and long_name."""
        found = configs.where(F.col("short_name") == project).select("long_name").limit(1).collect()
        return (found[0][0] or "") if found else ""

    def group_names(self, meta: DataFrame, project: str) -> DataFrame:
        """Metadata fields in which the project's samples have any value."""
        fields = [c for c in meta.columns if c != "s_sample"]
        met = meta.join(self.sample_names(project), "s_sample", "left_semi")
        counts = met.agg(*(F.count(c).alias(c) for c in fields))
        return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"`{c}`").alias("n")) for c in fields))).alias("f")).where("f.n > 0").select(F.col("f.name").alias("g_name"))

    def within(self, meta: DataFrame, field: str, value: str) -> ResultStore:
        """The store of the samples in one subgroup: every question to it is that question within the group."""
        members = meta.where(F.col(field) == value).select("s_sample").distinct()
        return ResultStore(self.info.join(members, "s_sample", "left_semi"), self.project, **self.tables)

    def sample_sequences(self, names: list[str]) -> DataFrame:
        """Final haplotypes of the samples asked for, from table ``final``."""
        return self.tables["final"].where(F.col("s_sample").isin(names))

    def population_sequences(self, uids: list[str]) -> DataFrame:
        """Sequences of the haplotypes asked for, from table ``population``; all without a list."""
        rows_ = self.tables["population"]
        return rows_.where(F.col("h_popuid").isin(uids)) if uids else rows_

    def extraction(self, name: str) -> DataFrame:
        """A report table with '(...)' cut from its text cells."""
        t = self.tables[name]
        return t.select(*(strip_percent(F.col(c)).alias(c) if k == "string" else F.col(c) for c, k in t.dtypes))


def rows(df: DataFrame, limit: int = 10_000) -> str:
    """The rows as a JSON array; a longer result is an error, not a cut one."""
    found = [json.loads(r) for r in df.limit(limit + 1).toJSON().collect()]
    if len(found) > limit:
        raise ValueError(f"more than {limit} rows; ask for fewer samples or haplotypes")
    return json.dumps(found, sort_keys=True)


@query("select distinct project_name from sample_info where project_name is not null")
def api_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ResultStore(table(spark, sf_dir, "sample_info")).projects()


@query("select project_name, count(distinct s_sample) samples from sample_info where project_name is not null and s_sample is not null group by 1")
def api_sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "sample_info").where("project_name is not null and s_sample is not null")
    return rows_.groupBy("project_name").agg(F.count_distinct("s_sample").alias("samples"))


_ONE = "(select min(project_name) from sample_info)"


def _first(spark: SparkSession, sf_dir: str) -> tuple[ResultStore, str]:
    info = table(spark, sf_dir, "sample_info")
    return ResultStore(info), info.agg(F.min("project_name")).first()[0]


@query(f"select s_sample, h_popuid, c_readcnt, case when not isnan(c_averagedfrac) then c_averagedfrac end c_averagedfrac, loaded_at from sample_info where project_name = {_ONE} and s_sample in ('MIXCTRL-00')")
def api_samp_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, project = _first(spark, sf_dir)
    return store.samples(project, ["MIXCTRL-00"], ["s_sample", "h_popuid", "c_readcnt", "c_averagedfrac", "loaded_at"])


@query(f"select h_popuid, count(distinct s_sample) samples, sum(c_readcnt)::bigint reads from sample_info where project_name = {_ONE} and h_popuid is not null group by 1")
def api_pop_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, project = _first(spark, sf_dir)
    return store.populations(project, [])


@query(f"""select h_popuid, coalesce(max(c_averagedfrac) filter (not isnan(c_averagedfrac)), 0) "MIXCTRL-00" from sample_info where project_name = {_ONE} and s_sample = 'MIXCTRL-00' and h_popuid is not null group by 1""")
def api_hap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, project = _first(spark, sf_dir)
    return store.matrix(project, [], ["MIXCTRL-00"])


@query(f"""with m as (select distinct s_sample, qualrep from cluster_runs where s_sample is not null and qualrep is not null)
          select qualrep g_groupname, count(distinct s_sample) samples, count(distinct h_popuid) haplotypes from sample_info join m using (s_sample) where project_name = {_ONE} group by 1""")
def api_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, project = _first(spark, sf_dir)
    meta = table(spark, sf_dir, "cluster_runs").where("qualrep is not null").select("s_sample", "qualrep").distinct()
    return store.groups(meta, project, "qualrep")


@query("""with d as (select s_sample, h_popuid, loaded_at, c_readcnt, row_number() over (partition by s_sample, h_popuid order by loaded_at desc, c_readcnt desc) r from sample_info where s_sample is not null and h_popuid is not null)
          select s_sample, h_popuid, loaded_at, c_readcnt from d where r = 1""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last delivery of every sample and haplotype: what a table cache shows after a reload."""
    rows_ = table(spark, sf_dir, "sample_info").where("s_sample is not null and h_popuid is not null").select("s_sample", "h_popuid", "loaded_at", "c_readcnt")
    w = Window.partitionBy("s_sample", "h_popuid").orderBy(F.desc("loaded_at"), F.desc("c_readcnt"))
    return rows_.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


_META = "m as (select distinct s_sample, qualrep, sortby from cluster_runs where s_sample is not null)"
_LAST = "(select max(project_name) from sample_info)"
_VALUE = "(select min(qualrep) from cluster_runs)"


def _group(spark: SparkSession, sf_dir: str) -> tuple[ResultStore, DataFrame, str, str]:
    """The store, the metadata, the last project and the first value of the field qualrep."""
    info, meta = table(spark, sf_dir, "sample_info"), table(spark, sf_dir, "cluster_runs").where("s_sample is not null").select("s_sample", "qualrep", "sortby").distinct()
    return ResultStore(info), meta, info.agg(F.max("project_name")).first()[0], meta.agg(F.min("qualrep")).first()[0]


@query(f"with {_META}, x as (select m.* from m semi join (select s_sample from sample_info where project_name = {_LAST}) using (s_sample)) select 'qualrep' g_name from x having count(qualrep) > 0 union all select 'sortby' from x having count(sortby) > 0")
def api_group_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, meta, project, _ = _group(spark, sf_dir)
    return store.group_names(meta, project)


_IN_GROUP = f"sample_info where project_name = {_LAST} and s_sample in (select s_sample from m where qualrep = {_VALUE})"


@query(f"with {_META} select distinct s_sample from {_IN_GROUP}")
def api_group_sample_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, meta, project, value = _group(spark, sf_dir)
    return store.within(meta, "qualrep", value).sample_names(project)


@query(f"with {_META} select s_sample, h_popuid, c_readcnt, {_VALUE} g_groupname from {_IN_GROUP}")
def api_group_samp_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, meta, project, value = _group(spark, sf_dir)
    rows_ = store.within(meta, "qualrep", value)
    return rows_._of(project).select("s_sample", "h_popuid", "c_readcnt", F.lit(value).alias("g_groupname"))


@query(f"with {_META} select h_popuid, count(distinct s_sample) samples, sum(c_readcnt)::bigint reads from {_IN_GROUP} and h_popuid is not null group by 1")
def api_group_pop_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, meta, project, value = _group(spark, sf_dir)
    return store.within(meta, "qualrep", value).populations(project, [])


@query(f"""with {_META} select h_popuid, coalesce(max(c_averagedfrac) filter (s_sample = 'MIXCTRL-00' and not isnan(c_averagedfrac)), 0) "MIXCTRL-00" from {_IN_GROUP} and s_sample = 'MIXCTRL-00' and h_popuid is not null group by 1""")
def api_group_hap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, meta, project, value = _group(spark, sf_dir)
    return store.within(meta, "qualrep", value).matrix(project, [], ["MIXCTRL-00"])


@query("select s_sample, target_name, upper(seq_) seq, sum(cnt_) cnt from clusters where seq_ is not null and s_sample = (select min(s_sample) from clusters) group by all")
def api_samp_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "clusters")
    final = rows_.where("seq_ is not null").groupBy("s_sample", "target_name", F.upper("seq_").alias("seq")).agg(F.sum("cnt_").alias("cnt"))
    return ResultStore(table(spark, sf_dir, "sample_info"), final=final).sample_sequences([rows_.agg(F.min("s_sample")).first()[0]])


@query("select min(name_) h_popuid, target_name, upper(seq_) seq, count(distinct s_sample) samples from clusters where seq_ is not null group by target_name, upper(seq_)")
def api_pop_seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows_ = table(spark, sf_dir, "clusters").where("seq_ is not null")
    population = rows_.groupBy("target_name", F.upper("seq_").alias("seq")).agg(F.min("name_").alias("h_popuid"), F.count_distinct("s_sample").alias("samples"))
    return ResultStore(table(spark, sf_dir, "sample_info"), population=population).population_sequences([])
