"""The dataset build as one plan: submissions are cut at the first accepted one, joined with their sources, and kept if whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.programs import programs


def build_trajectories(submissions: DataFrame, sources: DataFrame, least_wrong: int = 2, least_trajectories: int = 2, tie: str = "sid") -> DataFrame:
    """pid, user_id and submissions (ts, sid, verdict, code in order; equal times by ``tie``).

    submissions: pid, user_id, sid, ts, verdict; sources: sid, code, and pid if ids are a problem's own. A trajectory ends at its first accepted submission with enough wrong ones before it;
    it goes if a source is missing, and so do problems of too few trajectories.
    """
    history = Window.partitionBy("pid", "user_id")
    rows = submissions.withColumn("_n", F.row_number().over(history.orderBy("ts", tie)))
    rows = rows.withColumn("_end", F.min(F.when(F.col("verdict") == "Accepted", F.col("_n"))).over(history)).filter("_n <= _end").filter(F.col("_end") > least_wrong)
    keys = [c for c in ("pid", "sid") if c in sources.columns]
    rows = rows.join(sources.select(*keys, "code"), keys, "left")
    ordered = F.array_sort(F.collect_list(F.struct("_n", F.struct("ts", "sid", "verdict", "code").alias("s"))))
    kept = rows.groupBy("pid", "user_id").agg(ordered["s"].alias("submissions"), F.bool_and(F.col("code").isNotNull()).alias("_whole"))
    kept = kept.filter("_whole").drop("_whole")
    return kept.withColumn("_k", F.count("*").over(Window.partitionBy("pid"))).filter(F.col("_k") >= least_trajectories).drop("_k")


@query("""
with s as (select 'p' || event_id % 50 as pid, user_id, event_id, event_type, value, row_number() over (partition by event_id % 50, user_id order by ts, event_id) as n from events),
f as (select *, min(case when event_type = 'purchase' then n end) over (partition by pid, user_id) as last from s),
t as (select pid, user_id, count(*) as n, bool_and(coalesce(value >= 1, false)) as whole from f where n <= last and last > 2 group by all),
k as (select *, count(*) over (partition by pid) as k from t where whole)
select pid, count(*) as n_trajectories, cast(sum(n) as bigint) as n_submissions, max(n) as longest from k where k >= 2 group by 1""")
def dataset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories made of events: problems by number, purchases accepted, others wrong; an event of value under 1 has no source."""
    rows = programs(spark, sf_dir)
    verdict = F.when(F.col("event_type") == "purchase", "Accepted").otherwise("Wrong Answer")
    submissions = rows.select(F.concat(F.lit("p"), (F.col("event_id") % 50).cast("string")).alias("pid"), "user_id", F.col("event_id").alias("sid"), "ts", verdict.alias("verdict"))
    sources = rows.filter("value >= 1").select(F.col("event_id").alias("sid"), "code")
    n = F.size("submissions").cast("long")
    return build_trajectories(submissions, sources).groupBy("pid").agg(F.count("*").alias("n_trajectories"), F.sum(n).alias("n_submissions"), F.max(n).alias("longest"))
