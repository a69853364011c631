"""Ordered histories: what came before the first success, last successes, positions and running progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table


def until_first_accept(events: DataFrame) -> DataFrame:
    """Rows of each user up to the first purchase, by (ts, event_id), with seq; users without one, or with under two errors before it, go."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = events.withColumn("seq", F.row_number().over(order).cast("long"))
    user = Window.partitionBy("user_id")
    rows = rows.withColumn("_first", F.min(F.when(F.col("event_type") == "purchase", F.col("seq"))).over(user)).filter(F.col("seq") <= F.col("_first"))
    return rows.withColumn("n_wrong", F.sum((F.col("event_type") == "error").cast("long")).over(user)).filter("n_wrong >= 2").drop("_first")


_CUT = """
with r as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events),
f as (select *, min(case when event_type = 'purchase' then seq end) over (partition by user_id) as first from r),
t as (select *, cast(sum(case when event_type = 'error' then 1 else 0 end) over (partition by user_id) as bigint) as n_wrong from f where seq <= first)
"""


@query(_CUT + "select user_id, event_id, seq, event_type from t where n_wrong >= 2")
def truncate_first_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return until_first_accept(table(spark, sf_dir, "events")).select("user_id", "event_id", "seq", "event_type")


@query(_CUT + "select user_id, any_value(n_wrong) as n_wrong, count(*) as n_events from t where n_wrong >= 2 group by user_id")
def qualifying_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = until_first_accept(table(spark, sf_dir, "events"))
    return rows.groupBy("user_id").agg(F.first("n_wrong").alias("n_wrong"), F.count("*").alias("n_events"))


@query(_CUT + "select user_id, max_by(event_id, seq) as event_id from t where n_wrong >= 2 and event_type = 'error' group by user_id")
def last_wrong_before_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = until_first_accept(table(spark, sf_dir, "events")).filter("event_type = 'error'")
    return rows.groupBy("user_id").agg(F.max_by("event_id", "seq").alias("event_id"))


@query("select conv_id, count(*) as n_turns, string_agg(role, '>' order by turn) as roles, cast(sum(len(text)) as bigint) as n_chars from conversations group by conv_id")
def trajectory_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as one nested value, in order."""
    nested = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    roles = F.array_join(F.transform("turns", lambda t: t["role"]), ">")
    chars = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + F.length(t["text"]))
    return nested.select("conv_id", F.size("turns").cast("long").alias("n_turns"), roles.alias("roles"), chars.alias("n_chars"))


@query("select user_id, max_by(event_id, struct_pack(a := ts, b := event_id)) as event_id, count(*) as n_accepted from events where event_type = 'purchase' group by user_id")
def last_accept_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = table(spark, sf_dir, "events").filter("event_type = 'purchase'")
    return accepted.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("n_accepted"))


@query("select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey) - 1 as test_id from lineitem")
def positional_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.row_number().over(order) - 1).cast("long").alias("test_id"))


@query("""
with d as (select cast(o_orderdate as date) as day, count(*) as n, sum(case when o_orderstatus = 'F' then 1 else 0 end) as passed from orders group by 1)
select day, cast(sum(n) over w as bigint) as done, cast(sum(passed) over w as bigint) as passed, round(sum(passed) over w * 1.0 / sum(n) over w, 6) as rate
from d window w as (order by day)""")
def running_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals and rate by day; rows are summed by day before the one ordered window."""
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day"))
    days = days.agg(F.count("*").alias("n"), F.sum((F.col("o_orderstatus") == "F").cast("long")).alias("p"))
    so_far = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    done, passed = F.sum("n").over(so_far), F.sum("p").over(so_far)
    return days.select("day", done.alias("done"), passed.alias("passed"), F.round(passed / done, 6).alias("rate"))
