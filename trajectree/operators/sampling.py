"""Samples by a hash order: the same rows on every run and any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table


def place(seed: int, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


@query("select o_orderpriority, o_orderkey from (select *, row_number() over (partition by o_orderpriority order by md5('42:' || o_orderkey), o_orderkey) as k from orders) where k <= 100")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most a hundred rows of each problem."""
    order = Window.partitionBy("o_orderpriority").orderBy(place(42, F.col("o_orderkey")), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(order)).filter("k <= 100").select("o_orderpriority", "o_orderkey")


@query("select event_id from events order by md5('0:' || event_id), event_id limit 50")
def uniform_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id").orderBy(place(0, F.col("event_id")), "event_id").limit(50)


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts, event_id) as k from events) where k <= 3")
def first_n_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("k", F.row_number().over(order)).filter("k <= 3").select("user_id", "event_id")
