"""Set and multiset algebra, upserts, deletes and resumption."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table


@query("""
with b as (select distinct p_brand, p_size, p_type from part), n as (select p_brand, count(distinct p_size) as n from b group by 1)
select p_brand, p_type from b join n using (p_brand) where n > 0 group by p_brand, p_type, n having count(distinct p_size) * 4 >= n""")
def stable_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types found in a quarter of a brand's sizes or more (relational division with a share)."""
    rows = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_type").distinct()
    sizes = rows.groupBy("p_brand").agg(F.countDistinct("p_size").alias("n"))
    found = rows.groupBy("p_brand", "p_type").agg(F.count("*").alias("m"))
    return found.join(sizes, "p_brand").filter("m * 4 >= n").select("p_brand", "p_type")


@query("""
with t as (select l_orderkey, l_returnflag, l_linestatus, l_linenumber from lineitem), w as (select l_orderkey, count(distinct l_linenumber) as n from t group by 1)
select l_orderkey, l_returnflag from t join w using (l_orderkey) group by l_orderkey, l_returnflag, n having count(distinct l_linenumber) = n""")
def nway_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flags that all lines of an order have; an order without lines has none."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").distinct()
    found = t.groupBy("l_orderkey", "l_returnflag").agg(F.count("*").alias("m"))
    every = t.groupBy("l_orderkey").agg(F.countDistinct("l_linenumber").alias("n"))
    return found.join(every, "l_orderkey").filter("m = n").select("l_orderkey", "l_returnflag")


@query("select c_custkey from customer except select o_custkey from orders where o_totalprice > 300000")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey").subtract(table(spark, sf_dir, "orders").filter("o_totalprice > 300000").select("o_custkey"))


@query("""
with a as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'A' group by 1), b as (select l_partkey as k, count(*) as n from lineitem where l_returnflag = 'R' group by 1)
select coalesce(a.k, b.k) as k, least(coalesce(a.n, 0), coalesce(b.n, 0)) as both_min, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) as both_max,
  greatest(coalesce(a.n, 0) - coalesce(b.n, 0), 0) as only_left from a full join b on a.k = b.k""")
def multiset_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset intersection, union and difference by counts, in one aggregation."""
    side = lambda flag: F.count(F.when(F.col("l_returnflag") == flag, 1))
    n = table(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')").groupBy(F.col("l_partkey").alias("k")).agg(side("A").alias("a"), side("R").alias("b"))
    return n.select("k", F.least("a", "b").alias("both_min"), F.greatest("a", "b").alias("both_max"), F.greatest(F.col("a") - F.col("b"), F.lit(0).cast("long")).alias("only_left"))


@query("select min(doc_id) as doc_id, count(*) as n from documents group by text")
def dedupe_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal candidates once, at their lowest rank."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("digest")


#: Rows that a task of :func:`upsert_latest` has, about.
TASK_ROWS = 1 << 18

_SPLIT = "o_orderdate < timestamp '1996-01-01'"


@query(f"""
with old as (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where {_SPLIT} group by 1),
new as (select o_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders where not ({_SPLIT}) group by 1)
select * from new union all select * from old where o_custkey not in (select o_custkey from new)""")
def upsert_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old summary rows of a key give way to new ones."""
    orders = table(spark, sf_dir, "orders")
    total = lambda rows: rows.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return upsert(total(orders.filter(_SPLIT)), total(orders.filter(f"not ({_SPLIT})")), "o_custkey")


def upsert(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    return old.join(new, list(keys), "left_anti").unionByName(new)


@query("select l_orderkey, l_linenumber, arg_max(l_quantity, l_shipdate) as l_quantity from (select l_orderkey, cast(l_linenumber % 3 as bigint) as l_linenumber, max(l_quantity) as l_quantity, l_shipdate from lineitem group by 1, 2, 4) group by 1, 2")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest version of a result by its key. Rows are dealt out once, to as many tasks as their number asks for, so the groups of a task don't grow with the table."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).cast("long").alias("l_linenumber"), "l_shipdate", "l_quantity")
    dealt = lines.repartition(lines.count() // TASK_ROWS + 1, "l_orderkey", "l_linenumber")  # counted from the files' footers
    rows = dealt.groupBy("l_orderkey", "l_linenumber", "l_shipdate").agg(F.max("l_quantity").alias("q"))
    return rows.groupBy("l_orderkey", "l_linenumber").agg(F.max_by("q", "l_shipdate").alias("l_quantity"))


@query("select event_id, user_id from events where user_id not in (select user_id from events where event_type = 'signup' and value > 90)")
def delete_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    return events.join(events.filter("event_type = 'signup' and value > 90").select("user_id"), "user_id", "left_anti").select("event_id", "user_id")


@query("select p_brand, count(*) as n_pending from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 45) group by 1")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work that has no result yet."""
    done = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, sf_dir, "part").join(done, "p_partkey", "left_anti").groupBy("p_brand").agg(F.count("*").alias("n_pending"))


@query("select o_custkey, o_orderkey as second_last from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as k from orders) where k = 2")
def second_to_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    rows = table(spark, sf_dir, "orders").withColumn("k", F.row_number().over(order)).filter("k = 2")
    return rows.select("o_custkey", F.col("o_orderkey").alias("second_last"))
