"""Roll-ups of outcomes: rates, means, medians, exact percentiles, histograms and contingency tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table

_PASS = "l_returnflag = 'R'"
_TRIED = "l_linestatus <> 'O'"


def count_if(condition: str) -> Column:
    return F.count_if(F.expr(condition))


@query("""select l_suppkey, round(sum(case when l_returnflag = 'R' then 1 else 0 end) / greatest(count(*), 1), 6) as of_all,
round(coalesce(sum(case when l_returnflag = 'R' then 1 else 0 end) / nullif(sum(case when l_linestatus <> 'O' then 1 else 0 end), 0), 0), 6) as of_tried,
round(sum(case when l_returnflag = 'R' then 1 else 0 end) / count(distinct l_orderkey), 6) as of_users from lineitem group by 1""")
def repair_rate_three_denominators(spark: SparkSession, sf_dir: str) -> DataFrame:
    passed = count_if(_PASS)
    of = lambda n: F.round(F.coalesce(F.try_divide(passed, n), F.lit(0.0)), 6)
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(of(F.count("*")).alias("of_all"), of(count_if(_TRIED)).alias("of_tried"), of(F.countDistinct("l_orderkey")).alias("of_users"))


@query("""with p as (select l_shipdate, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as p from lineitem group by 1)
select year(l_shipdate) as y, round(sum(p) / sum(n), 6) as micro, round(avg(p / n), 6) as macro from p group by 1""")
def micro_macro_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "lineitem").groupBy("l_shipdate").agg(F.count("*").alias("n"), count_if(_PASS).alias("p"))
    micro, macro = F.sum("p") / F.sum("n"), F.avg(F.col("p") / F.col("n"))
    return days.groupBy(F.year("l_shipdate").cast("long").alias("y")).agg(F.round(micro, 6).alias("micro"), F.round(macro, 6).alias("macro"))


@query("select n_name, round(coalesce(avg(case when c_acctbal > 0 then c_acctbal end), 0.0), 4) as mean from nation left join customer on c_nationkey = n_nationkey group by 1")
def mean_ignore_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return joined.groupBy("n_name").agg(F.round(F.coalesce(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))), F.lit(0.0)), 4).alias("mean"))


@query("select n_name, round(coalesce(median(s_acctbal), 0.0), 4) as median from nation left join supplier on s_nationkey = n_nationkey group by 1")
def median_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean of the two middle values of each group, from counts of distinct values: no group is held whole."""
    known = table(spark, sf_dir, "supplier").filter("s_acctbal is not null").groupBy("s_nationkey", "s_acctbal").agg(F.count("*").alias("n"))
    of = Window.partitionBy("s_nationkey")
    upto = F.sum("n").over(of.orderBy("s_acctbal").rowsBetween(Window.unboundedPreceding, 0))
    placed = known.withColumn("upto", upto).withColumn("m", F.sum("n").over(of))
    middle = lambda at: F.max(F.when((at < F.col("upto")) & (at >= F.col("upto") - F.col("n")), F.col("s_acctbal")))
    medians = placed.groupBy("s_nationkey").agg(((middle(F.expr("(m - 1) div 2")) + middle(F.expr("m div 2"))) / 2).alias("median"))
    joined = table(spark, sf_dir, "nation").join(medians, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    return joined.select("n_name", F.round(F.coalesce("median", F.lit(0.0)), 4).alias("median"))


@query("select event_type, count(*) as n, count(value) as n_known, count(case when value > 50 then 1 end) as n_positive from events group by 1")
def positive_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count("value").alias("n_known"), F.count_if(F.col("value") > 50).alias("n_positive"))


@query("""with r as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as k, count(*) over (partition by lang) as m from documents)
select lang, p, n_chars as value from r, (select unnest([10, 25, 50, 75, 90, 95]) as p) where k = least(m - 1, (p * m) // 100)""")
def floor_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sorted[min(m - 1, p * m / 100)] of each group, exactly, from counts of distinct values: no group is sorted whole."""
    counts = table(spark, sf_dir, "documents").groupBy("lang", "n_chars").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("lang").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.withColumn("upto", upto).withColumn("m", F.sum("n").over(Window.partitionBy("lang")))
    rows = rows.withColumn("p", F.explode(F.array(*map(F.lit, (10, 25, 50, 75, 90, 95)))))
    at = F.least(F.col("m") - 1, F.expr("(p * m) div 100"))
    return rows.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select("lang", "p", F.col("n_chars").alias("value"))


_EDGES = "case when x = 0 then '=0' when x < 0.1 then '(0,0.10]' when x < 0.25 then '(0.10,0.25]' when x < 0.5 then '(0.25,0.50]' when x < 0.75 then '(0.50,0.75]' else '(0.75,1.0]' end"


@query(f"""with h as (select {_EDGES} as bucket, count(*) as n from (select l_discount * 10 as x from lineitem) group by 1)
select bucket, n, repeat('#', cast(50 * n // (select max(n) from h) as int)) as bar from h""")
def ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six labelled buckets, the first for exact zero, with bars to the scale of the largest."""
    h = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("x")).groupBy(F.expr(_EDGES).alias("bucket")).agg(F.count("*").alias("n"))
    peak = F.max("n").over(Window.partitionBy())
    return h.withColumn("peak", peak).select("bucket", "n", F.expr("repeat('#', int(50 * n div peak))").alias("bar"))


_REASON = "case when l_returnflag = 'R' then null when l_linestatus = 'O' then 'timeout' when l_discount > 0.05 then 'wrong_output' when l_tax > 0.05 then 'runtime_error' else 'no_tests' end"


@query(f"""with r as (select l_shipdate, {_REASON} as reason from lineitem)
select year(l_shipdate) as y, count(case when reason = 'wrong_output' then 1 end) as wrong_output, count(case when reason = 'timeout' then 1 end) as timeout,
count(case when reason = 'runtime_error' then 1 end) as runtime_error, count(case when reason = 'no_tests' then 1 end) as no_tests from r where reason is not null group by 1""")
def fail_reason_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("y"), F.expr(_REASON).alias("reason")).filter("reason is not null")
    return reasons.groupBy("y").pivot("reason", ["wrong_output", "timeout", "runtime_error", "no_tests"]).agg(F.count("reason")).fillna(0)


@query("""select o_orderpriority, o_totalprice > 150000 as large, count(case when o_orderstatus = 'F' then 1 end) as passed,
count(case when o_orderstatus <> 'F' then 1 end) as failed from orders group by 1, 2""")
def contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", (F.col("o_totalprice") > 150000).alias("large")).agg(F.count_if(done).alias("passed"), F.count_if(~done).alias("failed"))


@query("select case when o_totalprice < 100000 then 'min' else 'ac' end as mode, count(*) as n from orders group by 1")
def mode_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.when(F.col("o_totalprice") < 100000, "min").otherwise("ac").alias("mode")).agg(F.count("*").alias("n"))


@query("select event_type, round(sum(value) / greatest(count(distinct user_id), 1), 6) as att, round(sum(value), 4) as total from events group by 1")
def att_even_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total seconds split evenly over users, one at least."""
    users = F.greatest(F.countDistinct("user_id"), F.lit(1))
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value") / users, 6).alias("att"), F.round(F.sum("value"), 4).alias("total"))


@query("""with s as (select l_orderkey, count(*) as n from lineitem group by 1), r as (select n, row_number() over (order by n, l_orderkey) - 1 as k, count(*) over () as m from s)
select min(n) as least, max(case when k = m // 2 then n end) as upper_median, max(n) as most from r""")
def size_min_median_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, upper median (sorted[m // 2]) and most lines of an order, from counts of sizes."""
    sizes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("c"))
    ordered = sizes.withColumn("upto", F.sum("c").over(Window.orderBy("n"))).withColumn("m", F.sum("c").over(Window.partitionBy()))
    middle = F.min(F.when(F.col("upto") > F.expr("m div 2"), F.col("n")))
    return ordered.agg(F.min("n").alias("least"), middle.alias("upper_median"), F.max("n").alias("most"))


@query("select o_orderkey, coalesce(bool_and(l_linestatus = 'F'), true) as passed, count(l_orderkey) as n_tests from orders left join lineitem on l_orderkey = o_orderkey and l_tax > 0.06 group by 1")
def all_tests_passed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passed if all tests are; true of no tests."""
    tests = table(spark, sf_dir, "lineitem").filter("l_tax > 0.06").groupBy(F.col("l_orderkey").alias("o_orderkey"))
    tests = tests.agg(F.bool_and(F.col("l_linestatus") == "F").alias("ok"), F.count("*").alias("n"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(tests, "o_orderkey", "left")
    return joined.select("o_orderkey", F.coalesce("ok", F.lit(True)).alias("passed"), F.coalesce("n", F.lit(0)).cast("long").alias("n_tests"))


@query("select l_partkey, min_by(l_orderkey, struct_pack(a := l_extendedprice, b := l_orderkey, c := l_linenumber)) as best, count(*) as n from lineitem group by 1")
def argmin_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min_by("l_orderkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber")).alias("best"), F.count("*").alias("n"))


@query("select l_orderkey, min(l_linenumber) as first_pass from lineitem where l_returnflag = 'R' group by 1")
def first_passing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(_PASS).groupBy("l_orderkey").agg(F.min("l_linenumber").alias("first_pass"))


@query("""select l_orderkey, round(coalesce((sum(l_quantity) - sum(l_linenumber)) / nullif(sum(l_quantity) + sum(l_linenumber), 0), 0), 6) as ip,
round(least(1.0, sum(l_linenumber) / sum(l_quantity)), 6) as holes from lineitem group by 1""")
def intent_and_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ts - tf) / (ts + tf), 0 of a zero sum; and the share of holes, 1 at most."""
    ts, tf = F.sum("l_quantity"), F.sum("l_linenumber")
    ip, holes = F.coalesce(F.try_divide(ts - tf, ts + tf), F.lit(0.0)), F.least(F.lit(1.0), tf / ts)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(ip, 6).alias("ip"), F.round(holes, 6).alias("holes"))


@query("""select l_shipmode_key as worker, cast(sum(n) as bigint) as n, cast(sum(p) as bigint) as passed from
(select l_suppkey % 8 as l_shipmode_key, l_suppkey, count(*) as n, sum(case when l_returnflag = 'R' then 1 else 0 end) as p from lineitem group by 1, 2) group by 1""")
def counters_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of tasks added up, as partial and final aggregation do."""
    return table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 8).alias("worker")).agg(F.count("*").alias("n"), count_if(_PASS).alias("passed"))
