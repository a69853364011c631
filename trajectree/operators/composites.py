"""Composed reports: results beside attempts, distributions, stratified evaluation, experiment summaries, edit coverage and variable uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.operators.rollups import _EDGES
from trajectree.operators.trees import flattened, parsed
from trajectree.registry import query
from trajectree.sources.programs import programs
from trajectree.sources.tables import table


@query("""with w as (select user_id, max_by(event_id, (ts, event_id)) as last_wrong, count(*) as n_wrong from events where event_type = 'error' group by 1),
a as (select user_id, max_by(event_id, (ts, event_id)) as own_accept from events where event_type = 'purchase' group by 1)
select u.user_id, last_wrong, own_accept, coalesce(n_wrong, 0) as n_wrong from (select distinct user_id from events) u left join w using (user_id) left join a using (user_id)""")
def results_with_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last wrong attempt and own accepted one; null where there is none. One pass, no join."""
    last = lambda kind: F.max_by(F.when(F.col("event_type") == kind, F.col("event_id")), F.when(F.col("event_type") == kind, F.struct("ts", "event_id")))
    wrong = F.count_if(F.col("event_type") == "error")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last("error").alias("last_wrong"), last("purchase").alias("own_accept"), wrong.alias("n_wrong"))


@query("""select user_id, n_wrong, n_stmts from (select user_id, count(case when event_type = 'error' then 1 end) as n_wrong,
cast(3 * count(case when event_type = 'purchase' then 1 end) as bigint) as n_stmts from events group by 1) where n_wrong >= 2 and n_stmts > 0""")
def wrong_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users with two wrong attempts or more, and statements in their accepted programs."""
    p = programs(spark, sf_dir)
    stmts = flattened(p.filter("event_type = 'purchase'").select("user_id", "event_id", "code")).filter("is_stmt").groupBy("user_id").agg(F.count("*").alias("n_stmts"))
    wrong = p.groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("n_wrong")).filter("n_wrong >= 2")
    return wrong.join(stmts, "user_id").select("user_id", "n_wrong", "n_stmts")


@query("""select r_name as contest, chr(cast(96 + k as int)) as letter, n_name as problem from
(select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) join region on r_regionkey = n_regionkey where k <= 4""")
def contest_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Problems joined with their contest and task letter; those beyond the contest's four letters drop out."""
    place = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey"))
    letters = F.explode(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.struct(k.alias("k"), F.char(96 + k).alias("letter")))).alias("x")
    contests = table(spark, sf_dir, "region").select("r_regionkey", F.col("r_name").alias("contest"), letters).select("r_regionkey", "contest", "x.*")
    problems = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("r_regionkey"), place.alias("k"), F.col("n_name").alias("problem"))
    return problems.join(contests, ["r_regionkey", "k"]).select("contest", "letter", "problem")


@query("""select r_name as contest, count(*) as n_problems, string_agg(n_nationkey, ',' order by n_nationkey) as pids from nation join region on r_regionkey = n_regionkey group by 1""")
def problems_by_contest(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    pids = F.array_join(F.sort_array(F.collect_list("n_nationkey")).cast("array<string>"), ",")
    return both.groupBy(F.col("r_name").alias("contest")).agg(F.count("*").alias("n_problems"), pids.alias("pids"))


@query("""select l_orderkey, any_value(l_quantity) as least, count(*) as n_ties, cast(min(l_linenumber) as bigint) as pick
from (select *, rank() over (partition by l_orderkey order by l_quantity) as r from lineitem) where r = 1 group by 1""")
def argmin_with_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least quantity of each order, how many lines tie, and the first of them: counted by value, then the least value's count is taken."""
    ties = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_quantity").agg(F.count("*").alias("n"), F.min("l_linenumber").cast("long").alias("first"))
    least = F.min(F.struct("l_quantity", "n", "first")).alias("x")
    return ties.groupBy("l_orderkey").agg(least).select("l_orderkey", F.col("x.l_quantity").alias("least"), F.col("x.n").alias("n_ties"), F.col("x.first").alias("pick"))


@query("select l_suppkey as pid, count(*) as n_targets, count(case when l_returnflag <> 'R' then 1 end) as n_failing from lineitem group by 1")
def failing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    failing = F.count_if(F.col("l_returnflag") != "R")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pid")).agg(F.count("*").alias("n_targets"), failing.alias("n_failing"))


@query("""select l_orderkey, list_aggregate(list_slice(l, 1, 2), 'string_agg', ',') as first_two, cast(l[-1] as bigint) as last, cast(l[3] as bigint) as third
from (select l_orderkey, list_sort(list(l_linenumber)) as l from lineitem group by 1)""")
def ordered_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two, the last and the third of each order's lines; null where there is none."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("l"))
    at = lambda k: F.try_element_at("l", F.lit(k)).cast("long")
    return lines.select("l_orderkey", F.array_join(F.slice("l", 1, 2).cast("array<string>"), ",").alias("first_two"), at(-1).alias("last"), at(3).alias("third"))


_RATIOS = "select l_orderkey, round(least(1.0, sum(l_linenumber) / sum(l_quantity)), 6) as x from lineitem group by 1"


@query(f"""with r as ({_RATIOS}), o as (select x, row_number() over (order by x) - 1 as k, count(*) over () as m from r),
p as (select unnest([10, 25, 50, 75, 90, 95]) as p)
select 'p' || p as what, x as value from o join p on k = least(m - 1, p * m // 100) union all select {_EDGES}, cast(count(*) as double) from r group by 1""")
def holes_ratio_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles and histogram of the ratio of holes of each order, from counts of its rounded values: no row meets all others."""
    ratio = F.round(F.least(F.lit(1.0), F.sum("l_linenumber") / F.sum("l_quantity")), 6)
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(ratio.alias("x")).groupBy("x").agg(F.count("*").alias("n"))
    # Places come from sums over ranges of a tenth of a thousandth, at most 10,001 rows, and over the values inside one range.
    counts = counts.withColumn("range", F.floor(F.col("x") * 10000))
    ranges = counts.groupBy("range").agg(F.sum("n").alias("of_range"))
    before = F.coalesce(F.sum("of_range").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("range", before.alias("before"), F.sum("of_range").over(Window.partitionBy()).alias("m"))
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.join(ranges, "range").withColumn("upto", upto).withColumn("p", F.explode(F.array(*map(F.lit, (10, 25, 50, 75, 90, 95)))))
    at = F.least(F.col("m") - 1, F.expr("(p * m) div 100"))
    percentiles = placed.filter((at < F.col("upto")) & (at >= F.col("upto") - F.col("n"))).select(F.concat(F.lit("p"), "p").alias("what"), F.col("x").alias("value"))
    return percentiles.union(counts.groupBy(F.expr(_EDGES).alias("what")).agg(F.sum("n").cast("double").alias("value")))


@query("""with s as (select l_suppkey as pid, l_returnflag = 'R' as passed, row_number() over (partition by l_suppkey order by md5(l_orderkey || '-' || l_linenumber), l_orderkey, l_linenumber) as k from lineitem),
c as (select pid, count(*) as n, count(case when passed then 1 end) as n_passed from s where k <= 20 group by 1)
select pid % 8 as worker, pid, n, n_passed, cast(sum(n) over w as bigint) as done, cast(sum(n_passed) over w as bigint) as done_passed from c window w as (partition by pid % 8 order by pid)""")
def stratified_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty targets of each problem by hash, their outcomes, and each worker's running totals."""
    key = F.md5(F.concat_ws("-", "l_orderkey", "l_linenumber").cast("binary"))
    place = F.row_number().over(Window.partitionBy("pid").orderBy("key", "l_orderkey", "l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("pid"), "l_orderkey", "l_linenumber", (F.col("l_returnflag") == "R").alias("passed"), key.alias("key"))
    counts = rows.withColumn("k", place).filter("k <= 20").groupBy("pid").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"))
    upto = Window.partitionBy("worker").orderBy("pid").rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("worker", F.col("pid") % 8)
    return counts.select("worker", "pid", "n", "n_passed", F.sum("n").over(upto).alias("done"), F.sum("n_passed").over(upto).alias("done_passed"))


@query("""with t as (select l_suppkey as pid, l_orderkey, max(case when l_returnflag = 'R' then 1 else 0 end) as ok, sum(l_linenumber) as ted from lineitem group by 1, 2)
select coalesce(cast(pid as varchar), 'OVERALL') as pid, count(*) as n_users, cast(sum(ok) as bigint) as n_pass, round(avg(ok), 6) as rate, round(coalesce(avg(case when ok = 1 then ted end), 0), 6) as ted_mean from t group by rollup(pid)""")
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of repair and mean edit of each problem, and of all."""
    targets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pid"), "l_orderkey")
    targets = targets.agg(F.max(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("ok"), F.sum("l_linenumber").alias("ted"))
    mean = F.coalesce(F.avg(F.when(F.col("ok") == 1, F.col("ted"))), F.lit(0.0))
    out = targets.rollup("pid").agg(F.count("*").alias("n_users"), F.sum("ok").alias("n_pass"), F.round(F.avg("ok"), 6).alias("rate"), F.round(mean, 6).alias("ted_mean"))
    return out.withColumn("pid", F.coalesce(F.col("pid").cast("string"), F.lit("OVERALL")))


@query("""select user_id, v as variable, a as access, p as parent_type, g as grandparent_type, count(*) as n from events join (values
('error', 'x', 'store', 'Assign', 'Module'), ('error', 'print', 'load', 'Call', 'Expr'), ('error', 'x', 'load', 'Call', 'Expr'),
('click', 'i', 'store', 'For', 'Module'), ('click', 'range', 'load', 'Call', 'For'), ('click', 'print', 'load', 'Call', 'Expr'), ('click', 'i', 'load', 'Call', 'Expr'),
('view', 'n', 'store', 'Assign', 'Module'), ('view', 'int', 'load', 'Call', 'Assign'), ('view', 'input', 'load', 'Call', 'Call'), ('view', 'n', 'load', 'Compare', 'If'),
('view', 'print', 'load', 'Call', 'Expr'), ('view', 'n', 'load', 'Call', 'Expr'),
('signup', 'total', 'store', 'Assign', 'Module'), ('signup', 'total', 'store', 'AugAssign', 'Module'), ('signup', 'print', 'load', 'Call', 'Expr'), ('signup', 'total', 'load', 'Call', 'Expr'),
('purchase', 'x', 'store', 'Assign', 'Module'), ('purchase', 'y', 'store', 'Assign', 'Module'), ('purchase', 'print', 'load', 'Call', 'Expr'), ('purchase', 'x', 'load', 'Call', 'Expr'),
('purchase', 'y', 'load', 'Call', 'Expr')) t(kind, v, a, p, g) on kind = event_type group by all""")
def variable_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of all variables of a user's programs: stored or loaded, under which parent and grandparent; found inside each program, whose nodes lie in preorder."""
    n = parsed(programs(spark, sf_dir).select("user_id", "code").repartition("user_id"), "parent", "type", "label", "ctx")
    names = F.filter(F.arrays_zip("parent", "type", "label", "ctx"), lambda x: x["type"] == "Name")
    use = lambda x: F.struct(
        F.substring(x["label"], 6, 1 << 30).alias("variable"),  # after "Name:"
        F.when(x["ctx"] == "Store", "store").otherwise("load").alias("access"),
        F.get("type", x["parent"]).alias("parent_type"),
        F.get("type", F.get("parent", x["parent"])).alias("grandparent_type"),
    )
    uses = n.select("user_id", F.inline(F.transform(names, use)))
    return uses.groupBy("user_id", "variable", "access", "parent_type", "grandparent_type").agg(F.count("*").alias("n"))
