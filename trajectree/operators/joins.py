"""Joins of the repair data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table


@query("""select i.conv_id, i.turn, len(i.text) as input_chars, len(o.text) as output_chars from conversations i join conversations o
on i.conv_id = o.conv_id and o.turn = i.turn + 1 and i.role = 'user' and o.role = 'assistant'""")
def pair_inputs_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs and outputs paired by name."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select("conv_id", "turn", F.length("text").cast("long").alias("input_chars"))
    said = turns.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").cast("long").alias("output_chars"))
    return asked.join(said, ["conv_id", "turn"])


@query("select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment like 'B%')")
def benchmark_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = table(spark, sf_dir, "customer").filter(F.col("c_mktsegment").startswith("B"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return orders.join(listed, orders["o_custkey"] == listed["c_custkey"], "left_semi")


@query("select l_orderkey, count(*) as n from lineitem left join part on p_partkey = l_partkey and p_size > 1 group by l_orderkey having bool_and(p_partkey is not null) and count(*) >= 2")
def complete_trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trajectories whose every source is there, of two members or more."""
    sources = table(spark, sf_dir, "part").filter("p_size > 1").select("p_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    joined = lines.join(sources, lines["l_partkey"] == sources["p_partkey"], "left")
    return joined.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.bool_and(F.col("p_partkey").isNotNull()).alias("whole")).filter("whole and n >= 2").drop("whole")


@query("""select a.p_partkey as part, count(*) as n_candidates, min(b.p_partkey) as first_candidate from part a join part b
on a.p_type = b.p_type and a.p_brand = b.p_brand and b.p_size between 0.5 * a.p_size and 2.0 * a.p_size and a.p_partkey <> b.p_partkey group by 1""")
def band_join_size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the same type and sizes within a factor of two. Sizes are joined, not parts: a part's candidates are counted by size, so none are paired."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_brand", "p_size")
    of = ["p_type", "p_brand"]
    first = F.row_number().over(Window.partitionBy(*of, "p_size").orderBy("p_partkey"))
    two = part.withColumn("k", first).filter("k <= 2").groupBy(*of, "p_size").agg(F.sort_array(F.collect_list("p_partkey")).alias("two"))
    sizes = part.groupBy(*of, "p_size").agg(F.count("*").alias("n")).join(two, [*of, "p_size"])
    other = sizes.select(*of, F.col("p_size").alias("size"), F.col("n").alias("m"), F.col("two").alias("others"))
    near = F.col("size").between(0.5 * F.col("p_size"), 2.0 * F.col("p_size"))
    bands = sizes.join(other, of).filter(near).groupBy(*of, "p_size")
    others = F.slice(F.sort_array(F.flatten(F.collect_list("others"))), 1, 2)
    bands = bands.agg(F.sum("m").alias("m"), others.alias("two"))
    found = part.join(bands, [*of, "p_size"]).filter("m > 1")
    pick = F.when(F.col("two")[0] == F.col("p_partkey"), F.col("two")[1]).otherwise(F.col("two")[0])
    return found.select(F.col("p_partkey").alias("part"), (F.col("m") - 1).alias("n_candidates"), pick.alias("first_candidate"))


@query("""
with l as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as k from lineitem where l_returnflag = 'A'),
r as (select l_orderkey, l_linenumber, l_partkey, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber) as k from lineitem where l_returnflag = 'R')
select l.l_partkey as label, l.k, l.l_orderkey as left_key, r.l_orderkey as right_key from l join r on l.l_partkey = r.l_partkey and l.k = r.k""")
def kth_leaf_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th leaf of a label with the k-th of the other side."""
    lines = table(spark, sf_dir, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber")).cast("long")
    side = lambda flag, name: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("label"), rank.alias("k"), F.col("l_orderkey").alias(name))
    return side("A", "left_key").join(side("R", "right_key"), ["label", "k"])


@query("select doc_id from documents d where exists (select 1 from documents o where o.text = d.text and o.source <> d.source)")
def leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose whole text another source has too: equal texts are grouped by digest, never paired."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("digest")).filter("source is not null")
    shared = docs.groupBy("digest").agg(F.min("source").alias("a"), F.max("source").alias("b")).filter("a <> b")
    return docs.join(shared, "digest", "left_semi").select("doc_id")


@query("select c_custkey, coalesce(max_by(o_orderstatus, struct_pack(a := o_orderdate, b := o_orderkey)), '?') as outcome from customer left join orders on o_custkey = c_custkey group by c_custkey")
def outcome_left_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderstatus", F.struct("o_orderdate", "o_orderkey")).alias("outcome"))
    return table(spark, sf_dir, "customer").select("c_custkey").join(last, "c_custkey", "left").select("c_custkey", F.coalesce("outcome", F.lit("?")).alias("outcome"))


@query("""select n_nationkey, s_suppkey, c.n as n_tests from nation join supplier on s_nationkey = n_nationkey
join (select c_nationkey, count(*) as n from customer group by 1) c on c_nationkey = n_nationkey""")
def cross_candidate_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tests that each candidate of a problem has to run: counted by problem, so the product is never built."""
    tests = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n_tests"))
    candidates = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), "s_suppkey")
    return table(spark, sf_dir, "nation").select("n_nationkey").join(candidates, "n_nationkey").join(tests, "n_nationkey")
