"""Features of programs for retrieval: what each statement does, n-grams of the stream of statements and of node types, and tokens of values and operators.

A statement's signature is its type and the sorted set of its own tokens, those of statements inside it left out: operators, calls (of built-ins by name), methods,
kinds of constants and subscripts. No variable's name is part of any feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.functions.text import counted, counts, ngrams
from trajectree.operators.outlines import FEATURES
from trajectree.operators.similarity import as_arrays, nearest_classes
from trajectree.operators.trees import BUILTINS, parsed, value_tokens
from trajectree.registry import query
from trajectree.sources.order_programs import order_programs
from trajectree.sources.shared import cut, released, stored
from trajectree.sources.tables import table

__all__ = ["BUILTINS", "bags_of", "feature_bags", "signatures"]
#: What a statement's signature counts in a bag.
SIGNATURE_WEIGHT = 2
#: Programs that :func:`similar_programs` names for each.
SIMILAR = 20


def signatures(nodes: DataFrame) -> DataFrame:
    """prog, node and sig of every statement."""
    return nodes.filter("sig is not null").select("prog", "node", "sig")


def streams(nodes: DataFrame) -> DataFrame:
    """prog, and its nodes' type, label, const and sig as arrays in preorder, as :func:`parsed` gives them, from rows of nodes."""
    columns = ("type", "label", "const", "sig")
    rows = nodes.groupBy("prog").agg(F.array_sort(F.collect_list(F.struct("node", *columns))).alias("x"))
    return rows.select("prog", *(F.col("x")[c].alias(c) for c in columns))


def _features(programs: DataFrame) -> tuple[DataFrame, Column]:
    """Programs as arrays of nodes with what their features are made of, and all features of one as an array; prog, or another key, is the first column."""
    key = programs.columns[0]
    node = F.arrays_zip("type", "label", "const")
    values = F.flatten(F.transform(node, lambda x: value_tokens(lambda c: x[c])))
    rows = programs.select(key, F.filter("sig", lambda x: x.isNotNull()).alias("stmts"), F.col("type").alias("types"), values.alias("values"))
    twice = F.flatten(F.array(*[ngrams("stmts", 0, mark="EU:")] * SIGNATURE_WEIGHT))
    every = F.concat(ngrams("stmts", 0, 1, mark="E2:"), ngrams("stmts", 0, 1, 2, mark="E3:"), ngrams("stmts", 0, 2, mark="Es1b:"), twice, ngrams("types", 0, 1, 2, 3, mark="F4:"), "values")
    return rows, every


def bags_of(programs: DataFrame) -> DataFrame:
    """prog, feature and n of programs as arrays of nodes: a program is counted where it is, without a shuffle; each is as large as its text."""
    return counted(*_features(programs)).select("prog", F.col("item").alias("feature"), "n")


def feature_bags(nodes: DataFrame) -> DataFrame:
    """prog, feature and n of programs as rows of nodes."""
    return bags_of(streams(nodes))


@query(FEATURES + "select prog, sig, count(*) as n from sg group by all")
def statement_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each program has a statement of each signature."""
    sigs = parsed(order_programs(spark, sf_dir).select("prog", "code"), "sig")
    return counted(sigs, F.filter("sig", lambda x: x.isNotNull())).select("prog", F.col("item").alias("sig"), "n")


@query(FEATURES + "select prog, feature, n from fe")
def program_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags_of(parsed(order_programs(spark, sf_dir).select("prog", "code"), "type", "label", "const", "sig"))


@query(
    FEATURES
    + """, ow as (select o_orderkey as prog, o_custkey as owner, c_nationkey as problem, o_orderstatus = 'F' as accepted, o_orderdate as ts from orders join customer on c_custkey = o_custkey),
last as (select prog, owner, problem from ow where not accepted and prog % 16 <> 3 and prog in (select prog from fe) qualify row_number() over (partition by owner order by ts desc, prog desc) = 1),
pool as (select fe.*, owner, problem from fe join ow using (prog) where accepted),
pn as (select problem, count(distinct prog) as p from pool group by 1), w as (select problem, feature, ln((any_value(p) + 1.0) / (count(*) + 1.0)) + 1 as w from pool join pn using (problem) group by all),
al as (select x.prog, x.owner, x.problem, x.side, fe.feature, n, coalesce(w, 1.0) as w from (select *, 0 as side from last union all select prog, owner, problem, 1 from ow where accepted) x join fe using (prog) left join w on w.problem = x.problem and w.feature = fe.feature),
tt as (select prog, side, sum(n * w) as total from al group by all),
pp as (select a.prog as target, b.prog as ref, sum(least(a.n, b.n) * a.w) as num from al a join al b on a.side = 0 and b.side = 1 and a.problem = b.problem and a.feature = b.feature and a.owner <> b.owner group by all),
sc as (select target, ref, round(num / (x.total + y.total - num), 6) as sim from pp join tt x on x.prog = target and x.side = 0 join tt y on y.prog = ref and y.side = 1)
select target, ref, row_number() over (partition by target order by sim desc, ref) as rank, sim from sc qualify rank <= 20"""
)
def similar_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty accepted programs of other customers of its nation that are most similar to each customer's last program that isn't accepted.

    Equal texts are parsed once, and programs of equal features are a class: a nation's classes are what is weighed and searched, each with the programs that answers can name.
    """
    nations = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("group"))
    texts = stored(order_programs(spark, sf_dir).join(nations.hint("merge"), "owner").select("prog", "owner", "group", "accepted", "ts", F.unhex(F.sha2("code", 256)).alias("text"), "code"))
    nodes = parsed(texts.groupBy("text").agg(F.first("code").alias("code")), "type", "label", "const", "sig")
    bag = F.transform("counts", lambda x: F.struct(F.xxhash64(x["item"]).alias("token"), x["n"].alias("cnt")))
    bags = stored(counts(*_features(nodes)).select("text", bag.alias("bag"))).filter(F.size("bag") > 0).withColumn("class", F.xxhash64("bag"))  # a filter below would count anew at each place
    owned = stored(texts.drop("code").join(bags.select("text", "class").hint("merge"), "text").drop("text"))
    released(texts)
    latest = F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("ts"), F.desc("prog")))
    asked = owned.filter("not accepted").withColumn("k", latest).filter("k = 1").select(F.col("prog").alias("target"), "group", F.col("owner").alias("apart"), "class")
    pool = owned.filter("accepted")
    named, classes = _named(pool, SIMILAR), pool.groupBy("group", "class").agg(F.count("*").alias("n"))
    each = bags.groupBy("class").agg(F.first("bag").alias("bag")).hint("merge")  # tables that grow with the programs are never broadcast, however small they are when compressed
    sizes = classes.groupBy("group").agg(F.sum("n").alias("p"))
    df = classes.join(each, "class").select("group", "n", F.inline("bag")).groupBy("group", "token").agg(F.sum("n").alias("df")).join(sizes, "group")
    weights = df.select("group", "token", (F.ln((F.col("p") + 1) / (F.col("df") + 1)) + 1).alias("w"))
    wanted = classes.select("group", "class").union(asked.select("group", "class")).distinct().join(each, "class")
    weighted = wanted.select(F.col("class").alias("id"), "group", F.inline("bag")).join(weights.hint("merge"), ["group", "token"], "left").withColumn("w", F.coalesce("w", F.lit(1.0)))
    arrays = cut(as_arrays(weighted, "group")).withColumnRenamed("id", "class")
    released(bags)
    return nearest_classes(asked, arrays.join(asked.select("group", "class").distinct().hint("merge"), ["group", "class"]), arrays.join(named.hint("merge"), ["group", "class"]), SIMILAR)


def _named(pool: DataFrame, k: int) -> DataFrame:
    """group, class, refs and aparts: the first programs of a class that answers can name, so that there are k, or all, besides any one owner's."""
    own = F.row_number().over(Window.partitionBy("group", "class", "owner").orderBy("prog"))
    place = F.row_number().over(Window.partitionBy("group", "class").orderBy("prog"))
    first = pool.withColumn("own", own).filter(F.col("own") <= k).withColumn("place", place).filter(F.col("place") <= 2 * k)
    each = first.groupBy("group", "class").agg(F.array_sort(F.collect_list(F.struct("prog", "owner"))).alias("x"))
    return each.select("group", "class", F.col("x")["prog"].alias("refs"), F.col("x")["owner"].alias("aparts"))
