"""Variants of an experiment over the same targets: one scan expands into all of them, outcomes are paired by user with the full variant, and rolled up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.registry import query
from trajectree.sources.tables import table

#: Options of a variant and what they are in the full one; the variants differ in what is named (fixed values).
DEFAULTS = {"reformat": "true", "standardize": "true", "ref": "similar", "sketch": "was", "repair": "guided"}
VARIANTS = {
    "full": {}, "no-reformat": {"reformat": "false"}, "no-standardize": {"standardize": "false"}, "ref-random": {"ref": "random"}, "ref-oracle": {"ref": "oracle"}, "wan-ac": {"sketch": "wan+ac"},
    "was-only": {"sketch": "was", "ref": "none"}, "plain": {"repair": "plain"},
}
FULL = "full"


def first_targets(targets: DataFrame, n: int, *order: str) -> DataFrame:
    """The first n targets of each pid, the same for every variant."""
    return targets.withColumn("_k", F.row_number().over(Window.partitionBy("pid").orderBy(*order))).filter(F.col("_k") <= n).drop("_k")


def expanded(targets: DataFrame) -> DataFrame:
    """Each target once for every variant, with the variant's name and options; the targets are read once."""
    options = [F.struct(F.lit(name).alias("variant"), *(F.lit((DEFAULTS | given)[o]).alias(o) for o in DEFAULTS)) for name, given in VARIANTS.items()]
    return targets.select("*", F.inline(F.array(*options)))


def outcomes(targets: DataFrame, passed: Callable[[], Column], edit: Callable[[], Column]) -> DataFrame:
    """pid, user_id, variant, passed and edit (of passed ones) for all variants; passed and edit are columns of a target and its options."""
    return expanded(targets).select("pid", "user_id", "variant", passed().alias("passed"), F.when(passed(), edit()).alias("edit"))


def paired(results: DataFrame) -> DataFrame:
    """results with won and lost: what the variant repairs and the full one doesn't, and the reverse, for the same user."""
    user = Window.partitionBy("pid", "user_id")
    full = F.max(F.when(F.col("variant") == FULL, F.col("passed"))).over(user)
    return results.withColumn("won", F.col("passed") & ~full).withColumn("lost", ~F.col("passed") & full)


def matrix(results: DataFrame, *by: str) -> DataFrame:
    """by and variant, n, n_passed, rate, edit_mean (0 if none passed), n_won, n_lost and delta (the rate less the full one's on the same targets)."""
    mean = F.coalesce(F.avg("edit"), F.lit(0.0))
    rows = paired(results).groupBy(*by, "variant").agg(F.count("*").alias("n"), F.count_if("passed").alias("n_passed"), F.round(mean, 6).alias("edit_mean"), F.count_if("won").alias("n_won"), F.count_if("lost").alias("n_lost"))
    return rows.withColumn("rate", F.round(F.col("n_passed") / F.col("n"), 6)).withColumn("delta", F.round((F.col("n_won") - F.col("n_lost")) / F.col("n"), 6))


def tags(results: DataFrame) -> DataFrame:
    """tag and n, users by what their variants come to against the full one: both, neither, only_full, only_variant."""
    rows = paired(results).filter(F.col("variant") != FULL)
    tag = F.when(F.col("won"), "only_variant").when(F.col("lost"), "only_full").when(F.col("passed"), "both").otherwise("neither")
    return rows.groupBy("variant", tag.alias("tag")).agg(F.count("*").alias("n"))


#: Targets of a problem that are tried.
FIRST = 50
_OUTCOMES = f"""with v as (select unnest(['full', 'no-reformat', 'no-standardize', 'ref-random', 'ref-oracle', 'wan-ac', 'was-only', 'plain']) as variant),
o as (select variant, case variant when 'no-reformat' then 'false' else 'true' end as reformat, case variant when 'no-standardize' then 'false' else 'true' end as standardize,
  case variant when 'ref-random' then 'random' when 'ref-oracle' then 'oracle' when 'was-only' then 'none' else 'similar' end as ref, case variant when 'wan-ac' then 'wan+ac' else 'was' end as sketch, case variant when 'plain' then 'plain' else 'guided' end as repair from v),
t as (select l_suppkey as pid, l_orderkey as user_id, sum(l_quantity)::bigint as effort, count(*) as size from lineitem group by all),
f as (select * from t qualify row_number() over (partition by pid order by user_id) <= {FIRST}),
r as (select pid, user_id, variant, (effort + length(ref) + 2 * (reformat = 'false')::int + 3 * (standardize = 'false')::int + length(sketch)) % 7 < case repair when 'plain' then 2 else 4 end as passed, size from f, o),
p as (select *, case when passed then size end as edit, max(case when variant = 'full' then passed::int end) over (partition by pid, user_id) = 1 as whole from r)
"""


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes of all variants for the first targets of each supplier: an order's lines of it are a target, whose numbers and the variant's options decide."""
    targets = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("pid"), F.col("l_orderkey").alias("user_id")).agg(F.sum("l_quantity").cast("long").alias("effort"), F.count("*").alias("size"))
    off = lambda c: (F.col(c) == "false").cast("int")
    cost = F.col("effort") + F.length("ref") + 2 * off("reformat") + 3 * off("standardize") + F.length("sketch")
    passed = lambda: cost % 7 < F.when(F.col("repair") == "plain", 2).otherwise(4)
    return outcomes(first_targets(targets, FIRST, "user_id"), passed, lambda: F.col("size"))


@query(
    _OUTCOMES
    + """select variant, count(*) as n, count(case when passed then 1 end) as n_passed, round(count(case when passed then 1 end) / count(*), 6) as rate, round(coalesce(avg(edit), 0), 6) as edit_mean,
count(case when passed and not whole then 1 end) as n_won, count(case when not passed and whole then 1 end) as n_lost,
round((count(case when passed and not whole then 1 end) - count(case when not passed and whole then 1 end)) / count(*), 6) as delta from p group by 1"""
)
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each variant over the same targets: rate, mean edit, and what it wins and loses against the full one."""
    return matrix(_results(spark, sf_dir))


@query(_OUTCOMES + "select variant, case when passed and not whole then 'only_variant' when not passed and whole then 'only_full' when passed then 'both' else 'neither' end as tag, count(*) as n from p where variant <> 'full' group by all")
def paired_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tags(_results(spark, sf_dir))
