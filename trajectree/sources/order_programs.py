"""Programs of many forms made from orders: a statement for each line of an order, chosen by its part and filled from its numbers; a customer's orders are a history.

Some orders end in a line that no parser takes, so readers meet unparsable programs as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.sources.tables import table

#: Statements by part number modulo their count; {a} is the quantity and {b} the number of the line (fixed values).
FRAGMENTS = (
    "n = int(input())",
    "for i in range({a}):\n    if i % 2 == 0:\n        print(i)",
    "from math import gcd as g{b}",
    "n, m = m, n",
    "total += {a}",
    "def f(x, y={a}):\n    return x + y",
    "with open('') as s:\n    t = s.read()",
    "del x[{b}]",
    "flag = not True or None is n",
    "print('yes' if n > {a} else '', 1.5)",
)
#: The end of a broken program, and the orders that have it: their number modulo 16 is 3.
BROKEN = "if :"


def _filled(line: DataFrame) -> Column:
    texts = F.array(*map(F.lit, FRAGMENTS))[(F.col("l_partkey") % len(FRAGMENTS)).cast("int")]
    return F.replace(F.replace(texts, F.lit("{a}"), F.col("l_quantity").cast("int").cast("string")), F.lit("{b}"), F.col("l_linenumber").cast("string"))


def order_programs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """prog (the order), owner (the customer), ts, accepted and code."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    stmts = lines.select("l_orderkey", F.struct("l_linenumber", _filled(lines).alias("stmt")).alias("s")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("prog"), F.col("o_custkey").alias("owner"), F.col("o_orderdate").alias("ts"), (F.col("o_orderstatus") == "F").alias("accepted")
    )
    joined = orders.join(stmts, orders["prog"] == stmts["l_orderkey"])
    code = F.array_join(F.col("s")["stmt"], "\n")
    return joined.select("prog", "owner", "ts", "accepted", F.when(F.pmod("prog", F.lit(16)) == 3, F.concat(code, F.lit("\n" + BROKEN))).otherwise(code).alias("code"))
