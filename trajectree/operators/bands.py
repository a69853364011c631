"""Band joins: rows of equal keys whose sizes are within a factor of each other."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.operators.matching import consecutive, with_trees
from trajectree.operators.outlines import ORDER_NODES, STATEMENT_KINDS
from trajectree.registry import query

#: Least and greatest ratio of the sizes of a statement's candidate and of the statement (fixed values).
LOW, HIGH = 0.5, 2.0
#: Rows of one key and bin that meet the other side in one piece.
ROWS = 4096


def band_join(left: DataFrame, right: DataFrame, on: list[str], low: float = LOW, high: float = HIGH) -> DataFrame:
    """on, and the other columns of both, of all pairs with right_size between low and high times left_size; left has left_size, right has right_size, both positive.

    Sizes are binned by powers of two, so a row meets its own bin and its neighbours as far as the ratios reach, and nothing else. The left rows of a key and bin are
    dealt into pieces of about :data:`ROWS`, each of which meets the right rows in a task of its own, so no key is too large.
    """
    bin_of = lambda c: F.floor(F.log2(c)).cast("int")
    mine = left.withColumn("_bin", bin_of("left_size"))
    pieces = mine.groupBy(*on, "_bin").agg(F.ceil(F.count("*") / ROWS).cast("int").alias("_pieces"))
    rest = [c for c in left.columns if c not in on]
    mine = mine.join(pieces, [*on, "_bin"]).withColumn("_piece", F.pmod(F.xxhash64(*rest), "_pieces").cast("int")).drop("_pieces")
    first, last = -math.ceil(math.log2(high)), math.ceil(-math.log2(low))
    theirs = right.withColumn("_bin", F.explode(F.transform(F.lit(list(range(first, last + 1))), lambda k: bin_of("right_size") + k)))
    theirs = theirs.join(pieces, [*on, "_bin"]).withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1))).drop("_pieces")
    met = mine.join(theirs, [*on, "_bin", "_piece"])
    return met.filter(F.col("right_size").between(low * F.col("left_size"), high * F.col("left_size"))).drop("_bin", "_piece")


@query(f"""with {ORDER_NODES}, pr as (select prog, lead(prog) over (partition by owner order by ts, prog) as ref from on_ where node = 0 qualify ref is not null)
select pr.prog, pr.ref, a.node, b.node as ref_node, a.walk as size, b.walk as ref_size from pr join on_ a on a.prog = pr.prog join on_ b on b.prog = pr.ref and a.type = b.type
where a.type in ({STATEMENT_KINDS}) and b.walk between 0.5 * a.walk and 2.0 * a.walk""")
def statement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each statement of a program, the statements of the customer's next one of its type and about its size."""

    def of(a: list[tuple], b: list[tuple]) -> tuple:
        return [[(n[0], n[3], n[14]) for n in side if n[10]] for side in (a, b)]  # node, type and walk

    stmt = "array<struct<node: int, type: string, size: bigint>>"
    pairs = with_trees(consecutive(spark, sf_dir), "code", "ref_code", f"mine {stmt}, theirs {stmt}", of)
    fits = lambda m, t: (m["type"] == t["type"]) & t["size"].between(LOW * m["size"], HIGH * m["size"])
    # A program is as large as its text, so its statements meet the other's in the pair's row.
    rows = pairs.select("prog", "ref", "theirs", F.explode("mine").alias("m")).select("prog", "ref", "m", F.explode("theirs").alias("t")).filter(fits(F.col("m"), F.col("t")))
    return rows.select("prog", "ref", F.col("m.node").alias("node"), F.col("t.node").alias("ref_node"), F.col("m.size").alias("size"), F.col("t.size").alias("ref_size"))
