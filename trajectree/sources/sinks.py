"""Sinks: partitioned JSON lines, result files, and a summary table that is updated by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.operators.sets import upsert


def write_trajectories(rows: DataFrame, path: str) -> None:
    """Trajectories (pid, user_id, submissions) as JSON lines, a folder for each problem."""
    rows.write.mode("overwrite").partitionBy("pid").json(path)


def write_results(rows: DataFrame, path: str) -> None:
    """Results as CSV with a header; nulls are blank."""
    rows.write.mode("overwrite").csv(path, header=True, nullValue="")


def update_summary(old: DataFrame | None, new: DataFrame, path: str, *keys: str) -> None:
    """Write the summary with new rows in place of old ones of the same keys, numbers with six decimals, to a fresh path."""
    rows = new if old is None else upsert(old, new, *keys)
    numbers = {c: F.format_string("%.6f", F.col(c)) for c, kind in rows.dtypes if kind == "double"}
    rows.withColumns(numbers).write.csv(path, header=True)


def report(results: DataFrame) -> DataFrame:
    """A line for each problem in order of pid, then one for all (line, place); results: pid, status (pass, fail or skip), and ted and ip of those passed.

    Rates leave skipped ones out; the last line has the rate over all and the mean of the problems' rates.
    """
    number = lambda status: F.count_if(F.col("status") == status)
    mean = lambda c: F.coalesce(F.avg(F.when(F.col("status") == "pass", F.col(c))), F.lit(0.0)).alias(c)
    sums = lambda c: F.sum(F.when(F.col("status") == "pass", F.col(c))).alias(f"{c}_sum")
    each = results.groupBy("pid").agg((F.count("*") - number("skip")).alias("n"), number("pass").alias("passed"), number("skip").alias("skipped"), mean("ted"), mean("ip"), sums("ted"), sums("ip"))
    rate = F.col("passed") / F.greatest("n", F.lit(1))
    lines = each.select(F.format_string("%-8s RR=%5.1f%% (%d/%d) skip=%d | TED=%6.1f IP mean=%+.2f", "pid", 100 * rate, "passed", "n", "skipped", "ted", "ip").alias("line"), F.struct(F.lit(0).alias("last"), "pid").alias("place"))
    whole = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("passed"), F.lit(0)).alias("passed"), F.count("*").alias("problems"), F.coalesce(F.avg(rate), F.lit(0.0)).alias("macro"), *(F.coalesce(F.sum(f"{c}_sum"), F.lit(0.0)).alias(c) for c in ("ted", "ip")))
    over = lambda c: F.col(c) / F.greatest("passed", F.lit(1))
    text = F.format_string("=== OVERALL: micro-RR=%.1f%% (%d/%d) macro-RR=%.1f%% over %d problems | TED=%.1f IP mean=%+.2f ===", 100 * rate, "passed", "n", 100 * F.col("macro"), "problems", over("ted"), over("ip"))
    return lines.union(whole.select(text, F.struct(F.lit(1), F.lit("").alias("pid"))))


def append_report(results: DataFrame, path: str) -> None:
    """Add the report's lines to the text files at a path, in order."""
    report(results).repartitionByRange(1, "place").sortWithinPartitions("place").select("line").write.mode("append").text(path)
