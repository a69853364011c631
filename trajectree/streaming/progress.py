"""Live progress: results that come in are logged batch by batch, in order of completion, with the totals so far, the rate, and the seconds left at that rate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

LINES = "batch long, done long, passed long, skipped long, seconds double, rate double, left double"


def log(spark: SparkSession, path: str) -> DataFrame:
    """The log's lines, one for each batch; order by batch. A batch that was logged twice, after a failure, is one line."""
    return spark.read.schema(LINES).parquet(f"{path}/batch=*")


def logged(results: DataFrame, path: str, total: int, clock: Callable[[], float]) -> DataStreamWriter:
    """A writer of a stream of results (status: pass, fail or skip): each batch adds a line with done, passed and skipped so far, the rate and the seconds left.

    clock gives the seconds since the run began. Each batch writes its own folder, so repeating it replaces its line.
    """

    def add(rows: DataFrame, batch: int) -> None:
        spark, here = rows.sparkSession, f"{path}/batch={batch:09d}"
        number = lambda status: F.count_if(F.col("status") == status)
        now = rows.agg(F.count("*").alias("done"), number("pass").alias("passed"), number("skip").alias("skipped"))
        if batch:
            before = spark.read.schema(LINES).parquet(f"{path}/batch={batch - 1:09d}").select("done", "passed", "skipped")
            now = now.union(before).agg(*(F.sum(c).alias(c) for c in now.columns))
        seconds = F.lit(float(clock()))
        rate = F.try_divide(F.col("done"), seconds)
        line = now.select(F.lit(batch).cast("long").alias("batch"), *now.columns, seconds.alias("seconds"), rate.alias("rate"), F.try_divide(F.lit(total) - F.col("done"), rate).alias("left"))
        line.coalesce(1).write.mode("overwrite").parquet(here)

    return results.writeStream.foreachBatch(add)
