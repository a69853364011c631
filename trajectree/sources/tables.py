"""Scans: Parquet tables of a folder, and JSON-lines trajectories, tests and CSV metadata as Spark reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUBMISSIONS = "problem_id string, user_id string, submissions array<struct<sid: string, ts: bigint, verdict: string, code: string>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """One row per submission of <path>/<pid>/trajectories.jsonl, in order (seq); a malformed line is an error, as none may be lost unseen."""
    read = spark.read.schema(SUBMISSIONS).option("mode", "FAILFAST").json(f"{path}/*/trajectories.jsonl")
    return read.select("problem_id", "user_id", F.posexplode("submissions").alias("seq", "s")).select("problem_id", "user_id", "seq", "s.*")


def tests(spark: SparkSession, path: str) -> DataFrame:
    """Rows of <path>/<pid>/tests.jsonl with their problem and, within a file, their position as test_id."""
    lines = spark.read.text(f"{path}/*/tests.jsonl", wholetext=True).withColumn("pid", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))
    rows = lines.select("pid", F.posexplode(F.filter(F.split("value", "\n"), lambda x: F.length(x) > 0)).alias("test_id", "line"))
    return rows.select("pid", "test_id", F.from_json("line", "input string, output string").alias("t")).select("pid", "test_id", "t.*")


def time_limits(spark: SparkSession, path: str) -> DataFrame:
    """Seconds allowed per problem: from <path>/<pid>/meta.json (text or object; bad JSON counts as empty), 2 where it has none."""
    text = spark.read.text(f"{path}/*/meta.json", wholetext=True).withColumn("pid", F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1))
    return text.select("pid", (F.coalesce(F.get_json_object("value", "$.time_limit_ms").cast("double"), F.lit(2000.0)) / 1000).alias("seconds"))


def qualifying_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Accepted and wrong Python submissions of <path>/metadata/<pid>.csv: pid, sid, user_id, ts, status, and at, which follows the order of the file's rows."""
    kinds = "sid string, problem string, user_id string, ts bigint, language string, original string, filename string, status string"
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("at")
    read = spark.read.schema(kinds).csv(f"{path}/metadata/*.csv", header=True).withColumn("pid", F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv$", 1))
    return read.filter((F.col("language") == "Python") & F.col("status").isin("Accepted", "Wrong Answer")).select("pid", "sid", "user_id", "ts", "status", at)
