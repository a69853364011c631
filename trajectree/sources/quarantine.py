"""One scan, two outputs: rows that are good, and rows set aside with what is wrong with them. Nothing is lost and nothing ends the run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.operators.trees import flattened
from trajectree.sources.shared import cut
from trajectree.sources.tables import SUBMISSIONS

#: What can be wrong, first found first (fixed values).
BAD_LINE, NO_SUBMISSIONS, NO_SOURCE, UNPARSABLE = "bad_line", "no_submissions", "missing_source", "unparsable"


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """pid (the folder), the columns of trajectories, the line where it is malformed, and status: null for a good row.

    A trajectory is good if its line can be read, it has submissions, and each has its source; its last wrong source must be a program.
    """
    kinds = f"{SUBMISSIONS}, _corrupt_record string"
    rows = spark.read.schema(kinds).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(f"{path}/*/trajectories.jsonl")
    rows = cut(rows.select(F.regexp_extract("_metadata.file_path", "([^/]+)/[^/]+$", 1).alias("pid"), "problem_id", "user_id", "submissions", F.col("_corrupt_record").alias("line"), F.monotonically_increasing_id().alias("row")))
    wrong = F.filter("submissions", lambda s: s["verdict"] != "Accepted")
    last = F.try_element_at(wrong["code"], F.lit(-1))
    parsed = flattened(rows.filter("line is null").select("row", last.alias("code")).filter("code is not null")).filter("parent < 0").select("row", F.lit(True).alias("parsed"))
    status = (
        F.when(F.col("line").isNotNull() | F.col("user_id").isNull(), BAD_LINE)
        .when(F.coalesce(F.size("submissions"), F.lit(0)) <= 0, NO_SUBMISSIONS)
        .when(F.exists("submissions", lambda s: s["code"].isNull()), NO_SOURCE)
        .when(F.size(wrong) > 0, F.when(F.col("parsed").isNull(), UNPARSABLE))
    )
    return rows.join(parsed, "row", "left").select("pid", "problem_id", "user_id", "submissions", "line", status.alias("status"))


def split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows, and those set aside; rows as :func:`scanned` gives them, read once."""
    rows = cut(rows)
    return rows.filter("status is null").drop("line", "status"), rows.filter("status is not null")


def counts(aside: DataFrame) -> DataFrame:
    """pid, status and n."""
    return aside.groupBy("pid", "status").agg(F.count("*").alias("n"))
