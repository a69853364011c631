"""The dataset from files to files: problem list, metadata, sources, tests and statements become trajectories, tests, statements and a summary, in one plan each.

Layout read, below one root: metadata/problem_list.csv, metadata/<pid>.csv, data/<pid>/Python/<sid>.py, test_cases/<contest>/<letter>/..., problem_descriptions/<pid>.html,
and a folder of benchmark problems, one folder each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.plans.dataset import build_trajectories
from trajectree.sources import catalogue, tables
from trajectree.sources.shared import cut


@dataclass(frozen=True)
class Dataset:
    trajectories: DataFrame  # pid, user_id, submissions
    tests: DataFrame  # pid, name, input, output
    statements: DataFrame  # pid, html
    summary: DataFrame  # problems, trajectories, submissions, fewest, median, most


def from_files(spark: SparkSession, root: str, benchmark: str, special: dict[str, str], dataset: str = "AtCoder", least_wrong: int = 2, least_trajectories: int = 2) -> Dataset:
    """Problems of the list that are in the benchmark and have tests and enough whole trajectories."""
    chosen = catalogue.marked_ids(catalogue.files(spark, f"{root}/{benchmark}"))
    listed = catalogue.listed_problems(spark, f"{root}/metadata/problem_list.csv", dataset).join(chosen, "pid", "left_semi")
    tested = cut(catalogue.first_filled(catalogue.tasks(listed, special), catalogue.test_files(catalogue.files(spark, f"{root}/test_cases"))))
    submissions = tables.qualifying_metadata(spark, root).withColumnRenamed("status", "verdict").join(tested.select("pid").distinct(), "pid", "left_semi")
    parts = F.col("parts")
    code = catalogue.files(spark, f"{root}/data", contents=True).filter((F.size(parts) == 3) & (parts[1] == "Python") & F.endswith("name", F.lit(".py")))
    sources = code.select(parts[0].alias("pid"), F.regexp_replace("name", r"\.py$", "").alias("sid"), F.col("text").alias("code"))
    trajectories = cut(build_trajectories(submissions, sources, least_wrong, least_trajectories, tie="at"))
    kept = trajectories.select("pid").distinct()
    texts = catalogue.files(spark, f"{root}/test_cases", contents=True)
    side = lambda name: texts.select(F.col("parts").alias(name), F.col("text").alias(f"{name}_text"))
    tests = tested.join(kept, "pid", "left_semi").join(side("input"), "input").join(side("output"), "output")
    pages = catalogue.files(spark, f"{root}/problem_descriptions", contents=True).select(F.regexp_replace("name", r"\.html$", "").alias("pid"), F.col("text").alias("html"))
    sizes = trajectories.groupBy("pid").agg(F.count("*").alias("n"), F.sum(F.size("submissions")).alias("m")).agg(F.array_sort(F.collect_list("n")).alias("s"), F.sum("m").alias("m"))  # one number a problem
    total = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x)
    summary = sizes.select(F.size("s").alias("problems"), total.alias("trajectories"), F.coalesce("m", F.lit(0)).alias("submissions"), *(F.coalesce(x, F.lit(0)).alias(n) for n, x in (("fewest", F.get("s", F.lit(0))), ("median", F.get("s", (F.size("s") / 2).cast("int"))), ("most", F.get("s", F.size("s") - 1)))))
    statements = kept.join(pages, "pid", "left").select("pid", F.coalesce("html", F.lit("")).alias("html"))
    return Dataset(trajectories, tests.select("pid", "name", F.col("input_text").alias("input"), F.col("output_text").alias("output")), statements, summary)


def write(data: Dataset, path: str) -> None:
    """Trajectories, tests (in the order of names) and statements by problem, and the summary as text, under a path."""
    data.trajectories.withColumn("problem_id", F.col("pid")).repartition("pid").write.mode("overwrite").partitionBy("pid").json(f"{path}/trajectories")
    data.tests.repartition("pid").sortWithinPartitions("pid", "name").drop("name").write.mode("overwrite").partitionBy("pid").json(f"{path}/tests")
    data.statements.repartition("pid").write.mode("overwrite").partitionBy("pid").json(f"{path}/statements")  # text would end in one line feed more
    row = F.format_string("| problems | %d |\n| trajectories | %d |\n| submissions | %d |\n| trajectories per problem (min/median/max) | %d / %d / %d |", *data.summary.columns)
    data.summary.select(F.concat(F.lit("# Dataset\n\n| metric | value |\n|---|---|\n"), row)).write.mode("overwrite").text(f"{path}/summary")
