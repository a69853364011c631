"""Folders of files as relations: what is there, which problems are whole, which inputs have outputs. Listings carry paths; contents are read only where asked for.

Files whose names begin with a dot or an underscore are hidden and files without a byte aren't there, as Spark's readers have it. A folder that isn't there is Spark's
error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Files that a whole problem has (fixed values).
REQUIRED = ("problem.html", "meta.json", "trajectories.jsonl", "tests.jsonl")
#: Contests by name and number, and their codes (fixed values).
CONTEST = r"AtCoder (Beginner|Regular|Grand) Contest (\d+)"
CONTEST_CODES = {"Beginner": "ABC", "Regular": "ARC", "Grand": "AGC"}


def files(spark: SparkSession, root: str, contents: bool = False) -> DataFrame:
    """parts (the path below root, by folder), name and, if asked for, text of every file under root."""
    bare = root.split("://", 1)[-1].removeprefix("file:").rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.element_at(F.split("path", rf"\Q{bare}/\E", 2), 2)
    return rows.select(F.split(below, "/").alias("parts"), *([decoded(F.col("content")).alias("text")] if contents else [])).withColumn("name", F.element_at("parts", -1))


def decoded(content: Column) -> Column:
    """Bytes as text: what isn't UTF-8 becomes U+FFFD, line ends become line feeds."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def problems(listing: DataFrame) -> DataFrame:
    """pid of every folder that has trajectories and tests."""
    names = listing.filter(F.size("parts") == 2).groupBy(F.col("parts")[0].alias("pid")).agg(F.collect_set("name").alias("names"))
    return names.filter(F.array_contains("names", "trajectories.jsonl") & F.array_contains("names", "tests.jsonl")).select("pid")


def missing_files(listing: DataFrame) -> DataFrame:
    """pid and name of the required files that a problem's folder lacks."""
    there = listing.filter(F.size("parts") == 2).select(F.col("parts")[0].alias("pid"), "name").distinct()
    wanted = there.select("pid").distinct().select("pid", F.explode(F.array(*map(F.lit, REQUIRED))).alias("name"))
    return wanted.join(there, ["pid", "name"], "left_anti")


def whole_problems(listing: DataFrame) -> DataFrame:
    """pid of every folder that lacks no required file."""
    return listing.filter(F.size("parts") == 2).select(F.col("parts")[0].alias("pid")).distinct().join(missing_files(listing), "pid", "left_anti")


def marked_ids(listing: DataFrame, mark: str = "p") -> DataFrame:
    """pid of the folders at the top whose names begin with a mark."""
    return listing.select(F.col("parts")[0].alias("pid")).filter((F.size("parts") > 1) & F.startswith("pid", F.lit(mark))).distinct()


def test_files(listing: DataFrame) -> DataFrame:
    """contest, letter, name, input and output (parts of their paths) of tests in <contest>/<letter>/in and out, or with inputs flat in <letter> where it has no folder ``in``."""
    of = [F.col("parts")[0].alias("contest"), F.col("parts")[1].alias("letter")]
    nested = listing.filter(F.size("parts") == 4).select(*of, F.col("parts")[2].alias("side"), "name", "parts")
    flat = listing.filter(F.size("parts") == 3).select(*of, "name", F.col("parts").alias("input"))
    inside = nested.filter("side = 'in'").select("contest", "letter", "name", F.col("parts").alias("input"))
    inputs = inside.union(flat.join(inside.select("contest", "letter").distinct(), ["contest", "letter"], "left_anti"))
    return inputs.join(nested.filter("side = 'out'").select("contest", "letter", "name", F.col("parts").alias("output")), ["contest", "letter", "name"])


def first_filled(tasks: DataFrame, tests: DataFrame) -> DataFrame:
    """Tests (pid and the columns of tests) of tasks (pid, code, letter): those of the folder named by the code or, if it has none, by the code in small letters."""
    codes = F.posexplode(F.array("code", F.lower("code"))).alias("choice", "contest")
    met = tasks.select("pid", "letter", codes).join(tests, ["contest", "letter"])
    return met.withColumn("best", F.min("choice").over(Window.partitionBy("pid"))).filter("choice = best").drop("choice", "best").distinct()


def listed_problems(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """pid and title of the rows of a problem list whose third column names the dataset; rows of fewer columns go."""
    rows = spark.read.option("header", "true").option("mode", "PERMISSIVE").schema("pid string, title string, dataset string").csv(path, enforceSchema=True)
    return rows.filter(F.col("dataset") == dataset).select("pid", "title")


def tasks(listed: DataFrame, special: dict[str, str]) -> DataFrame:
    """pid, code and letter: a contest's code by its special name or by kind and number; letters follow the order of ids, from A on without an end."""
    names = F.create_map(*(F.lit(x) for pair in special.items() for x in pair)) if special else F.create_map().cast("map<string,string>")
    kinds = F.create_map(*(F.lit(x) for pair in CONTEST_CODES.items() for x in pair))
    number = F.regexp_extract("title", CONTEST, 2)
    padded = F.lpad(number.cast("long").cast("string"), F.greatest(F.lit(3), F.length(number.cast("long").cast("string"))), F.lit("0"))
    regular = F.when(number != "", F.concat(F.try_element_at(kinds, F.regexp_extract("title", CONTEST, 1)), padded))
    coded = listed.select("pid", F.coalesce(F.try_element_at(names, F.split("title", " - ")[0]), regular).alias("code")).filter("code is not null")
    return coded.withColumn("letter", F.char((F.lit(64) + F.row_number().over(Window.partitionBy("code").orderBy("pid"))).cast("long")))
