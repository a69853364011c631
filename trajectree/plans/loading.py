"""Problems as a run loads them: statement as text, seconds allowed, tests, and each user's wrong programs and accepted one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.functions.text import plain
from trajectree.sources import catalogue

#: Milliseconds allowed where a problem's meta data name none, and characters of a statement that are kept (fixed values).
LIMIT_MS, STATEMENT = 2000, 1200


def problems(spark: SparkSession, path: str, without: float = 2.0, cap: float | None = None) -> DataFrame:
    """pid, statement (text, empty if there is none) and seconds of every problem with trajectories and tests.

    Seconds come from meta.json (bad JSON counts as empty), or are ``without`` where it has no such file; none exceed ``cap``.
    """
    files = catalogue.files(spark, path, contents=True).filter(F.size("parts") == 2).select(F.col("parts")[0].alias("pid"), "name", "text")
    text_of = lambda name: F.max(F.when(F.col("name") == name, F.col("text")))
    has = lambda name: F.max(F.col("name") == name)
    each = files.groupBy("pid").agg(text_of("problem.html").alias("html"), text_of("meta.json").alias("meta"), has("trajectories.jsonl").alias("a"), has("tests.jsonl").alias("b")).filter("a and b")
    named = F.coalesce(F.get_json_object("meta", "$.time_limit_ms").cast("double"), F.lit(float(LIMIT_MS))) / 1000
    seconds = F.when(F.col("meta").isNull(), F.lit(float(without))).otherwise(named)
    capped = seconds if cap is None else F.least(seconds, F.lit(float(cap)))
    return each.select("pid", plain(F.coalesce("html", F.lit("")), STATEMENT).alias("statement"), capped.alias("seconds"))


def by_verdict(submissions: DataFrame) -> DataFrame:
    """problem_id, user_id, wrong (codes in order) and accepted (the last accepted code, null if none) from rows in order (seq, verdict, code)."""
    ok = F.col("verdict") == "Accepted"
    wrong = F.array_sort(F.collect_list(F.when(~ok, F.struct("seq", "code"))))
    return submissions.groupBy("problem_id", "user_id").agg(F.transform(wrong, lambda s: s["code"]).alias("wrong"), F.max_by(F.when(ok, F.col("code")), F.when(ok, F.col("seq"))).alias("accepted"))
