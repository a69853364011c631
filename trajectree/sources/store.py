"""A store of results by problem that a run can be stopped and resumed on: rows by partition, and a manifest of the problems that are finished.

A problem counts as finished when its line is in the manifest, which is written after its rows. Rows of a problem that a stopped run left are replaced whole when it is
done again, so no row is there twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.sources.shared import cut


def _read(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    try:
        return spark.read.schema(kinds).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kinds)


def finished(spark: SparkSession, path: str) -> DataFrame:
    """pid of the problems that are done."""
    return _read(spark, f"{path}/manifest", "pid string").distinct()


def pending(problems: DataFrame, path: str) -> DataFrame:
    """The rows of problems that are still to do."""
    return problems.join(finished(problems.sparkSession, path), "pid", "left_anti")


def save(rows: DataFrame, done: DataFrame, path: str) -> None:
    """Rows in place of those of the same problems, then the manifest lines of the problems done, also of those without rows."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("pid").parquet(f"{path}/rows")
    done.select("pid").distinct().write.mode("append").parquet(f"{path}/manifest")


def results(spark: SparkSession, path: str, kinds: str) -> DataFrame:
    """The rows of all finished problems; kinds: their columns, pid among them."""
    rows = _read(spark, f"{path}/rows", kinds)
    return rows.join(finished(spark, path), "pid", "left_semi").select(*rows.columns)


def run(problems: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, batches: int = 8, reset: bool = False) -> None:
    """Do all problems (rows with pid) that aren't finished, in batches by hash, each saved before the next; with reset, finished ones too."""
    for batch in range(batches):
        part = problems.filter(F.pmod(F.xxhash64("pid"), F.lit(batches)) == batch)
        part = part if reset else pending(part, path)
        if not part.isEmpty():
            part = cut(part)  # read before the manifest grows
            save(work(part), part, path)


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The table at path, made and written first if it isn't there; half-written ones are replaced."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    mark = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not mark.getFileSystem(conf).exists(mark):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
