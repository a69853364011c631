"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: For each open :func:`scratch`, the outermost first, the folders of the tables that end with it.
_SCRATCH: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A parquet table of the data folder; any path that Spark's readers can open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a temporary one where it is unset, in local runs only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: it is computed once, and survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def spaced(text: Column) -> Column:
    """A text with a space for each other blank."""
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return text


def fast_words(text: Column) -> Column:
    """As :func:`words` for a text that isn't null, split at spaces without a pattern, which Spark does many times faster."""
    return F.array_remove(F.split(spaced(text), " "), "")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    """``df`` with its 0-based rank in ``order``: a range sort, and a count of rows before each partition.

    Only one row per partition is gathered. Rows equal in ``order`` get ranks in no fixed order.
    """
    at = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = {r["_part"]: r["n"] for r in at.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).collect()}
    before, total = {}, 0
    for p in sorted(counts):
        before[p], total = total, total + counts[p]
    if not before:
        return at.withColumn(name, F.lit(0).cast("long")).drop("_at")
    starts = at.sparkSession.createDataFrame(sorted(before.items()), "_part long, _before long")
    return (
        at.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_before", "_at")
    )


def stored(df: DataFrame, keep: bool = False) -> DataFrame:
    """As :func:`cut`, by a Parquet table: smaller, read by column, and deleted with the :func:`scratch` around it (keep: with the one around that)."""
    path, level = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}", len(_SCRATCH) - 1 - keep
    if level >= 0:
        _SCRATCH[level].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are deleted at the end, but for those to keep; so are shuffle files that nobody holds."""
    _SCRATCH.append([])
    try:
        yield
    finally:
        _deleted(spark, *_SCRATCH.pop())


def _deleted(spark: SparkSession, *folders: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in map(jvm.org.apache.hadoop.fs.Path, folders):
        folder.getFileSystem(conf).delete(folder, True)
    gc.collect()
    jvm.System.gc()


def released(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete tables of :func:`stored` that nothing reads any more, and let Spark delete the shuffle files of plans that nobody holds."""
    _deleted(spark, *(files[0].rpartition("/")[0] for t in tables if (files := t.inputFiles())))
