"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of a-z of the lower-cased text, in order."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda x: x != "")


def ngrams(stream: str | Column, *ahead: int, mark: str = "", sep: str = "/") -> Column:
    """For each place of an array that has all of them, the elements so many places ahead, joined."""
    places = F.when(F.size(stream) > max(ahead), F.sequence(F.lit(0), F.size(stream) - 1 - max(ahead))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda at: F.concat(F.lit(mark), F.concat_ws(sep, *(F.get(stream, at + k) for k in ahead))))


def _runs(rows: DataFrame, items: Column) -> tuple[DataFrame, Column]:
    """rows' key with the sorted array, and its runs of equal items: item and n, how often it has it. Equal items lie together once the array is sorted, so no row is shuffled."""
    sorted_ = rows.select(rows.columns[0], F.sort_array(items).alias("_items"))
    last = lambda at: (at == F.size("_items") - 1) | ~F.get("_items", at).eqNullSafe(F.get("_items", at + 1))
    ends = F.when(F.size("_items") > 0, F.filter(F.sequence(F.lit(0), F.size("_items") - 1), last)).otherwise(F.array().cast("array<int>"))
    run = lambda end, k: F.struct(F.get("_items", end).alias("item"), (end - F.when(k > 0, F.get("_ends", k - 1)).otherwise(-1)).cast("long").alias("n"))
    return sorted_.withColumn("_ends", ends), F.transform("_ends", run)


def counts(rows: DataFrame, items: Column) -> DataFrame:
    """rows' key (first column) and counts, an array of each different item of its array and n. A filter on it would be moved below and count anew at each place: store it first."""
    ends, runs = _runs(rows, items)
    return ends.select(rows.columns[0], runs.alias("counts"))


def counted(rows: DataFrame, items: Column) -> DataFrame:
    """rows' key (first column), each different item of its array and n."""
    ends, runs = _runs(rows, items)
    return ends.select(rows.columns[0], F.inline(runs))


def plain(html: Column, most: int | None = None) -> Column:
    """Tags become spaces, white space is folded and trimmed; the first ``most`` characters, if given."""
    out = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), r"\s+", " "))
    return out if most is None else F.substring(out, 1, most)


def normalized_output(text: Column) -> Column:
    """White space folded and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normalized_code(code: Column) -> Column:
    """Imports and calls of fractions.gcd become math.gcd."""
    return F.regexp_replace(F.replace(code, F.lit("from fractions import gcd"), F.lit("from math import gcd")), r"\bfractions\.gcd\b", "math.gcd")
