"""Connected components of a table of links, by alternating star contraction.

Links stay in Spark: each round re-points neighbours to the least node around, and is a table of the shared folder until the last is done. Only a count and a checksum of the
links come to the driver, to see whether anything changed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import scratch, stored


def forest(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least index that each of n local nodes reaches by the links; for what one task has at hand."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, left, label[right])
        np.minimum.at(label, right, label[left])
        label = label[label]
        if (label == before).all():
            return label


def _contracted(links: DataFrame, all_sides: bool) -> DataFrame:
    """Large star (all_sides: each node's larger neighbours go to the least of its neighbourhood) or small star (smaller ones and itself do)."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if all_sides else links
    least = stored(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")) if all_sides else both.groupBy("a").agg(F.min("b").alias("m")))
    if all_sides:
        moved = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = both.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return stored(moved.filter("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """Nodes with a link, each with the least node it reaches: node, root. links: columns a and b, integers, in any order and number."""
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    with scratch(links.sparkSession):
        links, seen = stored(links), None
        while True:
            state = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
            if state == seen or not state[0]:
                break
            seen = state
            links = _contracted(_contracted(links, True), False)
        stars = links.groupBy("a").agg(F.min("b").alias("root"))
        return stored(stars.select(F.col("a").alias("node"), "root").union(links.select("b", "b").distinct()), keep=True)
