"""Hard-negative mining: exact integer scores of anchors against all rows, in a residue number system, then selection by score windows.

Anchors and rows meet in units of bounded size, a block of anchors and a block of rows each; every row goes to as many units as there are blocks of anchors, and
every anchor to as many as there are blocks of rows. A unit multiplies its blocks modulo small primes in float32 and restores the signed scores exactly
(:mod:`trajectree.llm.residues`). The first pass keeps each anchor's best rows of its own label, the second, in the windows that these positives give, the
best rows of other labels; a unit gives only what can be among the first, so what units give is merged by rank.

Defined results: rows with a null vec_id or label, a null vector, or a null or non-finite component take no part; vectors of different lengths never meet; an
anchor that is repeated counts once, any other repeated row as often as it stands; rows with an anchor's own vec_id are never its positives; equal scores go by
vec_id; an anchor without other rows of its label has no rows, nor has a positive without a negative in its window; scores of 2^56 or more in magnitude would
not fit the arithmetic and raise an error; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectree.llm.common import cut
from trajectree.llm.residues import products

POSITIVES, NEGATIVES = 5, 10
#: A negative's score, in hundredths of the positive's.
LOW, HIGH = 30, 90
#: Anchors in a block, and components of a block of rows; rows whose scores are held at once.
ANCHORS, COMPONENTS, CHUNK = 1024, 1 << 20, 2048
LARGEST = 1 << 56


def quantized(vectors: DataFrame) -> DataFrame:
    """vec_id, label, vector and reach (no component's magnitude, scaled, exceeds it) of the rows that take part; components become floor(256 * x), and the label of every seventh id is the next one."""
    label = F.col("label").cast("long")
    scaled = F.transform("embedding", lambda x: x.cast("double") * 256)
    finite = F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.transform(scaled, lambda x: F.floor(x)).alias("vector"), F.aggregate(scaled, F.lit(0.0), lambda t, x: t + (F.abs(x) + 1) * (F.abs(x) + 1)).alias("reach"),
    )


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy().reshape(len(flat), -1)


def first(scores: np.ndarray, allowed: np.ndarray, n: int, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the n highest allowed scores of each row, earlier columns first among equal ones; in no order."""
    width = scores.shape[1]
    if bound * width < 1 << 62:  # score and column as one number
        key = np.where(allowed, scores * width + np.arange(width - 1, -1, -1), np.iinfo(np.int64).min)
        best = np.argpartition(key, max(0, width - n), axis=1)[:, -n:]
    else:
        best = np.argsort(np.where(allowed, -scores, np.iinfo(np.int64).max), axis=1, kind="stable")[:, :n]
    row = np.repeat(np.arange(len(scores)), best.shape[1])
    keep = allowed[row, best.ravel()]
    return row[keep], best.ravel()[keep]


def _best(unit: pa.Table, n: int, windows: int, bound: int) -> pa.Table:
    """anchor (a row number), slot, vec_id and score of the n best rows of each anchor and slot in a unit.

    Without windows there is one slot: other ids of the anchor's label; else a slot for each positive: rows of other labels whose score lies in its window.
    """
    side = unit["side"].to_numpy()
    anchors, rows = unit.filter(pa.array(side == 0)), unit.filter(pa.array(side == 1)).sort_by("vec_id")
    kinds = pa.schema([("anchor", pa.int64()), ("slot", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])
    if not len(anchors) or not len(rows):
        return kinds.empty_table()
    x, y, ids = _matrix(anchors["vector"]), _matrix(rows["vector"]), rows["vec_id"].to_numpy()
    own, label, label_of = anchors["vec_id"].to_numpy(), anchors["label"].to_numpy(), rows["label"].to_numpy()
    low, high = np.zeros((2, len(anchors), windows), np.int64)
    low += 1  # no score lies in an absent slot's window
    for i, scores in enumerate(anchors["positives"].to_pylist() if windows else ()):
        low[i, : len(scores)] = [-(-LOW * s // 100) for s in scores]
        high[i, : len(scores)] = [HIGH * s // 100 for s in scores]
    found = []
    for at in range(0, len(rows), CHUNK):
        scores, same = products(x, y[at : at + CHUNK], bound), label[:, None] == label_of[None, at : at + CHUNK]
        allowed = [~same & (scores >= low[:, k, None]) & (scores <= high[:, k, None]) for k in range(windows)] or [same & (own[:, None] != ids[None, at : at + CHUNK])]
        for slot, fits in enumerate(allowed):
            i, j = first(scores, fits, n, bound)
            found.append(np.array([i, np.full(len(i), slot), ids[at + j], scores[i, j]]))
    i, slot, vec, score = np.concatenate(found, axis=1)
    order = np.lexsort((vec, -score, slot, i))
    group = (i * max(1, windows) + slot)[order]
    rank = np.arange(len(group)) - np.searchsorted(group, group)
    order = order[rank < n]
    return pa.table([anchors["row"].to_numpy()[i[order]], slot[order].astype(np.int32), vec[order], score[order]], schema=kinds)


def _met(anchors: DataFrame, rows: DataFrame, blocks: tuple[int, int], n: int, windows: int, bound: int) -> DataFrame:
    """anchor, slot, vec_id, score and rank of the n best rows of each anchor and slot, over all units."""
    dealt = lambda k: F.pmod(F.xxhash64("row"), F.lit(blocks[k])).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(blocks[k] - 1)))
    columns = [F.size("vector").alias("size"), "row", "vec_id", "label", "vector"]
    none = F.array().cast("array<long>").alias("positives")
    units = anchors.select(F.lit(0).alias("side"), dealt(0).alias("a"), *columns, "positives" if windows else none).withColumn("b", every(1))
    units = units.unionByName(rows.select(F.lit(1).alias("side"), dealt(1).alias("b"), *columns, none).withColumn("a", every(0)))

    def run(unit: pa.Table) -> pa.Table:
        return _best(unit, n, windows, bound)

    found = units.groupBy("size", "a", "b").applyInArrow(run, "anchor long, slot int, vec_id long, score long")
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def mined(rows: DataFrame, is_anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score; rows as :func:`quantized` gives them."""
    rows = cut(rows.withColumn("row", F.monotonically_increasing_id()))
    asked = rows.filter(is_anchor).groupBy("vec_id", "label", "vector").agg(F.min("row").alias("row"))
    asked = cut(asked)
    n, reach, size = rows.agg(F.count("*"), F.max("reach"), F.max(F.size("vector"))).first()
    if n and reach >= LARGEST:
        raise OverflowError("the scores of these vectors don't fit: components are too large")
    bound = int((reach or 0) * (1 + 1e-9)) + 1  # by Cauchy and Schwarz, no score exceeds the largest square norm
    per_block = max(64, COMPONENTS // max(1, size or 1))
    blocks = max(1, -(-asked.count() // ANCHORS)), max(1, -(-(n or 0) // per_block))
    positives = cut(_met(asked, rows, blocks, POSITIVES, 0, bound))
    listed = positives.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))  # at most POSITIVES
    targets = cut(asked.join(listed, asked["row"] == listed["anchor"]).drop("anchor").withColumn("positives", F.transform("p", lambda p: p["score"])))
    found = _met(targets.drop("p"), rows, blocks, NEGATIVES, POSITIVES, bound)
    out = found.join(targets.select("row", F.col("vec_id").alias("anchor_id"), "p"), F.col("anchor") == F.col("row"))
    positive = F.col("p")[F.col("slot")]
    return out.select("anchor_id", positive["vec_id"].alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score"))
