"""Near-duplicates of embeddings: PCA-ordered tiled comparison with early stops.

Vectors are scaled to unit length and rotated to principal axes (fitted on a bounded sample; any rotation gives the same cosines). Unit vectors whose cosine
reaches the threshold differ by at most sqrt(2 - 2 * threshold) in the leading coordinate, so each label is cut into bands of that width and only the same
and the next band are compared; bands over :data:`TILE` vectors are cut into tiles, and each pair of tiles is a unit of work of its own. In a unit the
products of leading dimensions come first; the rest of a product is at most the product of the suffix norms, and pairs that cannot reach the threshold stop
there. Those left are decided by the cosine of the vectors as given, in double precision. Equal vectors of a label are compared once, with their number.

Defined results: a vector that is null, empty, zero or has null or non-finite components, or whose label is null, links with nothing (n_links 0, its own
component); labels are compared as they are, of any type that can be grouped; vectors of different lengths never link; repeated rows are copies, and a row doesn't count itself; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import cut
from trajectree.llm.components import components, forest

THRESHOLD = 0.98
TILE = 2048
#: Rows that the axes are fitted on, at most (the rows of least hash).
SAMPLE = 4096
#: Dimensions that are accumulated before each bound.
STEPS = (8, 24)
#: Slack for rounding in bounds; the last decision has none.
SLACK = 1e-6


def axes(vectors: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, in order of falling variance, as columns."""
    values, basis = np.linalg.eigh(vectors.T @ vectors)
    return basis[:, np.argsort(values)[::-1]]


def _fitted(reps: DataFrame) -> dict[int, np.ndarray]:
    """Axes for each vector length in the sample."""
    sample = reps.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).collect()
    by_length: dict[int, list] = {}
    for (vector,) in sample:
        by_length.setdefault(len(vector), []).append(vector)
    out = {}
    for n, rows in by_length.items():
        out[n] = axes(unit(np.array(rows)))
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _lead(reps: DataFrame, fitted: dict[int, np.ndarray]) -> DataFrame:
    """reps with the band of the leading coordinate."""
    shared, width = reps.sparkSession.sparkContext.broadcast(fitted), np.sqrt(2 - 2 * THRESHOLD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch["vector"].offsets.to_numpy())
            band = np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                if (basis := shared.value.get(int(n))) is not None:
                    lead = unit(_matrix(batch["vector"].take(pa.array(at)))) @ basis[:, 0]
                    band[at] = np.floor(lead / (width + SLACK))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(band)], [*batch.schema.names, "band"])

    return reps.mapInArrow(run, f"rep long, n long, label {reps.schema['label'].dataType.simpleString()}, vector array<double>, band long")


def close_pairs(x: np.ndarray, y: np.ndarray, basis: np.ndarray, threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of x and y whose cosine reaches the threshold."""
    ux, uy = unit(x) @ basis, unit(y) @ basis
    ends = sorted({min(s, x.shape[1]) for s in (*STEPS, x.shape[1])})
    product = ux[:, : ends[0]] @ uy[:, : ends[0]].T
    rest = lambda u, d: np.sqrt(np.maximum(0, (u[:, d:] ** 2).sum(1)))
    i, j = np.nonzero(product + np.outer(rest(ux, ends[0]), rest(uy, ends[0])) >= threshold - SLACK)
    value = product[i, j]
    for a, b in zip(ends, ends[1:]):
        value = value + np.einsum("ij,ij->i", ux[i, a:b], uy[j, a:b])
        keep = value + rest(ux, b)[i] * rest(uy, b)[j] >= threshold - SLACK
        i, j, value = i[keep], j[keep], value[keep]
    norm = lambda u: np.sqrt((u * u).sum(1))
    sx, sy = x / np.abs(x).max(1, keepdims=True), y / np.abs(y).max(1, keepdims=True)
    keep = np.einsum("ij,ij->i", sx[i], sy[j]) / (norm(sx)[i] * norm(sy)[j]) >= threshold
    return i[keep], j[keep]


def _compare(fitted):
    def run(rows: pa.Table) -> pa.Table:
        side, rep, n = (rows[c].to_numpy() for c in ("side", "rep", "n"))
        order = np.lexsort((rep, side))
        side, rep, n, vectors = side[order], rep[order], n[order], _matrix(rows["vector"])[order]
        basis = fitted.value.get(vectors.shape[1])
        basis = np.eye(vectors.shape[1]) if basis is None else basis
        if side[0] == 0:
            i, j = close_pairs(vectors, vectors, basis)
            i, j = i[i < j], j[i < j]
        else:
            first = int((side == 1).sum())
            i, j = close_pairs(vectors[:first], vectors[first:], basis)
            j = j + first
        root, more = forest(len(rep), i, j), np.zeros(len(rep), np.int64)
        np.add.at(more, i, n[j])
        np.add.at(more, j, n[i])
        at = np.flatnonzero(more)
        return pa.table({"rep": rep[at], "root": rep[root[at]], "more": more[at]})

    return run


def _links(reps: DataFrame, tile: int) -> DataFrame:
    """rep, root (a forest of links) and more (rows linked) from each unit of work."""
    fitted = _fitted(reps)
    banded = cut(_lead(reps, fitted).withColumn("size", F.size("vector")))
    group = ["label", "size", "band"]
    counts = cut(banded.groupBy(*group).agg(F.ceil(F.count("*") / tile).cast("int").alias("parts")))
    after = counts.select("label", "size", (F.col("band") - 1).alias("band"), F.col("parts").alias("parts_after"))
    before = counts.select("label", "size", (F.col("band") + 1).alias("band"), F.col("parts").alias("parts_before"))
    rows = banded.join(counts.join(after, group, "left").join(before, group, "left"), group)
    tile_of = lambda band, part: F.struct(band.alias("band"), part.alias("part"))
    of = lambda band, parts: F.transform(F.when(parts > 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array().cast("array<int>")), lambda p: tile_of(band, p))
    rows = rows.withColumn("mine", tile_of(F.col("band"), F.pmod(F.xxhash64("rep"), "parts").cast("int")))
    tiles = F.concat(of(F.col("band"), F.col("parts")), of(F.col("band") + 1, F.coalesce("parts_after", F.lit(0))), of(F.col("band") - 1, F.coalesce("parts_before", F.lit(0))))
    units = rows.withColumn("other", F.explode(tiles)).select(
        "label", "size", F.least("mine", "other").alias("first"), F.greatest("mine", "other").alias("second"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).alias("side"), "rep", "n", "vector",
    )
    shared = reps.sparkSession.sparkContext.broadcast(fitted)
    return units.groupBy("label", "size", "first", "second").applyInArrow(_compare(shared), "rep long, root long, more long")


def near_duplicates(vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, embedding, label)."""
    as_double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", as_double.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    usable = F.coalesce(F.col("label").isNotNull() & finite, F.lit(False))
    rows = cut(rows.withColumn("key", F.when(usable, F.col("vector"))))
    reps = rows.filter("key is not null").groupBy("label", F.col("key").alias("vector")).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    reps = cut(reps.withColumn("rep", F.monotonically_increasing_id()))
    found = cut(_links(reps.select("rep", "n", "label", "vector"), tile))
    more = found.groupBy("rep").agg(F.sum("more").alias("more"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    reps = reps.join(more, "rep", "left").join(roots, reps["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    reps = cut(reps.select("label", F.col("vector").alias("key"), "n", "least", "more", "root"))
    least = reps.groupBy("root").agg(F.min("least").alias("component_id"))
    reps = reps.join(least, "root").select("label", "key", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    out = rows.join(reps, ["label", "key"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
