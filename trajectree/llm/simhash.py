"""Near-duplicates by SimHash: tiled exact comparison of fingerprints by exclusive-or and bit counts.

Fingerprints of whole texts are made in numpy (XXH64 of each word shingle, one vote a bit). Equal fingerprints are grouped first, so copies are never
compared. Two fingerprints that differ in at most ``radius`` bits agree in one of ``radius + 1`` blocks of bits; each block value is a bucket of tiles.
Inside a bucket, rows are in order of population count and are compared only while the counts differ by no more than the radius; a bucket over
:data:`TILE` rows is cut into tiles by population count and hash, and each pair of its tiles whose counts may meet is a unit of work of its own. A unit
returns a spanning forest of its links, never all pairs; :mod:`components` joins the forests.

Defined results: null text, and text without a word, has fingerprint zero, and links as any other; a text of fewer words than a shingle is one shingle;
repeated rows are copies; a null doc_id takes part and gets its group's least id (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import cut, stored
from trajectree.llm.components import components, forest

SEED = 42
RADIUS = 2
#: Rows that a unit of comparison holds on each side.
TILE = 4096
#: Shingles that are hashed at a time.
CHUNK = 1 << 16


def shingles(text: str | None, width: int = 3) -> Iterator[np.ndarray]:
    """The hashes of a text's word shingles, some at a time."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    flat, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) < width:
        starts, ends = starts[:1], ends[-1:]
    else:
        starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), CHUNK):
        spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
        yield np.array([digest(flat[a:b], SEED) for a, b in spans], np.uint64)


def majority(parts: Iterable[np.ndarray]) -> int:
    """64 bits, each 1 if over half of the hashes set it."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in parts:
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(hashes)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' hashes set it."""
    return majority(shingles(text, width))


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (64 bits, as a signed long) of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), width) for x in batch["text"]], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(made, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(make, "doc_id long, fp long")


def linked(key: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of indices within a unit (equal key) that are within the radius; rows are ordered by key and population count.

    side: 0 for a unit compared with itself; else rows of side 1 are only compared with rows of side 2.
    """
    bits = np.bitwise_count(fp).astype(np.int64)
    left, right, alive, lag = [], [], np.arange(len(fp)), 0
    while True:
        lag += 1
        alive = alive[alive + lag < len(fp)]
        alive = alive[(key[alive] == key[alive + lag]) & (bits[alive + lag] - bits[alive] <= radius)]
        if not len(alive):
            break
        near = alive[np.bitwise_count(fp[alive] ^ fp[alive + lag]) <= radius]
        near = near[(side[near] == 0) | (side[near] != side[near + lag])]
        left.append(near)
        right.append(near + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def done(rows: np.ndarray) -> pa.RecordBatch:
            i, j = linked(rows[0], rows[1], rows[2].view(np.uint64), radius)
            root, rep = forest(rows.shape[1], i, j), rows[3]
            at = np.flatnonzero(root != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([pa.array(rep[at]), pa.array(rep[root[at]])], ["a", "b"])

        for batch in batches:
            rows = np.stack([batch[c].to_numpy() for c in ("unit", "side", "fp", "rep")])
            held.append(rows)
            cuts = np.flatnonzero(np.diff(rows[0]))
            if len(cuts):  # all units but the last are complete
                every = np.concatenate(held, axis=1)
                keep = rows.shape[1] - cuts[-1] - 1
                yield done(every[:, :-keep])
                held = [every[:, -keep:]]
        if held:
            yield done(np.concatenate(held, axis=1))

    return run


def links(reps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """A forest of links (a, b) between rows (rep long, fp long) of different fingerprints within the radius."""
    width, spare = divmod(64, radius + 1)
    blocks, at = [], 0
    for k in range(radius + 1):
        n = width + (k < spare)
        blocks.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << n) - 1)).alias("value")))
        at += n
    rows = reps.select("rep", "fp", F.explode(F.array(*blocks)).alias("at")).select("rep", "fp", "at.block", "at.value")
    sizes = stored(rows.groupBy("block", "value").agg(F.count("*").alias("n")).filter("n > 1"))
    rows = rows.join(sizes, ["block", "value"])
    # In a large bucket: tiles by population count and hash part; a row goes to each tile within the radius of its own.
    # Population counts spread a bucket over many tiles (the middle count has a tenth of random fingerprints), so few hash parts are needed.
    parts = F.ceil(F.col("n") / (8 * tile)).cast("int")
    bits = F.bit_count("fp")
    mine = F.struct(bits.alias("bits"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    others = F.explode(F.flatten(F.transform(F.sequence(F.greatest(bits - radius, F.lit(0)), F.least(bits + radius, F.lit(64))), lambda b: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(b.alias("bits"), p.alias("part"))))))
    large = rows.filter(F.col("n") > tile).withColumn("mine", mine).select("*", others.alias("other"))
    large = large.select(
        "rep", "fp", F.xxhash64("block", "value", F.least("mine", "other"), F.greatest("mine", "other")).alias("unit"),
        F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2).cast("long").alias("side"),
    )
    small = rows.filter(F.col("n") <= tile).select("rep", "fp", F.xxhash64("block", "value").alias("unit"), F.lit(0).cast("long").alias("side"))
    units = small.union(large).repartition("unit").sortWithinPartitions("unit", F.bit_count("fp"), "fp")
    return units.select("unit", "side", "fp", "rep").mapInArrow(_compare(radius), "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id reachable) of every row."""
    prints = cut(fingerprints(docs, width))
    reps = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("_n")).withColumn("rep", F.monotonically_increasing_id()))
    roots = components(links(reps.select("rep", "fp"), radius))
    reps = reps.join(roots, reps["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep"))
    least = cut(reps.groupBy("root").agg(F.min("least").alias("component_id")))
    return prints.join(reps.select("fp", "root").join(least, "root"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: the least doc_id's (null last), of equal ids the row of least hash; of rows that are equal, one."""
    return one_of_each(docs, near_duplicates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), radius))


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs with the rows that :func:`deduplicate` keeps, by doc_id and component_id of every row."""
    keyed = docs.select("doc_id", "text", F.struct("*").alias("_row")).withColumn("_key", F.xxhash64("doc_id", "text"))
    found = stored(found.select("doc_id", "component_id"))
    kept = stored(found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_kept")).distinct())
    stay = keyed.join(kept, keyed["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")
    # Rows of one id: the first of them only, without a shuffle of others' texts.
    first = stored(stay.groupBy(F.col("doc_id").alias("_id")).agg(F.min("_key").alias("_least"), F.count("*").alias("_n")).filter("_n > 1"))
    single = stay.join(first, stay["doc_id"].eqNullSafe(first["_id"]), "left_anti").select("_row.*")
    twice = stay.join(first, stay["doc_id"].eqNullSafe(first["_id"]) & (stay["_key"] == first["_least"])).dropDuplicates(["_id", "_key"]).select("_row.*")
    return single.unionByName(twice)
