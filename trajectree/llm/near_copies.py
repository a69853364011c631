"""Near copies of documents: all pairs whose sets of five-word shingles reach Jaccard similarity 0.8, and what they link together.

Texts of equal sets are one set (the 64-bit hash of its shingles' hashes is its key). Candidates come from two sides and are verified by whole sets:

* First round: what SimHash fingerprints (of five-word shingles) link, and each set with the least set under a shingle of its prefix.
* Second round: no radius of fingerprints covers all similar pairs, so a prefix join does: in any order common to all, two sets that are similar enough share
  one of their first n - ceil(0.8 n) + 1 shingles. Rare shingles come first: a shingle is one number, the size class of its count's bucket (:data:`BUCKETS`
  counts over all texts, a table of fixed size) in the leading bits and its hash in the others, so passages of many documents stay out of prefixes. Only shingles that sets of different groups share are looked at. Pairs are made inside a shingle's group of
  sets, in numpy, where they pass the length and positional filters, weren't met at a shingle just before, and aren't too far apart by parity bitmaps of
  :data:`SKETCH` bits; so a pair comes out about once, and only if it is near the threshold or over it.

Defined results: null text, and text without a word, has the empty set, and such texts are copies of each other; a text of fewer than five words is one
shingle; a null doc_id takes part and gets its group's least id (null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.llm import simhash
from trajectree.llm.common import released, scratch, stored
from trajectree.llm.components import components
from trajectree.llm.line_dedup import TILE, overlap, units

WIDTH = 5
SIMILARITY = 0.8
#: Bits of the parity bitmap of a set, which bounds the symmetric difference of two sets from below.
SKETCH = 1024
#: Buckets of shingles whose counts order them, and parts that the counts are summed in.
BUCKETS, PARTS = 1 << 18, 64
#: Tasks whose counts are added up first.
MET = 256
#: Bits of a shingle's number below its size class.
HASH_BITS = 58

_EPS = 1e-9


def _set(hashes: np.ndarray) -> tuple[int, np.ndarray]:
    """The key and the members of the set of some hashes; members in order."""
    members = np.unique(hashes)
    return int(np.uint64(xxhash.xxh64_intdigest(members.tobytes(), simhash.SEED)).view(np.int64)), members


def _hashes(text: str | None) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.uint64), *simhash.shingles(text, WIDTH)])


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKETS.bit_length() + 1)).view(np.int64)


def size_classes(docs: DataFrame) -> np.ndarray:
    """For each bucket of shingles, the number of bits of its count over all texts."""
    width = BUCKETS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text in batch["text"]:
                for hashes in simhash.shingles(text.as_py(), WIDTH):
                    at, n = np.unique(_bucket(hashes), return_counts=True)
                    sums[at] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([part.tobytes() for part in sums.reshape(PARTS, -1)])], ["part", "sums"])

    def add(parts: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in parts["sums"].to_pylist())
        return pa.table({"part": parts["part"][:1], "sums": [total.tobytes()]})

    kinds = "part int, sums binary"
    counted = docs.select("text").mapInArrow(count, kinds).withColumn("of", F.floor(F.spark_partition_id() / MET))
    found = counted.groupBy("of", "part").applyInArrow(add, kinds).groupBy("part").applyInArrow(add, kinds).collect()
    out = np.zeros(BUCKETS, np.int64)
    for part, sums in found:
        out[part * width : (part + 1) * width] = np.frombuffer(sums, np.int64)
    return np.ceil(np.log2(out + 1)).astype(np.uint8)


def _ranked(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Hashes as numbers in the order of their size classes."""
    return classes[_bucket(hashes)].astype(np.uint64) << np.uint64(HASH_BITS) | hashes >> np.uint64(64 - HASH_BITS)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _sketch(members: np.ndarray, bits: int = SKETCH) -> bytes:
    odd = np.bincount((members & np.uint64(bits - 1)).view(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd).tobytes()


def _wide(members: np.ndarray) -> bytes:
    """The bitmap whose bits follow the size of the set."""
    return _sketch(members, max(SKETCH, 1 << (4 * len(members)).bit_length()))


def prefix_length(n: int) -> int:
    """Shingles of which a set of n shares one with any set that is similar enough."""
    return n - math.ceil(SIMILARITY * n - 1e-9) + 1 if n else 0


def sets(docs: DataFrame, classes: Broadcast) -> DataFrame:
    """doc_id, text_id, set_id, fp, n, sketch, wide (a larger one) and prefix of every row."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, prints, sizes, sketches, wide, prefixes = [], [], [], [], [], []
            for text in batch["text"]:
                hashes = _hashes(text.as_py())
                key, members = _set(_ranked(hashes, classes.value))
                keys.append(key)
                prints.append(simhash.majority([hashes]))
                sizes.append(len(members))
                sketches.append(_sketch(members))
                wide.append(_wide(members))
                prefixes.append(members[: prefix_length(len(members))])
            made = [pa.array(keys, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(sketches, pa.binary()), pa.array(wide, pa.binary()), _lists(prefixes)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text_id"], *made], ["doc_id", "text_id", "set_id", "fp", "n", "sketch", "wide", "prefix"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    return rows.mapInArrow(make, "doc_id long, text_id long, set_id long, fp long, n int, sketch binary, wide binary, prefix array<long>")


def _members(pairs: DataFrame, reps: DataFrame, docs: DataFrame, classes: Broadcast) -> DataFrame:
    """set_id and members (all shingles' hashes, from the text again) of the sets of some pairs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [_set(_ranked(_hashes(text.as_py()), classes.value)) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in made], pa.int64()), _lists([m for _, m in made])], ["set_id", "members"])

    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    texts = stored(reps.join(wanted, "set_id", "left_semi").select("text_id"))
    read = docs.select(F.xxhash64("text").alias("text_id"), "text").join(texts, "text_id", "left_semi").dropDuplicates(["text_id"])
    return stored(read.select("text").mapInArrow(make, "set_id long, members array<long>"))


def _similar(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """The pairs (a, b) of sets that are similar enough, by all their shingles."""
    left, right = (members.select(F.col("set_id").alias(c), F.col("members").alias(f"_{c}")) for c in "ab")
    shared = F.size(F.array_intersect("_a", "_b"))
    return pairs.join(left, "a").join(right, "b").filter(shared >= SIMILARITY * (F.size("_a") + F.size("_b") - shared) - 1e-9).select("a", "b")


def _with_room(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b) that their wide parity bitmaps leave possible, with how many more differing shingles they have room for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rooms = []
            n, m = batch["n"].to_numpy().astype(np.int64), batch["m"].to_numpy().astype(np.int64)
            most = n + m - 2 * overlap(n + m)
            for x, y, d in zip(batch["x"], batch["y"], most.tolist()):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                size = min(len(x), len(y))
                # A bitmap of twice the bits, folded, is the smaller one.
                x, y = (np.bitwise_xor.reduce(v.reshape(-1, size), axis=0) for v in (x, y))
                rooms.append(d - int(np.bitwise_count(x ^ y).sum()))
            out = pa.RecordBatch.from_arrays([batch["a"], batch["b"], pa.array(rooms, pa.int64())], ["a", "b", "room"])
            yield out.filter(pa.array(np.array(rooms, np.int64) >= 0))

    sides = [reps.select(F.col("set_id").alias(c), F.col("n").alias(k), F.col("wide").alias(w)) for c, k, w in (("a", "n", "x"), ("b", "m", "y"))]
    return pairs.join(sides[0], "a").join(sides[1], "b").mapInArrow(run, "a long, b long, room long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _possible(counted: DataFrame, reps: DataFrame) -> DataFrame:
    """The pairs (a, b, shared) that may be similar enough, if shared is how many shingles their prefixes have in common.

    Shared shingles outside the prefix that ends first number at most its set's other shingles, and those inside it are in the other prefix too.
    """
    sizes = reps.select("set_id", "n", F.size("prefix").alias("p"))
    pairs = counted.join(sizes.toDF("a", "_n", "_p"), "a").join(sizes.toDF("b", "_m", "_q"), "b")
    least = F.ceil(SIMILARITY / (1 + SIMILARITY) * (F.col("_n") + F.col("_m")) - 1e-9)
    pairs = pairs.filter(F.least("_n", "_m") >= SIMILARITY * F.greatest("_n", "_m") - 1e-9)
    return pairs.filter(F.col("shared") >= least - F.greatest(F.col("_n") - F.col("_p"), F.col("_m") - F.col("_q"))).select("a", "b")


def _met(unit: np.ndarray, side: np.ndarray, root: np.ndarray, n: np.ndarray, at: np.ndarray, earlier: np.ndarray, sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one unit and of different groups that may be similar enough; rows are in order of unit and n. earlier: three columns, -1 for none."""
    left, right, alive, lag = [], [], np.arange(len(unit)), 0
    while True:
        lag += 1
        alive = alive[alive + lag < len(unit)]
        other = alive + lag
        alive = alive[(unit[alive] == unit[other]) & (n[alive] >= SIMILARITY * n[other] - _EPS)]
        if not len(alive):
            break
        i = alive[root[alive] != root[alive + lag]]
        least = overlap(n[i] + n[i + lag])
        i = i[(n[i] - at[i] >= least) & (n[i + lag] - at[i + lag] >= least) & ((side[i] == 0) | (side[i] != side[i + lag]))]
        before = np.zeros(len(i), bool)
        for a in range(earlier.shape[1]):
            for b in range(earlier.shape[1]):
                # An earlier shingle in common leaves more room, so the pair comes out there.
                before |= (earlier[i, a] == earlier[i + lag, b]) & (at[i] > a) & (at[i + lag] > b)
        i = i[~before]
        apart = np.bitwise_count(sketch[i] ^ sketch[i + lag]).sum(1, dtype=np.int64)
        i = i[apart <= n[i] + n[i + lag] - 2 * overlap(n[i] + n[i + lag])]
        left.append(i)
        right.append(i + lag)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of unit; the pairs (a, b) of sets that :func:`_met` finds."""
    held: list[pa.RecordBatch] = []

    def found(rows: pa.Table) -> pa.RecordBatch:
        of = {c: rows[c].to_numpy() for c in ("unit", "side", "root", "n", "at", "set", "p1", "p2", "p3")}
        sketch = np.frombuffer(b"".join(rows["sketch"].to_pylist()), np.uint64).reshape(len(rows), -1)
        runs = np.cumsum(np.concatenate(([0], of["unit"][1:] != of["unit"][:-1])))
        order = np.lexsort((of["n"], runs))
        of, sketch = {c: x[order] for c, x in of.items()}, sketch[order]
        earlier = np.stack([of[c] for c in ("p1", "p2", "p3")], axis=1)
        i, j = _met(of["unit"], of["side"], of["root"], of["n"].astype(np.int64), of["at"].astype(np.int64), earlier, sketch)
        return pa.RecordBatch.from_arrays([pa.array(of["set"][i]), pa.array(of["set"][j])], ["a", "b"])

    for batch in batches:
        cuts = np.flatnonzero(np.diff(batch["unit"].to_numpy()))
        if held and len(batch) and batch["unit"][0] != held[-1]["unit"][-1]:
            yield found(pa.Table.from_batches(held))
            held = []
        if len(cuts):  # all units but the last are complete
            at = int(cuts[-1]) + 1
            yield found(pa.Table.from_batches([*held, batch.slice(0, at)]))
            held = [batch.slice(at)]
        elif len(batch):
            held.append(batch)
    if held:
        yield found(pa.Table.from_batches(held))


def _left_open(common: DataFrame, linked: DataFrame, tried: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets under common shingles that pass the filters, aren't linked yet and weren't tried; ``common`` is deleted."""
    roots = components(linked)
    rows = stored(common.join(roots, common["set_id"] == roots["node"], "left").select("token", "set_id", F.coalesce("root", "set_id").alias("root")))
    released(common.sparkSession, common)
    mixed = stored(rows.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).filter("_lo < _hi").select("token"))
    # Only shared tokens' places are looked up, and a set's bitmap meets them once: a row for each token of each prefix would be many times as much.
    shared = rows.join(mixed, "token", "left_semi").groupBy("set_id").agg(F.first("root").alias("root"), F.collect_list("token").alias("met"))  # as long as a prefix at most
    places = F.transform("met", lambda token: (F.array_position("prefix", token) - 1).cast("int"))
    before = lambda i, k: F.coalesce(F.get("prefix", i - k), F.lit(-1)).alias(f"p{k}")
    each = F.transform("places", lambda i: F.struct(F.get("prefix", i).alias("token"), i.alias("at"), before(i, 1), before(i, 2), before(i, 3)))
    rows = reps.join(shared, "set_id").withColumn("places", places).select(F.col("set_id").alias("set"), "root", "n", "sketch", F.inline(each))
    rows = units(rows, TILE, 0).select("unit", "side", "root", "n", "at", "set", "p1", "p2", "p3", "sketch")
    met = rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(_compare, "a long, b long")
    return _ordered(met).join(tried, ["a", "b"], "left_anti")


def near_copies(docs: DataFrame, radius: int) -> DataFrame:
    """doc_id and component_id (the least doc_id reachable by pairs that are similar enough) of every row; radius: that of the fingerprints' candidates."""
    # Tables are written and read rather than checkpointed: a checkpoint remembers how it was partitioned, plans over many of them grow without end, and its files
    # stay. Each table is deleted when nothing reads it any more, and so are the shuffle files behind it.
    with scratch(docs.sparkSession):
        return stored(_grouped(docs.sparkSession, docs.select("doc_id", "text"), radius), keep=True)


def _grouped(spark: SparkSession, docs: DataFrame, radius: int) -> DataFrame:
    classes = spark.sparkContext.broadcast(size_classes(docs))
    made = stored(sets(docs, classes))
    least = [F.min(c).alias(d) for c, d in (("doc_id", "least"), ("text_id", "text_id"), ("fp", "fp"), ("n", "n"))]
    least += [F.first(c).alias(c) for c in ("sketch", "wide")]
    reps = stored(made.groupBy("set_id").agg(*least, F.first("prefix").alias("prefix")))
    ids = stored(made.select("doc_id", "set_id"))
    released(spark, made)
    with scratch(spark):
        linked, rest = _candidates(reps, docs, classes, radius)
    members = _members(rest, reps, docs, classes)
    released(spark)
    # First the most similar partner of each set, then what is still between two groups.
    best = stored(rest.groupBy("a").agg(F.max_by("b", "room").alias("b")))
    linked = stored(linked.union(_similar(best, members)))
    released(spark)
    roots = components(linked)
    for c in "ab":
        rest = rest.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"_{c}")), c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", c))
    rest = stored(rest.filter("_a <> _b").select("a", "b").join(best, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        roots = components(stored(linked.union(_similar(rest, members))))
    groups = reps.select("set_id", "least").join(roots, F.col("set_id") == F.col("node"), "left").select("set_id", "least", F.coalesce("root", "set_id").alias("root"))
    groups = stored(groups)
    released(spark, members, reps)
    chosen = groups.groupBy("root").agg(F.min("least").alias("component_id"))
    return ids.join(groups.select("set_id", "root").join(chosen, "root"), "set_id").select("doc_id", "component_id")


def _candidates(reps: DataFrame, docs: DataFrame, classes: Broadcast, radius: int) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) that the first round finds, and the pairs (a, b, room) that it leaves open."""
    spark = docs.sparkSession
    tokens = reps.select("set_id", F.explode("prefix").alias("token")).repartition("token")
    # Both sides are the same rows, so they are dealt out once.
    met = tokens.groupBy("token").agg(F.count("*").alias("_sets"), F.min("set_id").alias("leader")).filter("_sets > 1").drop("_sets")
    common = stored(tokens.join(met, "token"))
    del tokens, met
    released(spark)
    proposed = simhash.links(reps.select(F.col("set_id").alias("rep"), "fp"), radius)
    led = common.filter("set_id <> leader").groupBy(F.col("set_id").alias("a"), F.col("leader").alias("b")).agg(F.count("*").alias("shared"))
    every = F.lit(1 << 30).alias("shared")  # proposed pairs are only held to the ratio of sizes
    tried = stored(_ordered(_possible(led, reps).union(_possible(proposed.select("a", "b", every), reps))))
    del led, proposed
    released(spark)
    members = _members(tried, reps, docs, classes)
    released(spark)
    linked = stored(_similar(tried, members), keep=True)
    released(spark, members)
    return linked, stored(_with_room(_left_open(common, linked, tried, reps), reps), keep=True)


def deduplicate(docs: DataFrame, radius: int) -> DataFrame:
    """docs with one row of each group of near copies, chosen as :func:`simhash.one_of_each` does."""
    return simhash.one_of_each(docs, near_copies(docs, radius))
