"""Filter interaction audit: what each filter removes in every order, from sorted posting lists.

Five filters are judged on every document once. What stays is narrow: the part, the id, and which filters fail. Range-sorted by part and id, each task holds ids
of a few parts in order, and keeps for each part the sorted lists of ids that fail each filter. Unions of lists (what a set of filters removes together) and
differences (what a filter removes after them) come from galloping merges over ranges of ids; only the sizes are kept, and summed over ranges, tasks and
parts. The 120 orders are read from the 80 differences of a filter after a set of others.

Defined results: null text is empty, null source is the part of the empty string; each row is a document of its own, repeated rows too; a document with null
doc_id fails filter E never and makes none fail it; labels that repeat count if any of their rows does; other columns are ignored; an empty table has no parts.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trajectree.llm.common import fast_words, stored

FILTERS = "ABCDE"
#: Filter after a set of others (a bit for each): all pairs in which the filter isn't in the set.
PAIRS = [(mask, f) for mask in range(1 << len(FILTERS)) for f in range(len(FILTERS)) if not mask >> f & 1]
_PLACE = {pair: k for k, pair in enumerate(PAIRS)}
#: Shares that the rows of one text are dealt into before they meet; a text's shares are at most so many rows.
SALTS = 256
#: Ids in a range of a merge, and rows of a part that a task holds at once.
RANGE = 1 << 12
BLOCK = 1 << 16


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, row and fails (a bit for each filter) of docs (doc_id, text, source); row is unlike for all rows."""
    rows = docs.select(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", fast_words(F.col("text")))
    n = lambda c: c.cast("long")
    words, capitals = n(F.size("words")), F.octet_length(F.regexp_replace("text", "[^A-Z]+", ""))
    tests = [words < 50, 100 * n(F.size(F.array_distinct("words"))) < 65 * words, 100 * n(capitals) > 5 * n(F.length("text")), F.col("text").rlike("[#$%&*|]")]
    bits = sum((F.when(test, 1 << k).otherwise(0) for k, test in enumerate(tests)), F.lit(0))
    judged = stored(rows.select("part", "doc_id", F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2("text", 256)).alias("digest"), bits.alias("bits")))
    judged = judged.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)))
    # The least id of each text: by share first, so that no group of copies meets in one task as a whole.
    least = judged.groupBy("digest", "salt").agg(F.min("doc_id").alias("least"))
    least = least.select("digest", "salt", F.min("least").over(Window.partitionBy("digest")).alias("first"))
    copy = F.when(F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)), 1 << 4).otherwise(0)
    return judged.join(least, ["digest", "salt"]).select("part", "doc_id", "row", (F.col("bits") + copy).alias("fails"))


def gallop(ids: np.ndarray, bound: int, at: int) -> int:
    """First place from ``at`` whose id isn't below ``bound``: steps of doubling width, then a binary search in the last."""
    step = 1
    while at + step < len(ids) and ids[at + step] < bound:
        step *= 2
    return at + int(np.searchsorted(ids[at : at + step + 1], bound))


def _held(ids: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Which of ids are in the other list."""
    if not len(inside):
        return np.zeros(len(ids), bool)
    at = np.searchsorted(inside, ids)
    return inside[np.minimum(at, len(inside) - 1)] == ids


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of two sorted lists; the shorter is placed in the longer."""
    short, long = (a, b) if len(a) < len(b) else (b, a)
    new = short[~_held(short, long)]
    return np.insert(long, np.searchsorted(long, new), new) if len(new) else long


def sizes(lists: list[np.ndarray], good: np.ndarray, toxic: np.ndarray, end: int) -> np.ndarray:
    """For each pair of PAIRS, the number of ids below ``end`` that fail the filter and none of the set, and of good and toxic ids among them."""
    out, ends = np.zeros((len(PAIRS), 3), np.int64), [0] * (len(FILTERS) + 2)
    for bound in range(RANGE, end + RANGE, RANGE):
        starts, ends = ends, [gallop(ids, bound, at) if at < len(ids) else at for ids, at in zip([*lists, good, toxic], ends)]
        *parts, fine, bad = (ids[a:b] for ids, a, b in zip([*lists, good, toxic], starts, ends))
        union = [np.zeros(0, np.int64)] * (1 << len(FILTERS))
        for mask in range(1, len(union)):
            low = (mask & -mask).bit_length() - 1
            union[mask] = _merged(union[mask & mask - 1], parts[low])
        for k, (mask, f) in enumerate(PAIRS):
            gone = parts[f][~_held(parts[f], union[mask])]
            out[k] += len(gone), _held(gone, fine).sum(), _held(gone, bad).sum()
    return out


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """part, pair (-1: all documents), removed, good and toxic of what a task holds, by part; rows come in order of part and id."""
    held: list[pa.RecordBatch] = []

    def rows(part: str, total: np.ndarray, n: int) -> pa.RecordBatch:
        at = np.flatnonzero(total[:, 0])
        columns = np.vstack([[[-1, n, 0, 0]], np.column_stack([at, total[at]])]).T
        return pa.RecordBatch.from_arrays([pa.array([part] * (len(at) + 1)), *map(pa.array, columns)], ["part", "pair", "removed", "good", "toxic"])

    def settled() -> np.ndarray:
        block = pa.Table.from_batches(held)
        fails, *marks = (block[c].to_numpy() for c in ("fails", "good", "toxic"))
        held.clear()
        return sizes([np.flatnonzero(fails >> f & 1) for f in range(len(FILTERS))], *map(np.flatnonzero, marks), len(fails))

    part, total, n, waiting = None, 0, 0, 0
    for batch in batches:
        names = batch["part"].to_numpy(zero_copy_only=False)
        for lo, hi in itertools.pairwise([0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)] if len(names) else [0]):
            if names[lo] != part:
                if part is not None:
                    yield rows(part, total + settled() if held else total, n)
                part, total, n, waiting = names[lo], np.zeros((len(PAIRS), 3), np.int64), 0, 0
            held.append(batch.slice(lo, hi - lo))
            n, waiting = n + hi - lo, waiting + hi - lo
            if waiting >= BLOCK:
                total, waiting = total + settled(), 0
    if part is not None:
        yield rows(part, total + settled() if held else total, n)


def _orders() -> list[dict]:
    """Every order and step: the filter, its pair, the pairs up to it, its pairs alone and last, and its pairs with the number of orders that have each."""
    out = []
    for order in itertools.permutations(range(len(FILTERS))):
        mask, before = 0, []
        for step, f in enumerate(order, 1):
            pair, alone, last = _PLACE[mask, f], _PLACE[0, f], _PLACE[(1 << len(FILTERS)) - 1 - (1 << f), f]
            before = [*before, pair]
            out.append({"filter_order": "".join(FILTERS[x] for x in order), "step": step, "f": f, "pair": pair, "before": before, "alone": alone, "last": last})
            mask |= 1 << f
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality"), said("toxic"))
    marked = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    rows = failures(docs).join(marks, "doc_id", "left").select("part", "doc_id", "row", "fails", marked("quality", "good"), marked("toxic", "toxic"))
    rows = rows.repartitionByRange("part", "doc_id", "row").sortWithinPartitions("part", "doc_id", "row")
    found = rows.mapInArrow(_audited, "part string, pair long, removed long, good long, toxic long").groupBy("part", "pair")
    found = found.agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))
    by_pair = found.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("pair", F.struct("removed", "good", "toxic")))).alias("m"))  # at most 81 entries
    dense = lambda c: F.transform(F.sequence(F.lit(0), F.lit(len(PAIRS) - 1)), lambda k: F.coalesce(F.col("m")[k.cast("long")][c], F.lit(0).cast("long")))
    parts = by_pair.select("part", F.col("m")[F.lit(-1).cast("long")]["removed"].alias("n"), *(dense(c).alias(c) for c in ("removed", "good", "toxic")))
    several = [[(k, factorial(mask.bit_count()) * factorial(len(FILTERS) - 1 - mask.bit_count())) for k, (mask, g) in enumerate(PAIRS) if g == f] for f in range(len(FILTERS))]
    worth = F.array(*(sum((F.col("removed")[k] * times for k, times in pairs), F.lit(0).cast("long")) for pairs in several))
    shape = "array<struct<filter_order: string, step: int, f: int, pair: int, before: array<int>, alone: int, last: int>>"
    out = parts.withColumn("worth", worth).withColumn("o", F.explode(F.from_json(F.lit(json.dumps(_orders())), shape)))
    at = lambda column, name: F.col(column)[F.col(f"o.{name}")]
    kept = F.col("n") - F.aggregate("o.before", F.lit(0).cast("long"), lambda x, k: x + F.col("removed")[k])
    return out.select(
        "part", "o.filter_order", "o.step", kept.alias("kept"), at("removed", "pair").alias("removed"), (at("removed", "alone") - at("removed", "pair")).alias("redundant"),
        at("removed", "last").alias("unique_fails"), at("good", "pair").alias("good_lost"), at("toxic", "pair").alias("toxic_lost"), at("worth", "f").alias("shapley"),
    )
