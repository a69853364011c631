"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are put in a fixed shuffled order. A document's virtual finish time is the words of its source up to its own end, divided by the
source's target. Copies of documents are range-sorted by finish time over all sources, and the order is truncated where its running total of words reaches
the budget, the sum of the targets in whole words. Documents in service near that place give their leading words: the finish time of the word at which the
total reaches the budget is found by narrowing an interval of time, a count of words a side, until few words lie in it, which are sorted; so each source
comes within a word of its target. The words that each source got before the cut decide what is taken of its documents.

A source may hold any share of the rows: its running sum is taken in ranges of the shuffle hash, with the ranges' totals added first. The order's running
total is the totals of its partitions, and a sum inside the one partition where the cut falls.

Defined results: null text has size 0 and is never taken; null source is a source of its own, last in order; equal rows share their places in either
order; an empty table gives an empty mix; columns besides ``doc_id``, ``text`` and ``source`` are kept as they are by :func:`mix`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trajectree.llm.common import WORD, cut, ranked, stored, word_count

SEED = 20240501
WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Rows of a source that one range of its shuffled order holds, about.
RANGE_ROWS = 20_000
LEAST_RANGES = 256
#: Times at which a round counts the words near the cut, and words that are sorted at once.
CUTS, FEW_WORDS = 31, 10_000


def _key() -> list[str]:
    return ["_source", "_no_source", "_range"]


def _shuffled(docs: DataFrame, ranges: int) -> DataFrame:
    """Size, place in the shuffle, and the range of the shuffle that holds it. ranges: a power of two."""
    place = F.xxhash64(F.lit(SEED), "doc_id", "source", "text")
    return (
        docs.withColumn("_size", word_count(F.col("text")))
        .withColumn("_place", place)
        .withColumn("_range", F.shiftright("_place", 64 - int(math.log2(ranges))))
        .withColumn("_source", F.coalesce("source", F.lit("")))
        .withColumn("_no_source", F.col("source").isNull())
    )


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """Each source's target, from totals (_source, _no_source, source_size).

    Sources weigh 1, 2, 3, repeating, by code point. A target over ``epochs`` times its source's size stops there, and the excess is shared again by weight
    until none is above: the level (words per unit of weight) only rises, so each round is one sum over the sources left.
    """
    by_place = ranked(totals, F.col("_no_source"), F.col("_source"), name="_nth")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_nth") % len(weights) + 1).cast("int"))
    sources = cut(by_place.withColumn("_weight", weight.cast("long")).withColumn("_most", epochs * F.col("source_size")))
    budget = sources.agg(F.sum("source_size")).first()[0] or 0
    level, below = 0.0, None
    while True:
        stopped = F.col("_most") < F.col("_weight") * F.lit(level)
        capped, share, n = sources.agg(
            F.coalesce(F.sum(F.when(stopped, F.col("_most"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~stopped, F.col("_weight"))), F.lit(0)),
            F.count(F.when(stopped, 1)),
        ).first()
        if n == below or not share:
            break
        level, below = max(level, (budget - capped) / share), n
    return sources.select(
        "_source", "_no_source", "source_size", F.least(F.col("_most").cast("double"), F.col("_weight") * F.lit(level)).alias("target")
    )


def _place_at(order: DataFrame, total: int) -> float:
    """The finish time of the row at which the running total of _words in the sorted ``order`` (with its partitions as _part) reaches total; 0 for none.

    Gathers one row per partition, and sums inside one partition only.
    """
    sums = {r["_part"]: r["n"] for r in order.groupBy("_part").agg(F.sum("_words").alias("n")).collect()}
    before = 0
    for part in sorted(sums):
        if before + sums[part] >= total > 0:
            upto = F.sum("_words").over(Window.partitionBy("_part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
            return order.filter(F.col("_part") == part).withColumn("_upto", upto).filter(F.col("_upto") >= total - before).agg(F.min("_finish")).first()[0]
        before += sums[part]
    return math.inf if before and total > 0 else 0.0


#: The global order of copies and of single words: by finish time, equal ones by source.
ORDER = ("_finish", "_no_source", "_source", "_begin")


def _in_order(rows: DataFrame) -> DataFrame:
    return stored(rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).withColumn("_part", F.spark_partition_id()))


def served(placed: DataFrame, goal: DataFrame, epochs: int) -> DataFrame:
    """The words that each source gets before the global order of finish times is truncated at the budget: _source, _no_source, _served.

    placed: _source, _no_source, _size, _start, source_size and target of each document; goal: the targets. Copies that finish before the running total comes
    within a largest document of each source to the budget are served whole, and those that begin after it reaches the budget not at all; the others, a few
    of each source, up to the word at which it reaches the budget.
    """
    budget = goal.agg(F.coalesce(F.sum(F.floor("target")), F.lit(0))).first()[0]
    largest = placed.groupBy("_source", "_no_source").agg(F.max("_size").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    keys = ["_source", "_no_source"]
    copies = placed.filter("_size > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.select(*keys, "target", F.col("_size").alias("_words"), (F.col("_epoch") * F.col("source_size") + F.col("_start")).alias("_begin"))
    order = _in_order(copies.withColumn("_finish", (F.col("_begin") + F.col("_words")) / F.col("target")))
    early, late = _place_at(order, budget - largest), _place_at(order, budget)
    whole = order.filter(F.col("_finish") <= early).groupBy(*keys).agg(F.sum("_words").alias("_words"))
    near = order.filter((F.col("_finish") > early) & (F.col("_begin") / F.col("target") < late))
    near = stored(near.select(*keys, "target", "_begin", "_words", "_finish"))
    last = _last_word(near, budget - (whole.agg(F.sum("_words")).first()[0] or 0))
    parts = near.groupBy(*keys).agg(F.sum(_words_by(F.lit(last))).alias("_words"))
    return whole.unionByName(parts).groupBy(*keys).agg(F.sum("_words").alias("_served"))


def _words_by(time: Column) -> Column:
    """Words of a copy (_begin, _words, target) that finish by a time, the k-th word of a source at k / target."""
    n = F.floor(F.least(time * F.col("target"), F.col("_begin") + F.col("_words") + 1)) - F.col("_begin")
    # Rounding may leave one word on the wrong side.
    more = F.when((F.col("_begin") + n + 1) / F.col("target") <= time, 1).otherwise(0)
    less = F.when((F.col("_begin") + n) / F.col("target") > time, 1).otherwise(0)
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("_words"), n + more - less))


def _last_word(near: DataFrame, total: int) -> float:
    """The finish time of the word at which the words of copies near the cut (target, _begin, _words, _finish), in order, number total; 0 if total isn't positive.

    Each round counts the words up to :data:`CUTS` times and keeps the interval that holds the word looked for. Words become rows, and are sorted, only when
    there are no more of them in it than copies (or :data:`FEW_WORDS`), or no time lies between its ends.
    """
    copies, words, high = near.agg(F.count("*"), F.coalesce(F.sum("_words"), F.lit(0)), F.max("_finish")).first()
    if total <= 0 or not copies:
        return 0.0
    if total > words:
        return math.inf
    low, before, upto = 0.0, 0, words
    while upto - before > max(copies, FEW_WORDS):
        times = sorted({low + (high - low) * k / (CUTS + 1) for k in range(1, CUTS + 1)} - {low, high})
        if not times:
            break
        each = near.withColumn("_time", F.explode(F.array(*map(F.lit, times))))
        by = dict(each.groupBy("_time").agg(F.sum(_words_by(F.col("_time"))).alias("n")).collect())
        low, before = max([(low, before), *((t, n) for t, n in by.items() if n < total)])
        high, upto = min([(high, upto), *((t, n) for t, n in by.items() if n >= total)])
    first, end = (F.col("_begin") + _words_by(F.lit(t)) for t in (low, high))
    left = near.filter(first < end).withColumn("_begin", F.explode(F.sequence(first, end - 1)))
    left = left.withColumn("_words", F.lit(1).cast("long")).withColumn("_finish", (F.col("_begin") + 1) / F.col("target"))
    return _place_at(_in_order(left), total - before)


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, texts: bool = True) -> DataFrame:
    """``docs`` with size, source_size, target, _start (its source's words before it), _served (what its source gets) and taken (the words that the mix takes).

    Repeats are counted in taken. Without texts, only doc_id and source are kept, and texts are read once.
    """
    rows = docs.count()
    ranges = 1 << max(int(math.log2(LEAST_RANGES)), math.ceil(math.log2(max(1, rows / RANGE_ROWS))))
    shuffled = _shuffled(docs, ranges)
    sizes = stored(shuffled.select("doc_id", "source", "_size", "_place", *_key()))
    ranges_of = cut(sizes.groupBy(*_key()).agg(F.sum("_size").alias("_range_size")))
    goal = cut(targets(ranges_of.groupBy("_source", "_no_source").agg(F.sum("_range_size").alias("source_size")), weights, epochs))
    in_order = Window.partitionBy("_source", "_no_source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges_of = ranges_of.withColumn("_before", F.coalesce(F.sum("_range_size").over(in_order), F.lit(0))).drop("_range_size")
    ranges_of = ranges_of.join(goal, ["_source", "_no_source"])
    in_range = Window.partitionBy(*_key()).orderBy("_place", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("_in_range", F.coalesce(F.sum("_size").over(in_range), F.lit(0)))
        return rows.join(ranges_of, _key()).withColumn("_start", F.col("_before") + F.col("_in_range")).drop("_before", "_in_range", "_place")

    got = cut(served(placed(sizes), goal, epochs))
    taken = sum((words_taken(e) for e in range(epochs)), F.lit(0).cast("long"))
    out = placed(shuffled if texts else sizes).join(got, ["_source", "_no_source"], "left").withColumn("_served", F.coalesce("_served", F.lit(0)))
    return out.withColumn("taken", taken).drop(*_key())


def words_taken(epoch: int | Column) -> Column:
    """The words of a document's copy in this pass over its source that are among those its source gets."""
    left = F.col("_served") - (epoch * F.col("source_size") + F.col("_start"))
    return F.greatest(F.lit(0).cast("long"), F.least(F.col("_size"), left))


def finish_time(epoch: int | Column) -> Column:
    """Virtual finish time of that copy: its source's words up to its end over the source's target; null for a source with no target."""
    return F.try_divide((epoch * F.col("source_size") + F.col("_start") + F.col("_size")).cast("double"), F.col("target"))


def mixed_plan(docs: DataFrame) -> DataFrame:
    """One row per document, globally in the order of its first finish time: doc_id, size, source_size, target, taken, finish."""
    done = plan(docs, texts=False).select("doc_id", F.col("_size").alias("size"), "source_size", "target", "taken", finish_time(0).alias("finish"))
    return done.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mixed corpus in global order of virtual finish time: a row for each copy taken, with the columns of ``docs``.

    A copy that the end of the budget cuts keeps its leading words, with the text up to the end of the last of them; ``n_chars``, if there, is set to match.
    """
    columns = docs.columns
    rest = [c for c in columns if c not in ("doc_id", "source", "text")]
    docs = docs.select("doc_id", "source", "text", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)]).alias("_row"))
    copies = plan(docs, weights, epochs).filter("taken > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("_words", words_taken(F.col("_epoch"))).filter("_words > 0").withColumn("_finish", finish_time(F.col("_epoch")))
    whole = F.col("_words") == F.col("_size")
    kept = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), 1, F.col("_words").cast("int")), "")
    out = copies.withColumn("text", F.when(whole, F.col("text")).otherwise(kept))
    of = {c: F.col(f"_row.`{c}`") for c in rest} | {c: F.col(c) for c in ("doc_id", "source", "text")}
    if "n_chars" in rest:
        of["n_chars"] = F.when(whole, of["n_chars"]).otherwise(F.length("text"))
    out = out.repartitionByRange("_finish", "doc_id").sortWithinPartitions("_finish", "doc_id")
    return out.select(*[of[c].alias(c) for c in columns])
