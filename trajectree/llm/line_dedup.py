r"""Line dedup by an exact set-similarity join.

A line is the set of its words. A line that reaches Jaccard similarity :data:`SIMILARITY` with an earlier line, by (doc_id, line number), is removed; so is a
later line of the same set. Lines of any number of words take part; callers may raise the least number.

* Order: tokens are ordered by rarity. Counts of all words are kept in :data:`BUCKETS` hash buckets (a table of fixed size, so it can go to every task); a
  token is one long, the rank of its bucket in the leading bits and a hash in the others, so sorting longs sorts by rarity, alike for all lines. Words that
  share a bucket only make the order less sharp; any order common to all lines is exact.
* Prefix: a line of n tokens is joined on its first n - ceil(0.8 n) + 1 tokens; sets of up to three tokens are similar to equal sets only and need none.
* Length, positional and bitmap filters run inside the group of a token, in numpy: lengths must be within the ratio, what follows the token must leave room
  for the overlap needed, and a parity bitmap (64 bits, 128 for long lines) bounds the size of the symmetric difference from below.
* A line needs one earlier line that is similar, so each group proposes for each line only some partners of least difference (:data:`FEW` where the best is
  clear of the threshold, :data:`MANY` where it is near), however large the family of near copies; the best of them is verified first, then the others for
  lines whose best fails. A group that had more partners for a line of which none is similar is read again for that line, and gives all that pass the filters.
* Proposed pairs are verified by the words themselves, read from the texts again.

Lines with equal sets (equal 128-bit digests) are one line (their first place counts), so copies make no pairs. A token of more than :data:`TILE` lines is
cut into tiles by length and hash, and each pair of tiles whose lengths may match is a unit of its own, so no task holds a frequent token whole.

The words are split and hashed in Arrow batches; the README gives the figures of the native form that this replaced. Tasks hold one batch and one unit.

Defined results: null text has no lines; lines with fewer words than the least are kept; rows equal in doc_id and text are one document and treated alike;
rows with equal doc_id and other text are documents of their own; null ids come first; an empty table gives an empty result; a document that loses all
its lines is dropped by :func:`deduplicate`, others keep the lines left in order; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import released, scratch, stored
from trajectree.llm.wordhash import joined, mixed, word_hashes

SIMILARITY = 0.8
LEAST_WORDS = 1
#: Sets of so many tokens are similar to equal sets only.
ONLY_COPIES = 3
BUCKETS = 1 << 16
#: Bits of a token below the rank of its bucket, and of a whole token.
HASH_BITS = 36
TOKEN_BITS = HASH_BITS + 16
#: Trailing hash bits of a token that the join leaves out: other tokens that meet only make more work for the filters.
JOIN_SHIFT = 20
#: Earlier partners that a line keeps in each group of the first round: if the best has room for :data:`CLEAR` more differing tokens, and if it hasn't.
CLEAR, FEW, MANY = 3, 2, 32
#: Tokens beyond which a line's parity bitmap has 128 bits.
LONG = 88
#: Lines of one token that are compared in one piece.
TILE = 4096
#: Bits of the bitmap that lets lines that nobody asks for go before they are read again: from so many, with the number asked for, to so many.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27

#: 64-bit words of the broadcast bitmap that lets documents that lose nothing pass by.
NEAR_WORDS = 1 << 14

_EPS = 1e-9
_NO_ID = -(1 << 63)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64("text").alias("text_id"), "text")


def ranks(docs: DataFrame, tile: int = TILE) -> tuple[np.ndarray, int]:
    """The rank of each bucket of words by its number of words in all texts, rarest first, and the first rank of more than ``tile`` words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, data, _ in joined(batch["text"]):
                sums += np.bincount(word_hashes(data)[0] & np.uint64(BUCKETS - 1), minlength=BUCKETS)
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(BUCKETS, np.int64)
    sums[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    out = np.empty(BUCKETS, np.uint64)
    out[np.argsort(sums, kind="stable")] = np.arange(BUCKETS, dtype=np.uint64)
    return out, int((sums <= tile).sum())


def prefix_length(n: np.ndarray) -> np.ndarray:
    """Tokens that lines of n tokens are joined on: any set that is similar enough has one of them."""
    return np.where(n > ONLY_COPIES, n - np.ceil(SIMILARITY * n - _EPS).astype(np.int64) + 1, 0)


def overlap(n: np.ndarray) -> np.ndarray:
    """Tokens that two similar sets must share, of n tokens together."""
    return np.ceil(SIMILARITY / (1 + SIMILARITY) * n - _EPS).astype(np.int64)


def token_sets(hashes: np.ndarray, lines: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For some lines at a time: their numbers, the number of words, the sets' tokens (rarest first, set after set) and where each set begins."""
    first = np.flatnonzero(np.concatenate(([True], lines[1:] != lines[:-1]))) if len(lines) else np.zeros(0, np.int64)
    ends, most = np.concatenate((first[1:], [len(lines)])), 1 << (64 - TOKEN_BITS)
    for at in range(0, len(first), most):
        starts, stops = first[at : at + most], ends[at : at + most]
        h = hashes[starts[0] : stops[-1]]
        token = (rank[h & np.uint64(BUCKETS - 1)] << np.uint64(HASH_BITS)) | (h >> np.uint64(64 - HASH_BITS))
        key = np.repeat(np.arange(len(starts), dtype=np.uint64), stops - starts) << np.uint64(TOKEN_BITS) | token
        key.sort()
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
        of = key >> np.uint64(TOKEN_BITS)
        begin = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        yield lines[starts], stops - starts, key & np.uint64((1 << TOKEN_BITS) - 1), begin


_LINES = "doc long, text_id long, line int, id_a long, id_b long, n int, bits long, half long, prefix array<int>"


def lines(docs: DataFrame, rank: np.ndarray, least_words: int = LEAST_WORDS) -> DataFrame:
    """A row for each line of enough words: its place, the digest of its set, n (tokens), bits and half (parity bitmap) and prefix (rarest first)."""
    names = ["doc", "text_id", "line", "id_a", "id_b", "n", "bits", "half", "prefix"]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signed = lambda x: pa.array(x.view(np.int64))
        for batch in batches:
            doc, text_id = batch["doc"].to_numpy(), batch["text_id"].to_numpy()
            for row, data, begins in joined(batch["text"]):
                hashes, at, breaks = word_hashes(data)
                before = np.searchsorted(breaks, begins)  # lines before each text
                for numbers, words, tokens, begin in token_sets(hashes, at, rank):
                    n = np.diff(np.concatenate((begin, [len(tokens)])))
                    id_a, id_b = (np.add.reduceat(mixed(tokens + np.uint64(salt)), begin) for salt in (1, 1 << 60))
                    bit = np.uint64(1) << (tokens & np.uint64(63))
                    high = np.bitwise_xor.reduceat(np.where(tokens & np.uint64(64), bit, np.uint64(0)), begin)
                    bits = np.bitwise_xor.reduceat(bit, begin)
                    length = prefix_length(n)
                    in_prefix = np.arange(len(tokens)) - np.repeat(begin, n) < np.repeat(length, n)
                    ends = pa.array(np.concatenate(([0], np.cumsum(length))).astype(np.int32))
                    of = np.searchsorted(before, numbers, side="right") - 1
                    columns = [
                        pa.array(doc[row + of]), pa.array(text_id[row + of]), pa.array((numbers - before[of]).astype(np.int32)),
                        signed(id_a), signed(id_b), pa.array(n.astype(np.int32)), signed(bits), signed(np.where(n > LONG, high, np.uint64(0))),
                        pa.ListArray.from_arrays(ends, pa.array((tokens[in_prefix] >> np.uint64(JOIN_SHIFT)).astype(np.uint32).view(np.int32))),
                    ]
                    out = pa.RecordBatch.from_arrays(columns, names)
                    yield out if least_words <= 1 else out.filter(pa.array(words >= least_words))

    return _documents(docs).mapInArrow(make, _LINES)


def _firsts(table: DataFrame) -> DataFrame:
    """The first line of each set, with a number for the set: set, doc, text_id, line, n, bits, half, prefix. Copies meet in the partial results of their tasks.

    Sets are numbered in the order of their places, so a row that goes to the group of a token needs no place: the lesser number is the earlier line.
    """
    place = F.struct("doc", "line", "text_id")
    firsts = table.groupBy("id_a", "id_b").agg(F.min(F.struct(place.alias("place"), "n", "bits", "half", "prefix")).alias("first")).select("first.*")
    firsts = stored(firsts.select("place.*", "n", "bits", "half", "prefix"))
    released(table.sparkSession)
    order = ["doc", "line", "text_id"]
    numbered = stored(firsts.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("set"), "*"))
    released(table.sparkSession, firsts)
    return numbered


def cell(*keys: np.ndarray) -> np.ndarray:
    """One hash of some numbers, row by row."""
    out = np.zeros(len(keys[0]), np.uint64)
    for key in keys:
        out = mixed(out + key.astype(np.int64).view(np.uint64))
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """The rows of ``keys`` (longs) in a bitmap whose size follows their number between fixed bounds, as 64-bit words."""
    bits, names = max(LEAST_BITS, min(MOST_BITS, 1 << (8 * keys.count()).bit_length())), keys.columns

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = cell(*(batch[c].to_numpy() for c in names)) & np.uint64(bits - 1)
            bit = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))], ["w", "bit"])

    found = keys.mapInArrow(places, "w long, bit long").groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(bits >> 6, np.uint64)
    table[found["w"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return table


def in_bitmap(table: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    at = cell(*keys) & np.uint64(64 * len(table) - 1)
    return (table[(at >> np.uint64(6)).view(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def units(rows: DataFrame, tile: int, frequent: int) -> DataFrame:
    """rows (token, n, set and others) with the units in which they are compared: unit, side (0: within the unit; else only with the other side).

    Only tokens of buckets from the rank ``frequent`` on can have more than ``tile`` rows.
    """
    maybe = rows.filter(F.shiftrightunsigned("token", HASH_BITS - JOIN_SHIFT) >= frequent)
    many = stored(maybe.groupBy("token").agg(F.count("*").alias("_n")).filter(F.col("_n") > tile))
    if many.isEmpty():
        return rows.withColumn("unit", F.col("token").cast("long")).withColumn("side", F.lit(0))
    rows = rows.join(many, "token", "left")
    few = rows.filter("_n is null").drop("_n").withColumn("unit", F.col("token").cast("long")).withColumn("side", F.lit(0))
    # Similar lengths are in the same class or the next. A line goes to each tile that its own may match.
    parts, size = F.ceil(F.col("_n") / (2 * tile)).cast("int"), F.floor(F.ln("n") / F.lit(-float(np.log(SIMILARITY))) + _EPS).cast("int")
    tile_of = lambda c, p: F.struct(c.alias("size"), p.alias("part"))
    others = F.flatten(F.transform(F.sequence(size - 1, size + 1), lambda c: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: tile_of(c, p))))
    large = rows.filter("_n is not null").withColumn("mine", tile_of(size, F.pmod(F.xxhash64("set"), parts).cast("int"))).withColumn("other", F.explode(others))
    # The token stays in the last 32 bits.
    tile_pair = F.shiftleft(F.xxhash64(F.least("mine", "other"), F.greatest("mine", "other")), 32)
    unit = tile_pair.bitwiseOR(F.col("token").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    side = F.when(F.col("mine") == F.col("other"), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
    large = large.withColumn("unit", unit).withColumn("side", side).drop("mine", "other", "_n")
    return few.unionByName(large)


def met(unit: np.ndarray, side: np.ndarray, n: np.ndarray, at: np.ndarray, bits: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of rows of a unit that pass the length, positional and bitmap filters, and the room that is left to each. Rows are in order of unit and n."""
    left, right, spare, alive, lag = [], [], [], np.arange(len(unit)), 0
    while True:
        lag += 1
        alive = alive[alive + lag < len(unit)]
        other = alive + lag
        go = (unit[alive] == unit[other]) & (n[alive] >= SIMILARITY * n[other] - _EPS)
        alive = alive[go]
        if not len(alive):
            break
        i, j = alive, alive + lag
        least = overlap(n[i] + n[j])
        both, halves = bits[i] ^ bits[j], half[i] ^ half[j]
        long = (n[i] > LONG) & (n[j] > LONG)
        apart = np.where(long, np.bitwise_count(halves).astype(np.int64) + np.bitwise_count(both ^ halves), np.bitwise_count(both))
        room = n[i] + n[j] - 2 * least - apart
        ok = (room >= 0) & (n[i] - at[i] >= least) & (n[j] - at[j] >= least) & ((side[i] == 0) | (side[i] != side[j]))
        left.append(i[ok])
        right.append(j[ok])
        spare.append(room[ok])
    if not left:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(left), np.concatenate(right), np.concatenate(spare)


def _compare(all_pairs: bool):
    """Rows in order of unit; for each line with earlier partners in its unit: all of them, or some with most room, and at the last of these whether there are others."""
    columns = ["unit", "shape", "set", "bits", "half"]

    def found(rows: np.ndarray) -> pa.RecordBatch:
        runs = np.cumsum(np.concatenate(([0], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else rows[0]
        rows = rows[:, np.lexsort((rows[1], runs))]
        unit, shape, sets, bits, half = rows
        n, at, side, wanted = shape >> 32, (shape >> 3) & ((1 << 29) - 1), (shape >> 1) & 3, shape & 1
        i, j, room = met(unit, side, n, at, bits.view(np.uint64), half.view(np.uint64))
        swap = sets[i] > sets[j]  # sets are numbered in the order of their places
        late, early = np.where(swap, i, j), np.where(swap, j, i)
        keep = (wanted[late] == 1) & (sets[late] != sets[early])
        late, early, room = late[keep], early[keep], room[keep]
        more = np.zeros(len(late), bool)
        if not all_pairs and len(late):
            # Of equal room any will do: a hash spreads the partners.
            order = np.lexsort((mixed((sets[late] ^ (sets[early] << 20)).view(np.uint64)), -room, late))
            late, early, room = late[order], early[order], room[order]
            first = np.flatnonzero(np.concatenate(([True], late[1:] != late[:-1])))
            nth = np.arange(len(late)) - np.repeat(first, np.diff(np.concatenate((first, [len(late)]))))
            most = np.where(room[first] >= CLEAR, FEW, MANY)[np.cumsum(nth == 0) - 1]
            more = np.concatenate((nth[1:], [0])) == most
            late, early, room, more = (x[nth < most] for x in (late, early, room, more))
        token = unit[late].astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (sets[late], sets[early], room, more, token)], ["a", "b", "room", "more", "token"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            rows = np.stack([batch[c].to_numpy() for c in columns])
            held.append(rows)
            cuts = np.flatnonzero(np.diff(rows[0]))
            if len(cuts):  # all units but the last are complete
                every = np.concatenate(held, axis=1)
                keep = rows.shape[1] - cuts[-1] - 1
                yield found(every[:, :-keep])
                held = [every[:, -keep:]]
        if held:
            yield found(np.concatenate(held, axis=1))

    return run


def _rows_asked(firsts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The prefix rows of the tokens of ``wanted`` (set, token), its sets marked; by bitmaps, so some others may be among them."""
    asked = bitmap(wanted.select("set").distinct()), bitmap(wanted.select(F.col("token").cast("long").alias("token")).distinct())
    shared = firsts.sparkSession.sparkContext.broadcast(asked)
    names = ["set", "n", "bits", "half"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, of_sets = shared.value
        for batch in batches:
            length = np.diff(batch["prefix"].offsets.to_numpy())
            token = batch["prefix"].flatten().to_numpy()
            of = np.repeat(np.arange(len(length)), length)
            at = np.arange(len(token)) - np.repeat(np.cumsum(length) - length, length)
            asked = in_bitmap(sets, batch["set"].to_numpy()).astype(np.int32)
            keep = np.flatnonzero(in_bitmap(of_sets, token.astype(np.int64)))
            out = batch.select(names).take(pa.array(of[keep]))
            more = [asked[of[keep]], at[keep].astype(np.int32), token[keep]]
            yield pa.RecordBatch.from_arrays([*out.columns, *map(pa.array, more)], [*names, "wanted", "at", "token"])

    return firsts.select(*names, "prefix").mapInArrow(run, "set long, n int, bits long, half long, wanted int, at int, token int")


def _proposed(firsts: DataFrame, wanted: DataFrame | None, tile: int, frequent: int) -> DataFrame:
    """Pairs a, b (b earlier) of sets that pass the filters: the best few of each unit for each a, or all for the sets and tokens of ``wanted``."""
    if wanted is None:
        rows = firsts.select("set", "n", "bits", "half", F.lit(1).alias("wanted"), F.posexplode("prefix").alias("at", "token"))
    else:
        rows = _rows_asked(firsts, wanted)
    parts = (F.shiftleft(F.col(c).cast("long"), k) for c, k in (("n", 32), ("at", 3), ("side", 1), ("wanted", 0)))
    shape = sum(parts, F.lit(0).cast("long"))
    rows = units(rows, tile, frequent).select("unit", shape.alias("shape"), "set", "bits", "half")
    # By one number alone, so Spark sorts without comparing rows; the lengths are put in order in the batches.
    rows = rows.repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(_compare(wanted is not None), "a long, b long, room long, more boolean, token int")


def _asked_lines(docs: DataFrame, places: DataFrame) -> DataFrame:
    """doc, text_id, line and said (its bytes) of the lines that may be among ``places``."""
    shared, names = docs.sparkSession.sparkContext.broadcast(bitmap(places)), ["doc", "text_id", "line", "said"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, text_id = batch["doc"].to_numpy(), batch["text_id"].to_numpy()
            for row, data, begins in joined(batch["text"]):
                feeds = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
                first, end = np.concatenate(([0], feeds + 1)), np.concatenate((feeds, [len(data)]))
                before = np.searchsorted(feeds, begins)
                of = np.searchsorted(before, np.arange(len(first)), side="right") - 1
                line, of = np.arange(len(first)) - before[of], row + of
                keep = np.flatnonzero(in_bitmap(shared.value, doc[of], text_id[of], line))
                data = data.to_pybytes()
                said = pa.array([data[a:b] for a, b in zip(first[keep].tolist(), end[keep].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc[of[keep]]), pa.array(text_id[of[keep]]), pa.array(line[keep].astype(np.int32)), said], names)

    # Documents that nobody asks for stay in Spark.
    near = _near(_documents(docs), F.xxhash64("doc"), places.select(F.xxhash64("doc").alias("_key"))).filter("_near").select("doc", "text_id", "text")
    return near.mapInArrow(run, "doc long, text_id long, line int, said binary")


def _verified(pairs: DataFrame, firsts: DataFrame, docs: DataFrame) -> DataFrame:
    """The sets a of pairs (a, b) that are similar, by the words of both lines, read from the texts again."""
    side = lambda c, k: F.struct(F.col(c).alias("set"), F.lit(k).alias("side"))
    sides = pairs.select("a", "b", F.explode(F.array(side("a", 0), side("b", 1))).alias("x")).select("a", "b", "x.*")
    sides = stored(sides.join(firsts.select("set", "doc", "text_id", "line"), "set").drop("set"))
    place = ["doc", "text_id", "line"]
    read = _asked_lines(docs, sides.select(*place).distinct())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, words = None, frozenset()
        for batch in batches:
            similar = []
            for a, b, k, said in zip(*(batch[c].to_pylist() for c in ("a", "b", "side", "said"))):
                if not k and pair != (a, b):
                    pair, words = (a, b), frozenset(said.split())
                elif k and pair == (a, b) and words is not None:
                    mine = frozenset(said.split())
                    shared = len(mine & words)
                    if shared >= SIMILARITY * (len(mine) + len(words) - shared) - _EPS:
                        similar.append(a)
                    words = None  # rows that repeat have their lines twice
            if similar:
                yield pa.RecordBatch.from_arrays([pa.array(similar, pa.int64())], ["set"])

    texts = sides.join(read, place).select("a", "b", "side", "said").repartition("a", "b").sortWithinPartitions("a", "b", "side")
    return texts.mapInArrow(compare, "set long").distinct()


def _dropped(firsts: DataFrame, docs: DataFrame, tile: int, frequent: int) -> DataFrame:
    """The sets whose first line is similar to an earlier one."""
    proposed = stored(_proposed(firsts, None, tile, frequent))
    few = stored(proposed.groupBy("a", "b").agg(F.max("room").alias("room")))
    best = stored(few.groupBy("a").agg(F.max_by("b", "room").alias("b")))
    similar = stored(_verified(best, firsts, docs))
    # Lines whose best partner failed: the others that they have, then all that a group had more of.
    others = stored(few.join(similar.toDF("a"), "a", "left_anti").join(best, ["a", "b"], "left_anti").select("a", "b"))
    if not others.isEmpty():
        similar = stored(similar.union(_verified(others, firsts, docs)))
    failed = stored(proposed.filter("more").select(F.col("a").alias("set"), "token").distinct().join(similar, "set", "left_anti"))
    if not failed.isEmpty():
        every = _proposed(firsts, failed, tile, frequent).select("a", "b").distinct().join(failed.select(F.col("set").alias("a")).distinct(), "a", "left_semi")
        similar = stored(similar.union(_verified(stored(every.join(few, ["a", "b"], "left_anti")), firsts, docs)))
    return similar


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS, tile: int = TILE) -> DataFrame:
    """doc_id, text_id and line of every line that is removed."""
    rank, frequent = ranks(docs, tile)
    table = stored(lines(docs, rank, least_words))
    firsts = _firsts(table)
    kept = firsts.join(_dropped(firsts, docs, tile, frequent), "set", "left_anti").select("doc", "text_id", "line")
    removed = table.select("doc", "text_id", "line").join(kept, ["doc", "text_id", "line"], "left_anti")
    return removed.select(F.nullif("doc", F.lit(_NO_ID)).alias("doc_id"), "text_id", "line")


def removed_by_document(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, text_id and removed (numbers of the lines removed) of every document that loses any."""
    with scratch(docs.sparkSession):
        return stored(removed_lines(docs, least_words).groupBy("doc_id", "text_id").agg(F.sort_array(F.collect_set("line")).alias("removed")), keep=True)


def _cell(key: Column) -> tuple[Column, Column]:
    """The word and the bit of a key's place in a bitmap of :data:`NEAR_WORDS`."""
    hashed = F.xxhash64(key)
    return hashed.bitwiseAND(F.lit(NEAR_WORDS - 1)), F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(hashed, 58).cast("int"))


def _near(rows: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """rows with _near: false only if their key isn't among ``keys`` (_key). The bitmap is a table of at most :data:`NEAR_WORDS` rows that goes to every task;
    as a literal it would stand in each text of the plan that the driver keeps."""
    word, bit = _cell(F.col("_key"))
    table = stored(keys.groupBy(word.alias("_word")).agg(F.bit_or(bit).alias("_bits")))
    word, bit = _cell(key)
    marked = rows.withColumn("_word", word).withColumn("_bit", bit).join(F.broadcast(table), "_word", "left")
    return marked.withColumn("_near", F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))).drop("_word", "_bit", "_bits")


def deduplicate(docs: DataFrame, least_words: int = LEAST_WORDS, least_left: float = 0.0) -> DataFrame:
    """docs without the lines removed, and without the documents that have no word left.

    A document of which less than ``least_left`` of the characters would be left keeps its whole text: it is a copy of others for the most part, and near-dedup,
    which comes after and needs whole texts, decides about it. ``n_chars``, if there, is set to match.
    """
    key = F.struct("doc_id", F.xxhash64("text").alias("text_id")).alias("_key")
    removed = removed_by_document(docs.select("doc_id", "text"), least_words).select(F.struct("doc_id", "text_id").alias("_key"), "removed")
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*[F.col(f"`{c}`") for c in rest] or [F.lit(0)]).alias("_row"))
    rows = rows.select(key, "*")
    # Documents that lose nothing needn't meet the table of removed lines.
    rows = _near(rows, F.col("_key"), removed)
    touched = rows.filter("_near").join(removed, "_key", "left")
    others = rows.filter("not _near").withColumn("removed", F.lit(None).cast("array<int>"))
    rows = touched.unionByName(others)
    left = F.filter(F.split("text", "\n"), lambda _, k: ~F.array_contains("removed", k))
    rows = rows.withColumn("_left", F.when(F.col("removed").isNotNull(), left))
    if least_left > 0:
        rows = rows.withColumn("_left", F.when(F.length(F.array_join("_left", "\n")) >= least_left * F.length("text"), F.col("_left")))
    rows = rows.filter(F.col("_left").isNull() | F.exists("_left", lambda x: x.rlike("[^\x20\x09-\x0D]")))
    text = F.when(F.col("_left").isNull(), F.col("text")).otherwise(F.array_join("_left", "\n"))
    of = {c: F.col(f"_row.`{c}`") for c in rest} | {"doc_id": F.col("doc_id").cast(docs.schema["doc_id"].dataType), "text": text}
    if "n_chars" in rest:
        of["n_chars"] = F.when(F.col("_left").isNull(), of["n_chars"]).otherwise(F.length(text).cast("long"))
    return rows.select(*[of[c].alias(c) for c in docs.columns])
