"""Removal of long repeated byte strings (suffix-array dedup).

A byte goes if a string of :data:`LENGTH` bytes that covers it also starts anywhere else. Matches never cross documents, and are judged on the input.

* Each 200-byte string is led by one anchor: the 64-byte string inside it with the least hash (the first of equals), so equal strings have equal anchors
  at equal offsets. The strings of a document that follow each other under one anchor make a fragment; its row has the hashes of anchor and fragment.
* Counts of (anchor, fragment) are summed in Spark. An anchor that occurs once settles its strings: they repeat nowhere. A fragment that occurs twice
  settles its own: all of them repeat.
* What is left are fragments that occur once under an anchor that others share, at the ends of repeated passages and around edits of near copies. Their
  bytes, and those of one copy of each other fragment of the anchor, meet by anchor. Each is cut to what it can share with any other, aligned at the anchor
  (equal strings are), and a suffix array in linear grouping steps (:mod:`suffix_array`) over what remains tells which of its 200-byte strings occur twice.

An anchor with more than :data:`GROUP` different fragments is not brought to one task: the strings of its fragments are counted by their 128-bit digests.

Candidates are complete, so the result is exact up to collisions of two 64-bit hashes at once. All documents take part; a document is held whole only while
its own row is read.

Defined results: null and empty texts have 0 bytes and lose none; texts are bytes in UTF-8; rows that repeat are documents of their own, so each loses what
the other repeats; rows with null ids count as others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import cut, stored
from trajectree.llm.suffix_array import longest_shared, suffix_array

LENGTH = 200
ANCHOR = 64
#: String starts that are hashed at a time.
CHUNK = 1 << 18
#: Fragments of one anchor that a task compares; beyond, their strings are counted by digest over all tasks.
GROUP = 20_000
#: Symbols that one suffix array holds, about (a group of fragments stays together).
SYMBOLS = 1 << 16

_MULTIPLIER = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    np.multiply.accumulate(np.full(n - 1, base, np.uint64), out=out[1:])
    return out


_UP, _DOWN = (_powers(b, CHUNK + LENGTH + 1) for b in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def fragments(data: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hash, fragment hash, anchor position, and first and last string start of each fragment, chunk by chunk."""
    every = np.frombuffer(data, np.uint8)
    for base in range(0, len(data) - LENGTH + 1, CHUNK):
        part = every[base : base + CHUNK + LENGTH - 1]
        n = len(part)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTES[part] * _UP[:n], dtype=np.uint64)))
        grams = _mixed((sums[ANCHOR:] - sums[:-ANCHOR]) * _DOWN[: n - ANCHOR + 1])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        width, reach = LENGTH - ANCHOR + 1, 1
        while reach < width:
            step = min(reach, width - reach)
            least = np.minimum(least[:-step], least[step:])
            reach += step
        at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        at = at[first]
        whole = _mixed((sums[last + LENGTH] - sums[first]) * _DOWN[first]) ^ _mixed((at - first).astype(np.uint64) + np.uint64(1))
        yield grams[at].view(np.int64), whole.view(np.int64), at + base, first + base, last + base


def _shared_bits(a: int, b: int, length: int) -> int:
    """Leading bytes that two numbers of ``length`` bytes (big end first) share."""
    return length - ((a ^ b).bit_length() + 7) // 8


def _most_shared(parts: list[bytes]) -> list[int]:
    """For each string, the longest prefix it shares with another."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    most = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = min(len(parts[i]), len(parts[j]))
        same = _shared_bits(int.from_bytes(parts[i][:n]), int.from_bytes(parts[j][:n]), n)
        most[i], most[j] = max(most[i], same), max(most[j], same)
    return most


def cores(pieces: list[tuple[bytes, int]]) -> list[tuple[int, int]]:
    """For each (bytes, anchor offset), the range that it can share with any other, aligned at the anchor; empty if under LENGTH bytes."""
    right = _most_shared([b[p:] for b, p in pieces])
    left = _most_shared([b[:p][::-1] for b, p in pieces])
    return [(p - lo, p + hi) if lo + hi >= LENGTH else (p, p) for (_, p), lo, hi in zip(pieces, left, right)]


def repeated_starts(strings: list[tuple[bytes, bool]]) -> list[list[int]]:
    """For each (bytes, more than once), the starts of its LENGTH-byte strings that occur twice or more in all of them together."""
    m = len(strings)
    symbols: list[int] = []
    for k, (b, _) in enumerate(strings):
        symbols += [x + m + 1 for x in b]
        symbols.append(k + 1)
    symbols.append(0)
    shared, out, at = longest_shared(symbols, suffix_array(symbols)), [], 0
    for b, twice in strings:
        starts = range(len(b) - LENGTH + 1)
        out.append([i for i in starts if twice or shared[at + i] >= LENGTH])
        at += len(b) + 1
    return out


def _anchor_rows(docs: DataFrame, with_places: bool) -> DataFrame:
    names = ["anchor", "fragment", *(["doc_id", "text_id", "at", "first", "last"] if with_places else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple[np.ndarray, ...]] = []
            doc_ids, text_ids, rows = batch["doc_id"], batch["text_id"], 0

            def done() -> pa.RecordBatch:
                columns = [np.concatenate(c) for c in zip(*held)]
                of = pa.array(columns[0])
                arrays = [pa.array(columns[1]), pa.array(columns[2])]
                if with_places:
                    arrays += [doc_ids.take(of), text_ids.take(of), *(pa.array(c) for c in columns[3:])]
                held.clear()
                return pa.RecordBatch.from_arrays(arrays, names)

            for k, text in enumerate(batch["text"]):
                for found in fragments((text.as_py() or "").encode("utf-8", "surrogatepass")):
                    held.append((np.full(len(found[0]), k), *found))
                    rows += len(found[0])
                    if rows > 100_000:
                        yield done()
                        rows = 0
            if held:
                yield done()

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _bytes_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (with doc_id, text_id, at, first, last) with the bytes of each fragment."""
    rows = wanted.groupBy("doc_id", "text_id").agg(F.collect_list(F.struct("anchor", "fragment", "n", "at", "first", "last")).alias("wanted"))
    both = docs.join(rows, [docs["doc_id"].eqNullSafe(rows["doc_id"]), docs["text_id"] == rows["text_id"]]).select(docs["doc_id"], docs["text_id"], "text", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "text_id", "anchor", "fragment", "n", "at", "first", "bytes"]
        for batch in batches:
            rows = []
            for doc_id, text_id, text, wanted in zip(batch["doc_id"].to_pylist(), batch["text_id"].to_pylist(), batch["text"], batch["wanted"]):
                data = text.as_py().encode("utf-8", "surrogatepass")
                rows += [(doc_id, text_id, w["anchor"], w["fragment"], w["n"], w["at"] - w["first"], w["first"], data[w["first"] : w["last"] + LENGTH]) for w in wanted.as_py()]
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names)

    return both.mapInArrow(run, "doc_id long, text_id long, anchor long, fragment long, n long, at long, first long, bytes binary")


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of anchor; yields the repeated ranges of fragments that occur once."""
    names = ["doc_id", "text_id", "begin", "end"]
    held: dict[bytes, list] = {}
    spans: list[tuple] = []

    def settle() -> None:
        """Ask the suffix array about all cores held."""
        strings = list(held)
        starts = repeated_starts([(s, held[s][0] > 1) for s in strings])
        for s, found in zip(strings, starts):
            for doc_id, text_id, begin in held[s][1]:
                k = 0
                while k < len(found):
                    e = k
                    while e + 1 < len(found) and found[e + 1] == found[e] + 1:
                        e += 1
                    spans.append((doc_id, text_id, begin + found[k], begin + found[e] + LENGTH))
                    k = e + 1
        held.clear()

    def add(group: list[tuple]) -> None:
        ranges = cores([(g[7], g[5]) for g in group])
        by_core: dict[bytes, list] = defaultdict(lambda: [0, []])
        for g, (lo, hi) in zip(group, ranges):
            if hi > lo:
                entry = by_core[g[7][lo:hi]]
                entry[0] += g[4]
                if g[4] == 1:
                    entry[1].append((g[0], g[1], g[6] + lo))
        for core, (n, places) in by_core.items():
            if n > 1 and places:  # equal cores: all their strings repeat
                spans.extend((d, t, b, b + len(core)) for d, t, b in places)
        if any(n == 1 for n, _ in by_core.values()):
            for core, (n, places) in by_core.items():
                entry = held.setdefault(core, [0, []])
                entry[0] += n
                entry[1].extend(places if n == 1 else [])
        if sum(map(len, held)) > SYMBOLS:
            settle()

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*spans)], names)
        spans.clear()
        return out

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if group and group[0][2] != row[2]:
                add(group)
                group = []
            group.append(row)
        if spans:
            yield batch_of()
    if group:
        add(group)
    settle()
    if spans:
        yield batch_of()


def _by_digest(pieces: DataFrame) -> DataFrame:
    """Repeated strings of fragments, by counting digests: a string occurs twice if two fragments have it, or one that occurs twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text_id, _, _, n, _, first, data in zip(*(c.to_pylist() for c in batch.columns)):
                m = len(data) - LENGTH + 1
                digests = [hashlib.blake2b(data[k : k + LENGTH], digest_size=16).digest() for k in range(m)]
                columns = [pa.array(digests, pa.binary()), *(pa.array([x] * m, pa.int64()) for x in (doc_id, text_id, n)), pa.array(range(first, first + m), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["digest", "doc_id", "text_id", "n", "begin"])

    strings = pieces.mapInArrow(run, "digest binary, doc_id long, text_id long, n long, begin long")
    twice = strings.groupBy("digest").agg(F.sum("n").alias("total")).filter("total > 1").select("digest")
    return strings.filter("n = 1").join(twice, "digest", "left_semi").select("doc_id", "text_id", "begin", (F.col("begin") + LENGTH).alias("end"))


def repeated_spans(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """doc_id, text_id, begin and end of ranges of repeated bytes, overlapping in any way. docs: doc_id, text_id, text."""
    counts = _anchor_rows(docs, False).groupBy("anchor", "fragment").agg(F.count("*").alias("n"))
    totals = counts.groupBy("anchor").agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).filter("total > 1")
    shared = cut(counts.join(totals, "anchor").select("anchor", "fragment", "n", (F.col("kinds") > 1).alias("open"), (F.col("kinds") > most).alias("large")))
    rows = stored(_anchor_rows(docs, True).join(shared, ["anchor", "fragment"]))
    settled = rows.filter("n > 1").select("doc_id", "text_id", F.col("first").alias("begin"), (F.col("last") + LENGTH).alias("end"))
    place = F.struct("doc_id", "text_id", "at", "first", "last")
    wanted = rows.filter("open").groupBy("anchor", "fragment", "n", "large").agg(F.min(place).alias("place"))
    wanted = stored(wanted.select("anchor", "fragment", "n", "large", "place.*"))
    large = wanted.filter("large").drop("large")
    if not large.isEmpty():  # else the texts would be dealt out once more for nothing
        settled = settled.union(_by_digest(_bytes_of(docs, large)))
    pieces = _bytes_of(docs, wanted.filter("not large").drop("large")).repartition("anchor").sortWithinPartitions("anchor", "fragment")
    # Rows that repeat have the same key, so a fragment of theirs occurs more than once and is settled.
    return settled.union(pieces.mapInArrow(_compare, "doc_id long, text_id long, begin long, end long"))


def remaining(docs: DataFrame, most: int = GROUP) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    spans = repeated_spans(docs, most).groupBy("doc_id", "text_id").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))  # repeated rows give equal spans
    both = docs.join(spans, [docs["doc_id"].eqNullSafe(spans["doc_id"]), docs["text_id"] == spans["text_id"]], "left").select(docs["doc_id"], "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"].to_pylist(), batch["text"], batch["spans"]):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                if not spans.is_valid:
                    rows.append((doc_id, len(data), 0, 0, hashlib.sha256(data).hexdigest()))
                    continue
                flat = spans.values.flatten()
                begin, end = (x.to_numpy() for x in flat)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order])
                new = np.concatenate(([True], begin[1:] > end[:-1]))
                begin, end = begin[new], end[np.concatenate((np.flatnonzero(new)[1:], [len(new)])) - 1]
                digest, at = hashlib.sha256(), 0
                for b, e in zip(begin.tolist(), end.tolist()):
                    digest.update(data[at:b])
                    at = e
                digest.update(data[at:])
                rows.append((doc_id, len(data), int((end - begin).sum()), len(begin), digest.hexdigest()))
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
