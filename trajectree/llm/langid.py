"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased; n-grams of one to three code points are hashed into a fixed number of buckets. Training sums bucket counts per language over
every labelled row in Spark; the log-probability matrix (languages x buckets, a size fixed by parameters) goes to the tasks, which score whole texts in
numpy, as a product of the batch's sparse counts and the matrix. More than :data:`MOST_LANGUAGES` languages are scored in blocks of so many, one after the
other, with the best and the sum carried along. The score is the posterior of the evidence a character has on average, so it doesn't end at 1 for any long text.

Defined results: null text, or a text without a letter, is ``und`` with score 0; so is every text if nothing was learned. Rows with null language are not
learned from. Equal scores go to the first language by code point. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajectree.llm.common import cut

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
#: Texts are hashed in pieces of so many code points, so a task's memory doesn't follow the longest text.
PIECE = 1 << 18
#: Languages in one matrix; beyond, there are several.
MOST_LANGUAGES = 200
#: Log probabilities that one sparse product holds, about: counts times languages.
CELLS = 1 << 22
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    """The rows that are never learned from: crc32 of the id as text, mod 4, is 2; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 4 == 2


def buckets(text: str) -> np.ndarray:
    """Counts of a text's hashed n-grams."""
    counts = np.zeros(BUCKETS, np.int64)
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    longest = max(ORDERS)
    for at in range(0, len(codes), PIECE):
        piece = codes[at : at + PIECE + longest - 1]
        key = np.zeros(len(piece), np.uint64)
        for n in range(1, longest + 1):
            if len(piece) < n:
                break
            key = (key[: len(piece) - n + 1] * np.uint64(0x110000)) + piece[n - 1 :] + np.uint64(1)
            if n in ORDERS:
                starts = key[:PIECE]
                counts += np.bincount(((starts + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50), minlength=BUCKETS)
    return counts


def has_letter(text: str) -> bool:
    return any(c.isalpha() or unicodedata.category(c)[0] == "L" for c in text)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"]):
            if lang not in sums:
                sums[lang] = np.zeros(BUCKETS, np.int64)
            sums[lang] += buckets(text.as_py())
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


@dataclass(frozen=True)
class Block:
    """Some languages: log probabilities (buckets x languages) and log priors."""

    languages: list[str]
    matrix: np.ndarray
    prior: np.ndarray

    def logs(self, counts: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Texts x languages: log prior and log likelihood of each text's counts (buckets that have any, and how many)."""
        begin = np.cumsum([0, *(len(at) for at, _ in counts[:-1])])
        columns, values = (np.concatenate(x) for x in zip(*counts))
        return np.add.reduceat(self.matrix[columns] * values[:, None], begin, axis=0) + self.prior


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: Log priors, and the counts of the training rows (lang, bucket, n).
    prior: dict[str, float]
    counts: DataFrame
    smoothing: float

    def blocks(self, most: int) -> Iterator[Block]:
        """The languages in code-point order, so many at a time; only one block's counts are gathered at a time."""
        for first in range(0, len(self.languages), most):
            mine = self.languages[first : first + most]
            rows = self.counts.filter(F.col("lang").isin(mine)).toArrow()
            place = {x: i for i, x in enumerate(mine)}
            sums = np.zeros((BUCKETS, len(mine)))
            sums[rows["bucket"].to_numpy(), [place[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
            matrix = np.log(sums + self.smoothing) - np.log((sums + self.smoothing).sum(0))
            yield Block(mine, matrix, np.array([self.prior[x] for x in mine]))


def train(docs: DataFrame, smoothing: float = 1.0) -> Model:
    """The model of all rows of ``docs`` (text, lang) that have both."""
    known = docs.select("text", "lang").filter("text is not null and lang is not null")
    counts = cut(known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    per_lang = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = max(1, sum(per_lang.values()))
    return Model(sorted(per_lang), {x: float(np.log(n / total)) for x, n in per_lang.items()}, counts, smoothing)


def _scorer(shared):
    """Adds a block's languages to what earlier blocks found: the best, its log, and the sum of all relative to it (logs are per character)."""

    def texts(batch: pa.RecordBatch, most: int) -> Iterator[tuple[list[int], list[tuple[np.ndarray, np.ndarray]], list[int]]]:
        """Texts with a letter, some at a time: their rows, counts and lengths."""
        rows, counts, lengths, held = [], [], [], 0
        for k, text in enumerate(batch["text"]):
            said = text.as_py()
            if said is None or not has_letter(said):
                continue
            rows.append(k)
            dense = buckets(said)
            at = np.flatnonzero(dense)
            counts.append((at, dense[at]))
            lengths.append(len(said))
            held += len(at)
            if held > most:
                yield rows, counts, lengths
                rows, counts, lengths, held = [], [], [], 0
        if rows:
            yield rows, counts, lengths

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        names = np.array(block.languages, object)
        for batch in batches:
            best = np.array(batch["lang_pred"].to_pylist(), object)
            log, total = (batch[c].to_numpy().copy() for c in ("_log", "_sum"))
            for rows, counts, lengths in texts(batch, CELLS // len(names)):
                logs = block.logs(counts) / np.array(lengths)[:, None]
                top = logs.max(1)
                sums, at = np.exp(logs - top[:, None]).sum(1), np.array(rows)
                new = top > log[at]
                both = np.maximum(top, log[at])
                total[at] = total[at] * np.exp(log[at] - both) + sums * np.exp(top - both)
                best[at[new]] = names[logs.argmax(1)[new]]
                log[at] = both
            done = [pa.array(best, pa.string()), pa.array(log), pa.array(total)]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], batch["text"], *done], ["doc_id", "held_out", "text", "lang_pred", "_log", "_sum"])

    return score


def identify(docs: DataFrame, model: Model, most: int = MOST_LANGUAGES) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row; only the text is looked at for the prediction."""
    start = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(float("-inf")).alias("_log"), F.lit(0.0).alias("_sum")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text", *start)
    for block in model.blocks(most):
        shared = docs.sparkSession.sparkContext.broadcast(block)
        rows = rows.mapInArrow(_scorer(shared), "doc_id long, held_out boolean, text string, lang_pred string, _log double, _sum double")
    return rows.select("doc_id", "held_out", "lang_pred", F.when(F.col("_sum") > 0, 1 / F.col("_sum")).otherwise(0.0).alias("score"))
