"""Packing by vector bin packing with the dot-product heuristic.

A sequence has three limits at once: tokens, segments, and loss-bearing tokens. A document that fills whole sequences does so; what remains of it waits in
a pool of bounded size. A bin takes, again and again, the waiting piece that fits and whose demand has the largest dot product with what the bin has left
(each part as a share of its limit); when none fits, the best piece is cut to what is left. So a sequence has padding only when the limit on segments or
loss-bearing tokens stops it, or at the end of a partition.

Each partition of the input packs its own documents: nothing is shuffled, and a task holds one batch and the pool. A sequence's number is its partition's
number and its place there, so it is the same when a task is run again.

Defined results: null text is empty; every document ends with the id 0, so an empty one has that id alone; repeated rows are packed each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.tokens import default_path, encoder

END = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class Piece:
    doc_id: int | None
    ids: np.ndarray
    start: int
    doc_tokens: int
    #: The first ids of a document that bear no loss (its prompt).
    prompt: int = 1

    def demand(self) -> tuple[int, int, int]:
        return len(self.ids), 1, self.loss(len(self.ids))

    def loss(self, length: int) -> int:
        return max(0, self.start + length - max(self.start, self.prompt))

    def fitting(self, tokens: int, loss_tokens: int) -> int:
        """The most leading ids that meet both limits."""
        return min(len(self.ids), tokens, max(0, self.prompt - self.start) + loss_tokens)

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc_id, self.ids[:at], self.start, self.doc_tokens, self.prompt),
            Piece(self.doc_id, self.ids[at:], self.start + at, self.doc_tokens, self.prompt),
        )


@dataclass
class Packer:
    limits: Limits
    first: int
    pool_size: int = 256
    pool: list[Piece] = field(default_factory=list)
    packed: int = 0

    def add(self, piece: Piece) -> Iterator[tuple]:
        """Rows of the sequences that this piece fills."""
        whole = min(self.limits.tokens, piece.fitting(self.limits.tokens, self.limits.loss_tokens))
        while len(piece.ids) > self.limits.tokens or len(piece.ids) == whole == self.limits.tokens:
            head, piece = piece.cut(whole)
            yield from self._rows([head])
            if not len(piece.ids):
                return
            whole = min(self.limits.tokens, piece.fitting(self.limits.tokens, self.limits.loss_tokens))
        self.pool.append(piece)
        while len(self.pool) >= self.pool_size:
            yield from self._rows(self._bin())

    def finish(self) -> Iterator[tuple]:
        while self.pool:
            yield from self._rows(self._bin())

    def _bin(self) -> list[Piece]:
        limit, taken = self.limits.vector(), []
        left = limit.copy()
        demands = np.array([p.demand() for p in self.pool], float)
        waiting = np.ones(len(self.pool), bool)
        rest: list[Piece] = []
        while left[0] > 0 and left[1] > 0 and waiting.any():
            value = (demands / limit) @ (left / limit)
            fits = waiting & (demands <= left).all(1)
            best = int(np.argmax(np.where(fits if fits.any() else waiting, value, -1)))
            piece = self.pool[best]
            if not fits[best]:
                at = piece.fitting(int(left[0]), int(left[2]))
                if at <= 0:
                    break
                piece, tail = piece.cut(at)
                rest.append(tail)
            waiting[best] = False
            taken.append(piece)
            left -= piece.demand()
        self.pool = [p for p, w in zip(self.pool, waiting) if w] + rest
        return taken

    def _rows(self, pieces: list[Piece]) -> Iterator[tuple]:
        offset = 0
        for p in pieces:
            crc = zlib.crc32(np.ascontiguousarray(p.ids, "<u4").tobytes())
            yield p.doc_id, p.start, len(p.ids), crc, p.doc_tokens, self.first + self.packed, offset, p.loss(len(p.ids))
            offset += len(p.ids)
        self.packed += 1


def pack(docs: DataFrame, limits: Limits = Limits(), path: str | None = None, prompt: str | None = None) -> DataFrame:
    """A row for each piece of each document (doc_id, text), see :data:`SCHEMA`.

    prompt: a column with the number of leading ids of each document that bear no loss (null, or no such column: the first only).
    """
    path = path or default_path()
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(path), Packer(limits, TaskContext.get().partitionId() << 32)
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text, silent in zip(batch["doc_id"].to_pylist(), batch["text"], batch["_prompt"].to_pylist()):
                ids = np.array([*encode.ids(text.as_py() or ""), END], "<u4")
                rows.extend(packer.add(Piece(doc_id, ids, 0, len(ids), silent)))
                if len(rows) > 10_000:
                    yield batch_of()
        rows.extend(packer.finish())
        if rows:
            yield batch_of()

    silent = F.coalesce(F.col(prompt).cast("long") if prompt else F.lit(None).cast("long"), F.lit(1).cast("long"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", silent.alias("_prompt")).mapInArrow(run, SCHEMA)
