"""Token counts that follow edits: only what an edit touches is encoded again.

A document keeps a segment tree over blocks of its pre-tokens: a leaf has the lengths of its pre-tokens, their characters and their ids; an inner node the
sums of its children. An edit replaces a range of characters. Pre-tokens are matched from left to right and look at most two characters ahead, or as far as the
string of a special token goes (:attr:`Encoder.reach`). So the text is split again from the pre-token that holds the character that far before the edit, with as
many characters of context behind it, until a boundary after the edit falls on an old one; from there on nothing changes. The leaves touched are replaced and
the sums on their paths to the root updated. Pre-tokens are the tokenizer's own for every script.

Each row is counted on its own, so any split of the table into tasks works, and nothing is shuffled.

Defined results: null text has 0 tokens and no edits; overlapping edits, and edits out of the text's range, raise an error; the string of a special token
is that token, also where an edit makes it; repeated rows are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trajectree.llm.tokens import Encoder, default_path, encoder

#: Pre-tokens in a leaf.
LEAF = 64
Edit = tuple[int, int, str]

#: What the query masks: addresses of electronic mail, and runs of four digits or more.
MASKED = re.compile(r"(?<![^\s@])[^\s@]+@[^\s@]+|\d{4,}")


def mask_personal(text: str) -> list[Edit]:
    """Edits that mask e-mail addresses and long numbers."""
    if "@" not in text and not re.search(r"\d{4}", text):
        return []
    return [(m.start(), m.end(), "[email]" if "@" in m[0] else "[number]") for m in MASKED.finditer(text)]


class Tree:
    """The segment tree of one text."""

    def __init__(self, text: str, encode: Encoder):
        self.encode, self.encoded_chars = encode, len(text)
        pieces = encode.split(text)
        self.leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)] or [[]]
        self.size = 1 << (len(self.leaves) - 1).bit_length()
        self.chars = np.zeros(2 * self.size, np.int64)
        self.ids = np.zeros(2 * self.size, np.int64)
        for k, leaf in enumerate(self.leaves):
            self.chars[self.size + k], self.ids[self.size + k] = sum(map(len, leaf)), sum(map(encode.count, leaf))
        level = self.size
        while level > 1:
            for sums in (self.chars, self.ids):
                sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2).sum(1)
            level //= 2

    @property
    def count(self) -> int:
        return int(self.ids[1])

    def _leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf. The end of the text is in the last leaf that has any."""
        node, before = 1, 0
        if char >= self.chars[1]:
            char = max(0, int(self.chars[1]) - 1)
        while node < self.size:
            node *= 2
            if char - before >= self.chars[node]:
                before += int(self.chars[node])
                node += 1
        return node - self.size, before

    def _put(self, leaf: int, pieces: list[str]) -> None:
        self.leaves[leaf] = pieces
        node = self.size + leaf
        chars, ids = sum(map(len, pieces)), sum(map(self.encode.count, pieces))
        more = chars - self.chars[node], ids - self.ids[node]
        while node:
            self.chars[node] += more[0]
            self.ids[node] += more[1]
            node //= 2

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace the characters from start to end (in the text as it is now)."""
        if not 0 <= start <= end <= self.chars[1]:
            raise ValueError(f"no such range: {start} to {end}")
        reach = self.encode.reach
        leaf, at = self._leaf_at(max(0, start - reach))
        window, last, stay = list(self.leaves[leaf]), leaf, 0
        # Pre-tokens that end out of reach before the edit stay.
        while stay < len(window) and at + len(window[stay]) <= start - reach:
            at += len(window[stay])
            stay += 1
        kept, window, taken, upto = window[:stay], window[stay:], 0, at

        def another(more: int = 0) -> bool:
            nonlocal last
            while taken + more >= len(window) and last + 1 < len(self.leaves):
                last += 1
                window.extend(self.leaves[last])
            return taken + more < len(window)

        while upto < end and another():
            upto += len(window[taken])
            taken += 1
        while True:
            old = "".join(window[:taken])
            text = old[: start - at] + new + old[end - at :]
            # Pre-tokens behind it as context: the end of the text is a boundary only if what follows leaves it so.
            context, more = "", 0
            while len(context) < reach and another(more):
                context += window[taken + more]
                more += 1
            split, length = [], 0
            for piece in self.encode.split(text + context):
                if length >= len(text):
                    break
                split.append(piece)
                length += len(piece)
            if length == len(text):
                break
            taken += 1
        self.encoded_chars += len(text)
        rest = window[taken:]
        self._put(leaf, kept + split + (rest if last == leaf else []))
        for k in range(leaf + 1, last + 1):
            self._put(k, rest if k == last else [])


def counts(text: str | None, edits: list[Edit], encode: Encoder) -> tuple[int, int, int, int]:
    """Tokens before and after the edits, the number of edits, and the characters encoded for all that."""
    text = text or ""
    edits = sorted(edits)
    if any(a[1] > b[0] for a, b in zip(edits, edits[1:])):
        raise ValueError("edits overlap")
    tree = Tree(text, encode)
    before = tree.count
    for start, end, new in reversed(edits):
        tree.replace(start, end, new)
    return before, tree.count, len(edits), tree.encoded_chars


def edited_counts(docs: DataFrame, edits_of: Callable[[str], list[Edit]] = mask_personal, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, n_edits and encoded_chars of every row of docs (doc_id, text)."""
    path = path or default_path()
    names = ["n_tokens", "n_tokens_edited", "n_edits", "encoded_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows = [counts(t, edits_of(t) if t else [], encode) for t in (x.as_py() for x in batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))
