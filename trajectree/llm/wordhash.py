"""Hashes of all words of a text at once, in numpy, for what reads whole texts in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that are hashed at a time, and up to the end of a word that reaches beyond.
CHUNK = 1 << 17

_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True
#: The leading bytes of an eight-byte block that belong to a word, by their number.
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def _spans(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and end of each word."""
    blank = np.concatenate(([True], _BLANK[part], [True]))
    edges = np.flatnonzero(blank[1:] != blank[:-1])
    return edges[::2], edges[1::2]


def _hashed(part: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each word, eight bytes at a time; ``part`` has eight bytes more than its words reach."""
    blocks = np.ndarray(len(part) - 7, "<u8", part.data, strides=(1,))
    length = end - first
    h = mixed((blocks[first] & _MASKS[np.minimum(length, 8)]) + length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    rest = np.flatnonzero(length > 8)
    done = 8
    while len(rest):
        h[rest] = mixed(h[rest] ^ (blocks[first[rest] + done] & _MASKS[np.minimum(length[rest] - done, 8)]))
        done += 8
        rest = rest[length[rest] > done]
    return h


def word_hashes(data: bytes | pa.Buffer) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit hash of each word of some bytes in order, the number of line feeds before it, and the places of the line feeds."""
    every = np.concatenate((np.frombuffer(data, np.uint8), np.zeros(8, np.uint8)))
    hashes, lines, breaks, base, size, seen = [], [], [], 0, len(every) - 8, 0
    while base < size:
        stop = min(base + CHUNK, size)
        if stop < size:
            blanks = np.flatnonzero(_BLANK[every[base:stop]])
            if len(blanks):
                stop = base + int(blanks[-1]) + 1
            else:  # a word that reaches beyond the chunk
                rest = np.flatnonzero(_BLANK[every[stop:size]])
                stop = stop + int(rest[0]) if len(rest) else size
        part = every[base:stop]
        first, end = _spans(part)
        feeds = np.flatnonzero(part == 0x0A)
        before = np.searchsorted(first, feeds)
        hashes.append(_hashed(every[base : stop + 8], first, end))
        lines.append(np.repeat(np.arange(seen, seen + len(feeds) + 1), np.diff(np.concatenate(([0], before, [len(first)])))))
        breaks.append(feeds + base)
        seen += len(feeds)
        base = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(lines), np.concatenate(breaks)


def joined(texts: pa.Array) -> Iterator[tuple[int, pa.Buffer, np.ndarray]]:
    """The texts of a batch (null: empty), some at a time: the number of the first, their bytes joined by line feeds, and where each begins."""
    if not len(texts):
        return
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64) + 1)
    # A piece ends where the next text would pass the chunk; a long text is a piece of its own.
    first = [0]
    while first[-1] < len(texts):
        before = ends[first[-1] - 1] if first[-1] else 0
        first.append(max(first[-1] + 1, int(np.searchsorted(ends, before + CHUNK, side="right"))))
    pieces = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.array(first, np.int32)), texts), "\n")
    for k, (a, b) in enumerate(zip(first, first[1:])):
        yield a, pieces[k].as_buffer(), np.concatenate(([0], ends[a : b - 1] - (ends[a - 1] if a else 0)))
