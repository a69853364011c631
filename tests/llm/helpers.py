"""Small tables and plain versions that the operators are held against."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int, vocabulary: int = 400) -> str:
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}x" for _ in range(n))


def documents(spark, rows):
    """rows: (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCUMENTS)


def odd_rows():
    """Nulls, empty, blank, very short and long texts, ties, copies, and repeated rows."""
    long = words(30_000, 1, 5000)
    return [
        (1, None, "en", "a"), (2, "", "en", None), (3, " \t\n\x0b ", None, "b"), (4, "one", "en", "a"), (5, "One", "de", "a"), (6, long, "en", "a"),
        (7, long, "en", "b"), (8, long.replace("w7x", "w8x", 1), "en", None), (None, "no id at all", "fr", "a"), (9, "Zéro été ñandú 123 \U0001f600", "fr", "c"),
        (10, words(120, 2), "en", "a"), (10, words(120, 2), "en", "a"), (11, words(120, 2), "en", "c"), (-5, words(60, 3), "es", "b"),
    ]


def components(nodes, links):
    """Least node that each reaches."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}
