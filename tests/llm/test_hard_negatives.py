"""Hard negatives against plain integers, and residue products against wide arithmetic."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trajectree.llm import hard_negatives
from trajectree.llm.residues import primes_for, products

VECTORS = "vec_id long, embedding array<float>, label int, score string"


@pytest.mark.parametrize("reach, width", [(0, 3), (1, 1), (200, 64), (200, 3000), (30_000, 64), (10**8, 5), (2 * 10**9, 1)])
def test_products_are_exact(reach, width):
    rng = np.random.default_rng(width)
    x, y = rng.integers(-reach, reach + 1, (7, width)), rng.integers(-reach, reach + 1, (9, width))
    x[0] = y[0] = reach
    x[1] = -reach
    want = x.astype(object) @ y.astype(object).T
    assert (products(x, y, width * reach * reach) == want).all()
    assert np.prod([float(p) for p in primes_for(reach)]) > 2 * reach + 1


@pytest.mark.parametrize("bound", [1 << 20, 1 << 61])
def test_first_takes_earlier_columns_of_equal_scores(bound):
    scores = np.array([[3, 5, 5, 1, 5], [0, 0, 0, 0, 0]])
    allowed = np.array([[1, 1, 0, 1, 1], [0, 1, 1, 1, 0]], bool)
    got = set(zip(*map(np.ndarray.tolist, hard_negatives.first(scores, allowed, 2, bound))))
    assert got == {(0, 1), (0, 4), (1, 1), (1, 2)}
    assert len(hard_negatives.first(scores, allowed & False, 2, bound)[0]) == 0


def plain(rows):
    usable = []
    for vec_id, vector, label, *_ in rows:
        if vec_id is not None and label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            usable.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(np.float32(x))) for x in vector)))
    out = []
    for anchor, label, v in set(x for x in usable if x[0] % 100 == 0):
        scored = sorted((-sum(a * b for a, b in zip(v, w)), d, k) for d, k, w in usable if len(w) == len(v))
        for p, d, _ in [x for x in scored if x[2] == label and x[1] != anchor][:5]:
            picked = [x for x in scored if x[2] != label and 30 * -p <= 100 * -x[0] <= 90 * -p][:10]
            out += [(anchor, d, rank, x[1], -p, -x[0]) for rank, x in enumerate(picked, 1)]
    return sorted(out)


def got(spark, rows, **limits):
    df = hard_negatives.mined(hard_negatives.quantized(spark.createDataFrame(rows, VECTORS)), F.col("vec_id") % 100 == 0)
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


def some(n, width=6, seed=1):
    rng = random.Random(seed)
    return [(k, [rng.gauss(0, 0.3) + 0.3 for _ in range(width)], rng.randrange(10), "s") for k in range(n)]


def odd():
    nan, inf = float("nan"), float("inf")
    same = [0.5, 0.25, -0.125, 0.5, 0.1, 0.0]
    rows = [(1000, None, 1, "s"), (1100, [], 1, "s"), (1101, [], 1, "s"), (1102, [], 2, "s"), (1200, [0.5, nan], 1, "s"), (1201, [inf, 0.5], 1, "s"), (1202, [None, 0.5], 1, "s"), (None, same, 1, "s")]
    rows += [(1300, same, None, "s"), (1400, same, 3, "s"), (1400, same, 3, "s"), (1401, same, 3, None), (1402, same, 3, "s"), (1402, same, 3, "s"), (1500, [0.0] * 6, 4, "s"), (1600, [-1.0] * 6, 5, "s"), (1700, [0.5, 0.5], 6, "s")]
    rows += [(k, [x * 0.6 for x in same], 7, "s") for k in range(2001, 2030)] + [(-700, same, 9, "s"), (-300, same, 3, "s"), (2100, [1e5] * 6, 8, "s"), (2101, [1e5] * 6, 8, "s")]
    return rows


def test_against_plain_integers(spark, monkeypatch):
    rows = some(520) + odd()
    want = plain(rows)
    assert got(spark, rows) == want and len(want) > 300
    for name, value in (("ANCHORS", 2), ("COMPONENTS", 700), ("CHUNK", 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    assert got(spark, rows) == want


def test_empty_and_too_large(spark):
    assert got(spark, []) == [] and got(spark, [(1, [0.5], 1, "s")]) == [] and got(spark, [(0, None, 1, "s")]) == []
    with pytest.raises(OverflowError):
        got(spark, [(0, [3e30], 1, "s"), (1, [0.5], 1, "s")])
