"""What the mix takes, against a plain queue of words: every copy's words in one sorted list, cut at the budget."""

import math
from collections import Counter, defaultdict

import pytest

from tests.llm.helpers import documents, odd_rows
from trajectree.llm import mixing


def plain_served(rows, epochs=3):
    size, target = Counter(), {}
    for r in rows:
        size[r["source"]] += r["_size"]
        target[r["source"]] = r["target"]
    words = [((k + 1) / target[s], s is None, s or "", k) for s in size for k in range(epochs * size[s])]
    cut = sum(math.floor(t) for t in target.values())
    got = Counter()
    for _, null, s, _ in sorted(words)[:cut]:
        got[None if null else s] += 1
    return got, size


def lengths(n, source):
    return [(k, " ".join(["w"] * ((k * 7) % 13)), "en", source, 0) for k in range(n)]


CASES = {"odd": odd_rows, "hot": lambda: lengths(300, "a") + [(1000 + k, "x y z", "en", s, 0) for k, s in enumerate(["b", None, "c", "b", ""])]}


@pytest.mark.parametrize("case", CASES)
def test_taken_follows_the_order_of_words(spark, case):
    rows = mixing.plan(documents(spark, CASES[case]()).select("doc_id", "source", "text")).collect()
    want, size = plain_served(rows)
    starts = defaultdict(list)
    for r in rows:
        starts[r["source"]].append((r["_start"], r["_size"]))
        taken = sum(max(0, min(r["_size"], want[r["source"]] - e * size[r["source"]] - r["_start"])) for e in range(3))
        assert r["taken"] == taken, r["doc_id"]
    for s, places in starts.items():  # the documents of a source lie end to end
        ends = sorted(p for p in places if p[1])
        assert all(a[0] + a[1] == b[0] for a, b in zip(ends, ends[1:])) and sum(n for _, n in ends) == size[s]


def test_empty_order(spark):
    assert mixing.plan(documents(spark, [])).count() == 0
    assert mixing.plan(documents(spark, [(1, None, None, None, None), (2, "  ", "en", "a", 0)])).select("taken").distinct().collect() == [(0,)]


@pytest.mark.parametrize("few", [1, 50])
def test_word_at_the_cut(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_WORDS", few)
    targets = [10.0, 7.3, 400.25, 10.0, 1e9 + 0.5, 3.0]
    copies = [(f"s{k}", False, t, b, n, (b + n) / t) for k, t in enumerate(targets) for b, n in ((int(t * 0.7), 40), (int(t * 0.7) + 40, 1), (int(t * 0.7) + 41, 200))]
    near = spark.createDataFrame(copies, "_source string, _no_source boolean, target double, _begin long, _words long, _finish double").cache()
    finish = sorted((b + j + 1) / t for _, _, t, b, n, _ in copies for j in range(n))
    for total in (1, 2, 3, 77, len(finish) // 2, len(finish) - 1, len(finish)):
        assert mixing._last_word(near, total) == finish[total - 1]
    assert mixing._last_word(near, 0) == 0 and mixing._last_word(near, len(finish) + 1) == math.inf
    for time in (0.0, 0.71, 1.0, finish[40], finish[-1], math.inf):
        got = near.select(mixing._words_by(mixing.F.lit(time)).alias("n")).collect()
        assert [r["n"] for r in got] == [sum((b + j + 1) / t <= time for j in range(n)) for _, _, t, b, n, _ in copies]
