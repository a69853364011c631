"""The audit against every order played through row by row."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_rows, words
from trajectree.llm import filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(rows, labels):
    first, out = {}, Counter()
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            first[text or ""] = min(first.get(text or "", doc_id), doc_id)
    good, toxic = ({d for d, *marks in labels if marks[k] == 1 and d is not None} for k in (0, 1))
    shapley = Counter()
    for row in rows:
        doc_id, text, part = row[0], row[1] or "", (row[3] if len(row) > 3 else "s") or ""
        found = WORD.findall(text)
        fails = {
            "A": len(found) < 50, "B": 100 * len(set(found)) < 65 * len(found), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": re.search("[#$%&*|]", text) is not None, "E": doc_id is not None and text in first and doc_id > first[text],
        }
        for order in itertools.permutations("ABCDE"):
            there, name = True, "".join(order)
            for step, f in enumerate(order, 1):
                key = (part, name, step)
                gone = there and fails[f]
                out[key, "removed"] += gone
                out[key, "redundant"] += fails[f] and not there
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[key, "good_lost"] += gone and doc_id in good
                out[key, "toxic_lost"] += gone and doc_id in toxic
                shapley[part, f] += gone
                there = there and not fails[f]
                out[key, "kept"] += there
    keys = {k for k, _ in out}
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return sorted((*k, *(out[k, n] for n in names), shapley[k[0], k[1][k[2] - 1]]) for k in keys)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(10, 1, 0), (10, 0, 1), (11, 1, None), (6, None, 1), (None, 1, 1), (4, 0, 0), (30, 1, 1), (999, 1, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def mixed(n):
    rng, out = random.Random(7), odd_rows()
    for k in range(30, 30 + n):
        text = words(rng.choice([20, 60, 80]), rng.randrange(12), rng.choice([30, 5000]))
        out.append((k, rng.choice([str.upper, str])(text) + rng.choice(["", " #"]), "en", rng.choice(["a", "b", None, ""])))
    return out


def test_every_order(spark, labels):
    rows = mixed(150)
    docs = documents(spark, rows).withColumnRenamed("n_chars", "fails").withColumnRenamed("lang", "part")
    assert rows_of(filter_audit.audit(docs.repartition(3), labels[1])) == plain(rows, labels[0])


def test_blocks_and_ranges_dont_matter(spark, labels, monkeypatch):
    rows = mixed(60)
    monkeypatch.setattr(filter_audit, "RANGE", 5)
    rng = np.random.default_rng(2)
    fails, good, toxic = rng.integers(0, 32, 300), rng.random(300) < 0.3, rng.random(300) < 0.2
    lists = [np.flatnonzero(fails >> f & 1) for f in range(5)]
    got = filter_audit.sizes(lists, np.flatnonzero(good), np.flatnonzero(toxic), 300)
    for k, (mask, f) in enumerate(filter_audit.PAIRS):
        gone = (fails >> f & 1 == 1) & (fails & mask == 0)
        assert got[k].tolist() == [gone.sum(), (gone & good).sum(), (gone & toxic).sum()]
    docs = documents(spark, rows)
    assert rows_of(filter_audit.audit(docs.repartition(1), labels[1])) == rows_of(filter_audit.audit(docs.repartition(9), labels[1])) == plain(rows, labels[0])


def test_gallop():
    ids = np.array([1, 4, 4, 9, 12, 40, 41, 42, 99])
    for at in range(len(ids)):
        for bound in range(110):
            assert filter_audit.gallop(ids, bound, at) == max(at, int(np.searchsorted(ids, bound)))


def test_empty(spark, labels):
    assert filter_audit.audit(documents(spark, []), labels[1]).collect() == []
    got = rows_of(filter_audit.audit(documents(spark, odd_rows()), labels[1].limit(0)))
    assert got == plain(odd_rows(), []) and len({r[0] for r in got}) * 600 == len(got)
