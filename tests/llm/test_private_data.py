"""Personal data against the patterns as written, and the field against sums over all labellings."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tests.llm.helpers import documents, odd_rows
from trajectree.llm import private_data
from trajectree.llm.private_data import KINDS, added_spans, base_spans
from trajectree.llm.skip_chain import Graph, Model, marginals, train

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
CALLS = "call +1 (171) 555-2028 now. later dial 171 555 2028, or (171) 555-2028 please. page 171, year 2028, room 555"


def plain_luhn(digits):
    return sum(sum(divmod(int(x) * (2 - (k + len(digits)) % 2), 10)) if (k + len(digits)) % 2 == 0 else int(x) for k, x in enumerate(digits)) % 10 == 0


def plain_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and plain_luhn(digits), "phone": 9 <= len(digits) <= 15}
            if fits[kind]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


@pytest.fixture(scope="module")
def model(spark):
    return private_data.trained(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))


def test_patterns():
    rng = random.Random(3)
    for letters, most in (("a1@.+-_% ()2é3", 40), ("1234 -+.", 60), ("ab@.", 30), ("0123456789", 40)):
        for _ in range(4000):
            text = "".join(rng.choice(letters) for _ in range(rng.randrange(most)))
            assert base_spans(text) == plain_spans(text), text
    assert base_spans("a@b.c_d@e.f 4111 1111 1111 1111 1.2.3.4.5.6.7.8 256.1.1.1") == plain_spans("a@b.c_d@e.f 4111 1111 1111 1111 1.2.3.4.5.6.7.8 256.1.1.1")


@pytest.mark.parametrize("text", ["1" * 200_000 + "..", "a" * 200_000 + "@", "a@" * 50_000, "+1" + " " * 200_000, "1.1.1." * 30_000 + "..", "1" * 100_000 + ".1" * 50_000])
def test_very_long_texts(text):
    for begin, kind, end in base_spans(text)[:3]:
        assert re.fullmatch(PATTERNS[KINDS[kind]], text[begin:end])
    private_data.tokens(text)


def test_messages_are_exact_on_trees_and_close_on_loops():
    rng = np.random.default_rng(5)
    for skip, slack in (([(0, 3)], 1e-3), ([(0, 2), (2, 4)], 0.12)):
        m = Model(rng.normal(size=(8, 3)), rng.normal(size=(3, 3)), 0.5 * np.eye(3))
        chain = [(0, 1), (1, 2), (3, 4)]
        g = Graph(5, list(range(5)), list(range(5)), chain, skip, [-1, -1, 1, -1, -1])
        total = np.zeros((5, 3))
        for y in itertools.product(range(3), repeat=5):
            if y[2] == 1:
                weight = np.exp(sum(m.node[i, y[i]] for i in range(5) if i != 2) + sum(m.chain[y[a], y[b]] for a, b in chain) + sum(m.skip[y[a], y[b]] for a, b in skip))
                for i in range(5):
                    total[i, y[i]] += weight
        assert np.allclose(marginals(g, m), total / total.sum(1, keepdims=True), atol=slack)


def test_training_separates_labels():
    g = Graph(40, [k % 2 for k in range(40)], list(range(40)), [], [], [k % 2 for k in range(40)])
    m = train(g, 2)
    got = marginals(Graph(2, [0, 1], [0, 1], [], [], [-1, -1]), m)
    assert got[0, 0] > 0.9 and got[1, 1] > 0.9
    assert (train(Graph(), 3).node == 0).all()


def test_mentions_that_read_alike_become_spans(model):
    found = lambda text: [(KINDS[k], text[a:b]) for a, k, b in added_spans(text, base_spans(text), model)]
    assert found(CALLS) == [("phone", "171 555 2028"), ("phone", "(171) 555-2028")]
    assert found("write to bob.78@mail6.example.com, or bob.78 at mail6.example.com; see mail6.example.com and bob.78 alone") == [("email", "bob.78 at mail6.example.com")]
    for clean in ("nothing 3. list 4.0. 2020 1234567890123456", "page 171, year 2028 (171) 555-2028", "+1 (171) 555-2028 in 2028, page 171", "", "host 10.20.30.40 v10.20.30"):
        assert found(clean) == []


def test_every_row(spark, model):
    rows = [*odd_rows(), (20, CALLS), (20, CALLS), (21, "a@b.co 1.2.3.4 +1 (171) 555-2028 4111-1111-1111-1111"), (None, "x@y.zz"), (22, "\U0001f600 1.2.3.4")]
    docs = documents(spark, rows).withColumnRenamed("n_chars", "spans")
    got = private_data.find(docs, model).collect()
    assert len(got) == len(rows)
    said = lambda spans: ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)
    want = sorted(((r[0] is None, r[0] or 0), said(plain_spans(r[1] or "")), [sum(k == j for _, k, _ in plain_spans(r[1] or "")) for j in range(4)]) for r in rows)
    have = sorted(((r["doc_id"] is None, r["doc_id"] or 0), ",".join(x for x in r["spans"].split(",") if x) if not r["n_added"] else None, [r[f"n_{k}"] for k in KINDS], r["base_sha256"]) for r in got if not r["n_added"])
    assert [(a, b, c) for a, b, c, _ in have] == [w for w in want if w[0] != (False, 20)]
    assert all(d == hashlib.sha256(b.encode()).hexdigest() for _, b, _, d in have)
    twice = [r for r in got if r["doc_id"] == 20]
    assert len(twice) == 2 and all(r["n_phone"] == 1 and r["n_added"] == 2 and r["spans"].count("phone") == 3 for r in twice)
    assert private_data.find(documents(spark, []), private_data.trained(documents(spark, []))).collect() == []


def test_clean_documents_stay_clean(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for r in private_data.find(docs, model).join(docs, "doc_id").collect():
        base = plain_spans(r["text"] or "")
        assert set(",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base).split(",")) - {""} <= set(r["spans"].split(","))
        assert base or not r["spans"]
