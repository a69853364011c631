"""The pipeline's near-copy stage against brute-force Jaccard similarity."""

from __future__ import annotations

import random
import re

import corpus_pipeline
from tests.llm.helpers import components, documents, odd_rows, words
from trajectree.llm import near_copies, simhash


def shingles(text):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set()


def similar(a, b):
    return a == b or len(a & b) >= 0.8 * len(a | b) - 1e-9


def edited(text, n, seed):
    tokens, pick = text.split(), random.Random(seed)
    for k in pick.sample(range(len(tokens)), n):
        tokens[k] = f"new{pick.randrange(10**9)}"
    return " ".join(tokens)


def rows():
    out = [(r[0] if r[0] is None else 10_000 + r[0], r[1]) for r in odd_rows()]
    for s in range(25):
        base = words(150 + 10 * s, 1000 + s, 5000)
        chain = edited(base, 2, s)
        out += [(100 * s + 9 - k, t) for k, t in enumerate([base, chain, edited(chain, 2, s + 50), *(edited(base, n, 60 + s) for n in (3, 4, 5, 6, 9)), base.upper()])]
    return out


def bits(a, b):
    return (simhash.fingerprint(a) ^ simhash.fingerprint(b)).bit_count()


def test_all_near_copies_and_no_others(spark):
    docs = rows()
    sets = [shingles(t) for _, t in docs]
    pairs = [(i, j) for i in range(len(docs)) for j in range(i)]
    links = [(i, j) for i, j in pairs if similar(sets[i], sets[j])]
    # Pairs that fingerprints of three words within six bits miss, and such that they take wrongly.
    assert any(bits(docs[i][1], docs[j][1]) > 6 for i, j in links)
    assert any(bits(docs[i][1], docs[j][1]) <= 6 and not similar(sets[i], sets[j]) for i, j in pairs)
    root = components(range(len(docs)), links)
    least = {}
    for k, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            least[root[k]] = min(doc_id, least.get(root[k], doc_id))
    want = sorted((str(d), str(least.get(root[k]))) for k, (d, _) in enumerate(docs))
    found = near_copies.near_copies(documents(spark, docs), 6).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in found) == want
    kept = {r["doc_id"] for r in corpus_pipeline.simhash_near_dedup(spark, documents(spark, docs), "").select("doc_id").collect()}
    assert kept - {None} == set(least.values())
    assert near_copies.deduplicate(documents(spark, []), 6).count() == 0


def test_pairs_beyond_the_fingerprints_are_found(spark):
    """With fingerprints that propose only pairs of one bit, the join finds the rest."""
    docs = [r for r in rows() if r[0] is not None and r[0] < 10_000]
    of = lambda radius: sorted(map(tuple, near_copies.near_copies(documents(spark, docs), radius).collect()))
    assert of(1) == of(6)
