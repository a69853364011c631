"""The likelihood ratio and the verdict against a plain version."""

import math
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.helpers import documents, odd_rows, words
from trajectree.llm import quality


def plain_hash(value, seed=42):
    data = value.encode() if isinstance(value, str) else (value % (1 << 64)).to_bytes(8, "little")
    return xxhash.xxh64_intdigest(data, seed)


def grams(tokens, buckets):
    hashes = [plain_hash(t) for t in tokens]
    pairs = [plain_hash(b, plain_hash(a)) for a, b in zip(hashes, hashes[1:])]
    return [h % buckets for h in hashes + pairs]


def shaped(text):
    out, last = [], None
    for c in text:
        kind = "a" if c.islower() and c.isalpha() and c.lower() == c and c.upper() != c else "A" if c.isupper() else "0" if c.isnumeric() else None
        if kind is None or kind != last:
            out.append(kind or c)
        last = kind
    return "".join(out)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_scores(rows, trusted):
    kinds = [(lambda t: split(t), quality.WORD_BUCKETS), (lambda t: split(shaped(t or "")), quality.BUCKETS)]
    scores = [math.inf] * len(rows)
    for tokens, buckets in kinds:
        each = [grams(tokens(t), buckets) for _, t in rows]
        raw, good = Counter(), Counter()
        for (doc_id, _), g in zip(rows, each):
            raw.update(g)
            if doc_id in trusted:
                good.update(g)
        n, m = sum(raw.values()) + buckets, sum(good.values()) + buckets
        for k, g in enumerate(each):
            part = sum(math.log((good[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in g) / len(g) if g and m > buckets else 0.0
            scores[k] = min(scores[k], part)
    return scores


@pytest.mark.parametrize("trusted", [set(), {6, 10, 1000, 1003}])
def test_score_and_verdict(spark, trusted):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(1000 + k, words(90, k, 3000)) for k in range(8)]
    rows += [(2000, " ".join(f"{k}|{7 * k}%" for k in range(80))), (2001, "LOUD! WORDS?\r\n\x0b " * 60), (2002, words(70, 77) + " joined here")]
    labels = spark.createDataFrame([(d, 1, 0) for d in trusted] + [(2000, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.judged(documents(spark, rows).select("doc_id", "text", F.lit(1).alias("n")), labels).collect()
    want = sorted((str(d), str(t), round(s, 9)) for (d, t), s in zip(rows, plain_scores(rows, trusted)))
    assert [(a, b, pytest.approx(c)) for a, b, c in want] == sorted((str(r["doc_id"]), str(r["text"]), round(r["score"], 9)) for r in found)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.LEAST_SCORE) for r in found)
