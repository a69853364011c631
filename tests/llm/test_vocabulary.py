"""The quality score sees words, not only their shapes."""

import random

from tests.llm.helpers import documents, words
from trajectree.llm import quality


def prose(seed):
    """Sentences of a fixed set: their pairs of words repeat."""
    pick = random.Random(seed)
    return " ".join(words(12, s, 800) for s in pick.sample(range(60), 15))


def test_other_words_of_the_same_shape_score_lower(spark):
    good = [(k, prose(k)) for k in range(200)]
    spam = [(1000 + k, " ".join(f"s{random.Random(k * 180 + j).randrange(300)}x" for j in range(180))) for k in range(200)]
    docs = documents(spark, good + spam + [(2000, prose(999))]).select("doc_id", "text")
    labels = spark.createDataFrame([(k, 1, 0) for k in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.judged(docs, labels).select("doc_id", "score", "kept").collect()}
    assert all(got[k]["kept"] for k in range(200)) and got[2000]["kept"]
    assert not any(got[1000 + k]["kept"] for k in range(200))
