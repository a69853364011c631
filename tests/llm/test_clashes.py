"""Columns that a table has besides, named as the operators name their own, change nothing; nor do empty tables end the pipeline."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import documents, odd_rows, words
from trajectree.llm import filter_audit, langid, near_copies, private_data, suffix_dedup, token_counts

NAMES = "text_id set_id fp n sketch wide prefix members spans begin end anchor fragment digest bucket lang_pred score held_out part row fails good toxic quality label side size rank _code _key removed tokens n_tokens edits"


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.fixture(scope="module")
def pair(spark):
    docs = documents(spark, [*odd_rows(), (50, words(90, 5) + " a@b.co", "de", "a"), (51, words(90, 5) + " b@b.co", "de", "b")])
    return docs, docs.select("*", *(F.lit(k).alias(c) for k, c in enumerate(NAMES.split()) if c not in docs.columns))


@pytest.mark.parametrize(
    "run",
    [
        lambda d: token_counts.edited_counts(d), lambda d: suffix_dedup.remaining(d), lambda d: near_copies.near_copies(d, 3), lambda d: langid.identify(d, langid.train(d)),
        lambda d: private_data.find(d, private_data.trained(d)), lambda d: filter_audit.audit(d, d.sparkSession.createDataFrame([(10, 1, 0)], "doc_id long, quality int, toxic int")),
    ],
    ids=["token_counts", "suffix_dedup", "near_copies", "langid", "private_data", "filter_audit"],
)
def test_extra_columns(pair, run):
    plain, extra = pair
    assert rows(run(plain)) == rows(run(extra))


def test_the_pipeline_on_empty_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_nothing_is_lost_by_size(spark):
    """A document that would lose more than half of its characters stays whole; others lose the repeated lines and nothing else."""
    lines = [words(12, k, 5000) for k in range(6)]
    docs = documents(spark, [(1, "\n".join(lines[:4])), (2, "\n".join([*lines[:3], lines[4]])), (3, "\n".join([lines[5], "own words here", lines[0]]))])
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, docs, "").collect()}
    assert got == {1: "\n".join(lines[:4]), 2: "\n".join([*lines[:3], lines[4]]), 3: "\n".join([lines[5], "own words here"])}
