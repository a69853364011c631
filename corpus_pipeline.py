"""The training-corpus pipeline: five stages, each written as Parquet and read again as the next one's documents.

Defined results, for all stages: a null text is empty and fails the quality rules; rows that are repeated are documents of their own until near-dedup, which keeps one;
a null doc_id takes part; columns beside doc_id, text, source and n_chars pass through; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from trajectree.llm import line_dedup, mixing, near_copies, packing, quality
from trajectree.llm.common import shared_folder, table

#: Bits within which fingerprints propose near copies in the pipeline. It only says which pairs are tried first: all that are near copies are found by their
#: shingles, and each pair is verified.
NEAR_COPY_RADIUS = 3

#: Part of a document that line dedup must leave; documents that would lose more stay whole, as near-dedup can only judge whole texts.
LEAST_LEFT = 0.5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.keep(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines similar to an earlier line go, however short; documents that would lose more than half are left to near-dedup as they are."""
    return line_dedup.deduplicate(docs, least_words=1, least_left=LEAST_LEFT)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles of similarity 0.8) stays: the one of least id."""
    return near_copies.deduplicate(docs, NEAR_COPY_RADIUS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their target weights; documents may repeat or go."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents become pieces of sequences of at most 1024 tokens."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("pack", pack),
]

#: Hashes, tokens and packing are beyond SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; returns what the last one does."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
