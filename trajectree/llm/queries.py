"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.llm import chat, embedding_dedup, filter_audit, hard_negatives, langid, line_dedup, mixing, packing, private_data, quality, simhash, suffix_dedup, token_counts
from trajectree.llm.common import table
from trajectree.llm.oracles import ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to target weights."""
    return mixing.mixed_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and after masking its personal data, encoding only what the edits touch."""
    return token_counts.edited_counts(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document that are removed for being similar to an earlier line of the corpus."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    removed = line_dedup.removed_by_document(docs)
    feeds = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    every = docs.select("doc_id", F.xxhash64("text").alias("text_id"), (F.coalesce(feeds, F.lit(0)) + 1).cast("long").alias("n_lines"))
    joined = every.join(removed, every["doc_id"].eqNullSafe(removed["doc_id"]) & (every["text_id"] == removed["text_id"]), "left")
    n = F.coalesce(F.size("removed"), F.lit(0)).cast("long")
    return joined.select(every["doc_id"], "n_lines", n.alias("n_removed"), F.coalesce(F.array_join(F.col("removed").cast("array<string>"), ","), F.lit("")).alias("removed_lines"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-duplicates among all documents."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of at most 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove the bytes of 200-byte strings that repeat anywhere."""
    return suffix_dedup.remaining(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations, and one that holds the template's own control strings."""
    return chat.digests(chat.rendered_turns(chat.with_extra(table(spark, sf_dir, "conversations"))))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding near-duplicates among all vectors of equal label."""
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs.filter(~langid.held_out(F.col("doc_id")))))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules and verdict for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = quality.judged(docs, table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op11_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: fixed patterns, and what the field adds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return private_data.find(docs, private_data.trained(docs))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from all documents in each of their orders, by source."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    return hard_negatives.mined(hard_negatives.quantized(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash": op4_simhash,
    "op5_packing": op5_packing,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_chat": op7_chat,
    "op8_embeddings": op8_embeddings,
    "op9_langid": op9_langid,
    "op10_quality": op10_quality,
    "op11_private_data": op11_private_data,
    "op12_filter_audit": op12_filter_audit,
    "op13_hard_negatives": op13_hard_negatives,
}
