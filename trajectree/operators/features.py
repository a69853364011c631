"""Bags of words and n-grams of token streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajectree.functions.text import counted, ngrams, tokens
from trajectree.operators.retrieval import _TOK, bags
from trajectree.registry import query
from trajectree.sources.tables import table


@query(f"select doc_id, token, count(*) as cnt from (select doc_id, unnest({_TOK}) as token from documents) group by all")
def token_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bags(table(spark, sf_dir, "documents"), "doc_id")


def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the tokens of its texts, an array for each row of the id; only texts are shuffled, grams are made and counted inside a document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    return docs.groupBy("doc_id").agg(F.collect_list("text").alias("texts")).select("doc_id", F.transform("texts", tokens).alias("all"))


def _every(*of: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform("all", lambda words: F.concat(*(make(words) for make in of))))


def _grams(spark: SparkSession, sf_dir: str, *ahead: int, sep: str = "/") -> DataFrame:
    return counted(by_document(spark, sf_dir), _every(lambda words: ngrams(words, *ahead, sep=sep))).select("doc_id", F.col("item").alias("gram"), F.col("n").alias("cnt"))


def _sql(gram: str) -> str:
    return f"""
with t as (select doc_id, unnest({_TOK}) as tok, generate_subscripts({_TOK}, 1) as pos from documents),
s as (select doc_id, tok, lead(tok, 1) over w as t1, lead(tok, 2) over w as t2, lead(tok, 3) over w as t3 from t window w as (partition by doc_id order by pos))
select doc_id, {gram} as gram, count(*) as cnt from s where {gram} is not null group by all"""


@query(_sql("tok || '/' || t1"))
def bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 0, 1)


@query(_sql("tok || '/' || t1 || '/' || t2"))
def trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 0, 1, 2)


@query(_sql("tok || '/*/' || t2"))
def skip_bigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 0, 2, sep="/*/")


@query(_sql("tok || '/' || t1 || '/' || t2 || '/' || t3"))
def four_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grams(spark, sf_dir, 0, 1, 2, 3)


@query(f"""
with t as (select doc_id, unnest({_TOK}) as tok, generate_subscripts({_TOK}, 1) as pos from documents),
s as (select doc_id, tok, lead(tok, 1) over w as t1, lead(tok, 2) over w as t2 from t window w as (partition by doc_id order by pos)),
f as (select doc_id, 'U:' || tok as feature, 2 as n from s union all select doc_id, 'B:' || tok || '/' || t1, 1 from s
  union all select doc_id, 'T:' || tok || '/' || t1 || '/' || t2, 1 from s union all select doc_id, 'S:' || tok || '/' || t2, 1 from s)
select doc_id, feature, cast(sum(n) as bigint) as cnt from f where feature is not null group by all""")
def weighted_feature_bag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams at weight 2; bigrams, trigrams and one-skip bigrams at 1."""
    kinds = {"U": (0,), "B": (0, 1), "T": (0, 1, 2), "S": (0, 2)}
    makers = [lambda words, k=k, at=at: ngrams(words, *at, mark=f"{k}:") for k, at in kinds.items()]
    rows = counted(by_document(spark, sf_dir), _every(*makers))
    return rows.select("doc_id", F.col("item").alias("feature"), F.when(F.startswith("item", F.lit("U:")), 2 * F.col("n")).otherwise(F.col("n")).alias("cnt"))
