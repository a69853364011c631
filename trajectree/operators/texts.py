"""Text clean-up, parsing and naming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trajectree.functions.text import normalized_code, normalized_output, plain
from trajectree.registry import query
from trajectree.sources.tables import table

_PLAIN = r"trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"select page_id, {_PLAIN} as text from pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", plain(F.col("html")).alias("text"))


@query(f"select page_id, substring({_PLAIN}, 1, 1200) as statement from pages")
def problem_statement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 1200 characters, as shown to a reader."""
    return table(spark, sf_dir, "pages").select("page_id", plain(F.col("html"), 1200).alias("statement"))


_CODE = "case when event_type in ('error', 'purchase') then 'from fractions import gcd' || chr(10) || 'print(fractions.gcd(' || user_id || ', 4))' else 'import fractions' || chr(10) || 'print(xfractions.gcdx, ' || user_id || ')' end"


@query(rf"select event_id, regexp_replace(replace({_CODE}, 'from fractions import gcd', 'from math import gcd'), '\bfractions\.gcd\b', 'math.gcd', 'g') as code from events")
def normalize_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.expr(_CODE.replace("|| user_id ||", "|| cast(user_id as string) ||"))
    return table(spark, sf_dir, "events").select("event_id", normalized_code(code).alias("code"))


@query(r"select doc_id, md5(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) as digest from documents")
def normalize_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalized_output(F.col("text"))).alias("digest"))


@query("select doc_id, substring(md5(text), 1, 12) as prefix from documents")
def md5_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("prefix"))


_LOG = "'u' || user_id || case when event_type = 'view' then ' skip' when event_type = 'purchase' then ' pass=True' else ' pass=False' end"


@query(f"""
with l as (select event_id, {_LOG} as line from events)
select regexp_extract(line, '^u([0-9]+) ', 1) as user_id, max_by(case when line like '% skip%' then 'skip' else regexp_extract(line, 'pass=(True|False)', 1) end, event_id) as outcome from l group by 1""")
def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome of each user in a log of lines made from events; later lines overwrite."""
    lines = table(spark, sf_dir, "events").select("event_id", F.expr(_LOG.replace("|| user_id ||", "|| cast(user_id as string) ||")).alias("line"))
    outcome = F.when(F.col("line").contains(" skip"), "skip").otherwise(F.regexp_extract("line", "pass=(True|False)", 1))
    return lines.groupBy(F.regexp_extract("line", "^u([0-9]+) ", 1).alias("user_id")).agg(F.max_by(outcome, "event_id").alias("outcome"))


@query("""
select p_partkey, case split_part(p_type, ' ', 1) when 'PROMO' then 'promo-open' when 'STANDARD' then 'std' else
  lower(substring(p_type, 1, 3)) || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 3, '0') end as code from part""")
def contest_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special names by a table, others from parts of the name, padded with zeros."""
    special = F.create_map(F.lit("PROMO"), F.lit("promo-open"), F.lit("STANDARD"), F.lit("std"))
    other = F.concat(F.lower(F.substring("p_type", 1, 3)), F.lpad(F.regexp_extract("p_brand", "([0-9]+)", 1), 3, "0"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.try_element_at(special, F.split("p_type", " ")[0]), other).alias("code"))


@query("select p_partkey, p_brand, chr(cast(65 + (row_number() over (partition by p_brand order by p_partkey) - 1) % 26 as int)) as letter from part")
def task_letter(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("p_brand").orderBy("p_partkey")
    letter = F.char((65 + (F.row_number().over(order) - 1) % 26).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", "p_brand", letter.alias("letter"))


@query("select event_id, cast(json_extract(props, '$.k') as bigint) as k, greatest(least(cast(json_extract(props, '$.k') as bigint) / 1000.0, 4.0), 0.0) as seconds from events")
def json_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number out of JSON, in thousandths, at most 4."""
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.greatest(F.least(k / 1000, F.lit(4.0)), F.lit(0.0)).alias("seconds"))
