"""How the provided tables play the parts of the headline store.

events: access log (user_id is the agency, bias = user_id mod 7 - 3, event_type the topic, value the sentiment).
orders and lineitem: articles and their headlines. customer and nation: agencies and countries. pages: front pages, whose
titles are headlines. documents, conversations, benchmark: longer texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.session import table

BIAS_SQL = "cast(user_id % 7 - 3 as int)"


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("agency_id"), F.expr(BIAS_SQL).alias("bias"), F.col("event_type").alias("topic"), F.col("value").alias("vader"), (F.col("value") / 10).alias("afinn"), "props"
    )


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("country"))
    return (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows, a fixed dimension
        .select(F.col("c_custkey").alias("agency_id"), F.col("c_name").alias("agency"), "country", F.expr("cast(c_nationkey % 7 - 3 as int)").alias("bias"), F.expr("cast(c_nationkey % 6 as int)").alias("credibility"), F.col("c_mktsegment").alias("segment"))
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("article_id"), F.col("o_custkey").alias("agency_id"), F.col("o_orderdate").alias("first_accessed"), F.col("o_orderpriority").alias("topic"))


def headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    # l_linenumber counts within the table's own keys, so (article, line, part) names a headline.
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("article_id"), F.col("l_partkey").alias("headline_id"), F.col("l_linenumber").alias("position"), (F.col("l_discount") * 10 - 0.5).alias("vader"), (F.col("l_tax") * 10).alias("afinn"), F.col("l_shipdate").alias("last_accessed")
    )


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page titles with their hosts."""
    return table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("url", "^[a-z]+://([^/?]+)", 1).alias("agency")
    )


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines with times and agencies: the first line of a document, with made-up attributes."""
    first = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id * 37 % 20160 as int), 0)")
    up = F.expr("make_dt_interval(cast(case when doc_id % 23 = 0 then 5 else 0 end as int), 0, cast(doc_id * 53 % 1440 as int), 0)")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        F.regexp_extract("text", r"^[^\n]*", 0).alias("title"),
        F.col("source").alias("agency"),
        F.expr("cast(doc_id % 7 - 3 as int)").alias("bias"),
        F.expr("case doc_id % 5 when 0 then 'gb' when 1 then 'fr' else 'us' end").alias("country"),
        first.alias("first_accessed"),
        (first + up).alias("last_accessed"),
    )


#: The same in DuckDB, as common table expressions.
LOG = "log AS (SELECT event_id, ts, user_id AS agency_id, CAST(user_id % 7 - 3 AS INT) AS bias, event_type AS topic, value AS vader, value / 10 AS afinn, props FROM events)"
AGENCY = "agency AS (SELECT c_custkey AS agency_id, c_name AS agency, n_name AS country, CAST(c_nationkey % 7 - 3 AS INT) AS bias, CAST(c_nationkey % 6 AS INT) AS credibility, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)"
ARTICLE = "article AS (SELECT o_orderkey AS article_id, o_custkey AS agency_id, o_orderdate AS first_accessed, o_orderpriority AS topic FROM orders)"
HEADLINE = "headline AS (SELECT l_orderkey AS article_id, l_partkey AS headline_id, l_linenumber AS position, l_discount * 10 - 0.5 AS vader, l_tax * 10 AS afinn, l_shipdate AS last_accessed FROM lineitem)"
TITLE = "title AS (SELECT page_id AS id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?]+)', 1) AS agency FROM pages)"
STORY = (
    "story AS (SELECT doc_id AS id, regexp_extract(text, '^[^\n]*', 0) AS title, source AS agency, CAST(doc_id % 7 - 3 AS INT) AS bias, CASE doc_id % 5 WHEN 0 THEN 'gb' WHEN 1 THEN 'fr' ELSE 'us' END AS country, "
    "TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 % 20160 AS BIGINT)) AS first_accessed, "
    "TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id * 37 % 20160 AS BIGINT)) + to_days(CAST(CASE WHEN doc_id % 23 = 0 THEN 5 ELSE 0 END AS INT)) + to_minutes(CAST(doc_id * 53 % 1440 AS BIGINT)) AS last_accessed FROM documents)"
)
