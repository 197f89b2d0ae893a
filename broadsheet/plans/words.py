"""Dictionary forms and parts of speech: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import lemmas, tagger
from broadsheet.plans import roles
from broadsheet.plans.registry import query
from broadsheet.session import table

_CUTS = ", ".join(f"CASE WHEN ends_with(form, '{old}') THEN left(form, length(form) - {len(old)}) || '{new}' END" for old, new in lemmas.NOUN_ENDINGS)
_CUT = f"unnest(list_filter([{_CUTS}], lambda x: x IS NOT NULL))"


@query(
    "WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents), n AS (SELECT token, count(*) AS n FROM w GROUP BY 1), "
    "ix AS (SELECT token AS lemma FROM n WHERE n >= 3), ex AS (SELECT token AS form, left(token, length(token) - 2) AS lemma FROM n WHERE ends_with(token, 'on')), "
    "t0 AS (SELECT token, token AS form, token IN (SELECT form FROM ex) AS excepted FROM n UNION SELECT form, lemma, true FROM ex), "
    f"f1 AS (SELECT token, {_CUT} AS form FROM t0 WHERE NOT excepted), f2 AS (SELECT token, {_CUT} AS form FROM f1), f3 AS (SELECT token, {_CUT} AS form FROM f2), "
    "every AS (SELECT 1 AS level, token, form FROM t0 UNION ALL SELECT 1, token, form FROM f1 UNION ALL SELECT 2, token, form FROM f2 UNION ALL SELECT 3, token, form FROM f3), "
    "best AS (SELECT token, form FROM every WHERE form IN (SELECT lemma FROM ix) QUALIFY row_number() OVER (PARTITION BY token ORDER BY level, length(form), form) = 1) "
    "SELECT n.token, coalesce(form, n.token) AS lemma FROM n LEFT JOIN best ON best.token = n.token"
)
def noun_lemmas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of all words against an index of the words that occur three times or more; words in -on are exceptions."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), F.lit(1))).alias("token"))
    counted = words.groupBy("token").agg(F.count("*").alias("n"))
    index = counted.where("n >= 3").select(F.col("token").alias("lemma"))
    exceptions = counted.where(F.col("token").endswith("on")).select(F.col("token").alias("form"), F.expr("left(token, char_length(token) - 2)").alias("lemma"))
    return lemmas.lemma_table(counted, index, exceptions)


def made_tags(tokens: Column) -> Column:
    """Tags that follow from a word's last letter, and, for a fifth of the letters, from the word before it: after an adjective
    or an article it is a noun, else a verb."""
    kind = lambda w: F.pmod(F.ascii(F.lower(F.right(w, F.lit(1)))), F.lit(5))
    plain = lambda k: F.when(k == 0, "NN").when(k == 1, "VB").when(k == 2, "JJ").when(k == 3, "DT")
    before = lambda i: F.when(i > 0, kind(F.get(tokens, i - 1)))
    return F.transform(tokens, lambda w, i: F.coalesce(plain(kind(w)), F.when(before(i).isin(2, 3), "NN").otherwise("VB")))


@query()
def noun_cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word cloud of the headlines: of their words only those that a tagger, which learned from three quarters of the
    headlines, takes for nouns. No tagged text is at hand, so tags are made from the words; tests state the accuracy."""
    titles = roles.titles(spark, sf_dir).select("id", "title")
    words = titles.select("id", tx.tokenize("title").alias("tokens"))
    learned = tagger.fit(words.where("id % 4 <> 2").select("tokens", made_tags(F.col("tokens")).alias("tags")), rounds=3)
    nouns = titles.select(F.explode(tx.prepare("title", tx.cloud_pipeline(learned))).alias("word"))
    return nouns.groupBy("word").agg(F.count("*").alias("n"))
