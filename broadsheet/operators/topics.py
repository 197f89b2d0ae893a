"""Topic scores and assignment. Topics are data: (topic_id, name, keywords array, essential array)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.scratch import maybe_broadcast

THRESHOLD = 0.05
MOST_TOPICS = 500


def scores(docs: DataFrame, topics: DataFrame, topic_rows: int, id_col: str, tokens_col: str, stopwords: list[str] | None = None) -> DataFrame:
    """(id, topic_id, score) of all topics: 0 without an essential token, else keyword hits over tokens plus one.

    The topics are a side input of a few rows (counted by the caller, MOST_TOPICS at most): they become one expression
    each, so a document's tokens are not copied, and a keyword is looked up in a hash set.
    """
    if topic_rows > MOST_TOPICS:
        raise ValueError(f"{topic_rows} topics: at most {MOST_TOPICS} become expressions; positive_scores takes any number")
    side = sorted(topics.select("topic_id", "keywords", "essential").collect(), key=lambda r: r.topic_id)
    if not side:
        return docs.select(id_col, F.lit(None).cast(topics.schema["topic_id"].dataType).alias("topic_id"), F.lit(0.0).alias("score")).where("false")
    kind = topics.schema["topic_id"].dataType

    def one(t: Column, grams: Column, r: Row) -> Column:
        hits = F.size(F.filter(grams, lambda x: x.isin(r.keywords or [])))
        score = F.when(F.exists(t, lambda x: x.isin(r.essential or [])), hits / (F.size(t) + 1)).otherwise(F.lit(0.0))
        return F.struct(F.lit(r.topic_id).cast(kind).alias("topic_id"), score.alias("score"))

    grams = docs.select(id_col, F.col(tokens_col).alias("_t"), tx.let(F.col(tokens_col), lambda t: F.concat(t, tx.ngrams(t, 2, stopwords=stopwords))).alias("_g"))
    return grams.select(id_col, F.inline(F.array(*[one(F.col("_t"), F.col("_g"), r) for r in side])))


def positive_scores(docs: DataFrame, topics: DataFrame, id_col: str, tokens_col: str, stopwords: list[str] | None = None) -> DataFrame:
    """(id, topic_id, score) of the scores above 0, for any number of topics; the same as those of :func:`scores`.

    A document's grams are joined to a table of keywords, its distinct tokens to one of essential words. Both tables are
    broadcast if their counted rows are few, else the grams are shuffled by their text, and only those that are keywords
    are added up. Ids should be distinct. A keyword that a topic lists twice counts once; null words match nothing.
    """
    lists = [topics.select("topic_id", F.explode(c).alias("word")) for c in ("keywords", "essential")]
    return scores_of_words(docs, *lists, id_col, tokens_col, stopwords)


def scores_of_words(docs: DataFrame, keywords: DataFrame, essential: DataFrame, id_col: str, tokens_col: str, stopwords: list[str] | None = None) -> DataFrame:
    """The same with the words of the topics as tables (topic_id, word), so that no list of a topic has to fit in a row."""
    lists = {"keywords": keywords, "essential": essential}
    lists = {c: t.select("topic_id", "word").where("word is not null").distinct() for c, t in lists.items()}
    sides = {c: maybe_broadcast(t, t.count()) for c, t in lists.items()}
    rows = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("t"))
    grams = rows.select("id", F.size("t").alias("n"), F.explode(tx.let(F.col("t"), lambda t: F.concat(t, tx.ngrams(t, 2, stopwords=stopwords)))).alias("word"))
    hits = grams.join(sides["keywords"], "word").groupBy("id", "topic_id").agg(F.count("*").alias("hits"), F.first("n").alias("n"))
    own = rows.select("id", F.explode(F.array_distinct("t")).alias("word")).join(sides["essential"], "word").select("id", "topic_id").distinct()
    return hits.join(own, ["id", "topic_id"]).select(F.col("id").alias(id_col), "topic_id", (F.col("hits") / (F.col("n") + 1)).alias("score"))


def scores_of_first_words(docs: DataFrame, essential: DataFrame, id_col: str, tokens_col: str) -> DataFrame:
    """The same for topics (topic_id, word) of one essential word each, whose keywords are that word and every pair that begins
    with it: a gram's topic follows from its first word, so pairs are neither listed nor shuffled, only added up by word.
    """
    words = essential.select("topic_id", "word").where("word is not null").distinct()
    rows = docs.select(F.col(id_col).alias("id"), F.size(tokens_col).alias("n"), F.posexplode(tokens_col).alias("at", "word"))
    # A token counts as a word, and as the first word of a pair unless it is the last one.
    counted = rows.groupBy("id", "word").agg(F.sum(F.when(F.col("at") < F.col("n") - 1, 2).otherwise(1)).alias("hits"), F.first("n").alias("n"))
    scored = counted.join(maybe_broadcast(words, words.count()), "word")
    return scored.select(F.col("id").alias(id_col), "topic_id", (F.col("hits") / (F.col("n") + 1)).alias("score"))


def assign(scored: DataFrame, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """(id, topic_id, topic_score): the best topic, the first among equals, if above the threshold."""
    best = scored.where(F.col("score") > threshold).groupBy(id_col).agg(F.max_by(F.struct("topic_id", "score"), F.struct("score", -F.col("topic_id"))).alias("b"))
    return best.select(id_col, "b.topic_id", F.col("b.score").alias("topic_score"))


def candidates(headlines: DataFrame, topics: DataFrame, title: str = "title", topic_id: str = "topic_id") -> DataFrame:
    """Headlines without a topic whose title holds an essential word of some topic, in any case: what the batch run reads."""
    words = sorted({w for r in topics.select("essential").collect() for w in r.essential or []})
    return headlines.where(F.col(topic_id).isNull() & tx.matches_any(title, words))


def assign_last(scored: DataFrame, article: str, order: str, threshold: float = THRESHOLD) -> DataFrame:
    """(article, topic_id, topic_score) when the rows of an article are written one after the other: each headline
    (``order``) has its best topic, and the last one above the threshold stands."""
    best = scored.groupBy(article, order).agg(F.max_by(F.struct("topic_id", "score"), F.struct("score", -F.col("topic_id"))).alias("b")).where(F.col("b.score") > threshold)
    last = best.groupBy(article).agg(F.max_by("b", order).alias("b"))
    return last.select(article, "b.topic_id", F.col("b.score").alias("topic_score"))


def assign_missing(articles: DataFrame, scored: DataFrame, id_col: str, threshold: float = THRESHOLD) -> DataFrame:
    """Articles that have a topic keep it; others take their best one."""
    new = assign(scored, id_col, threshold).select(id_col, F.col("topic_id").alias("_t"), F.col("topic_score").alias("_s"))
    out = articles.join(new, id_col, "left")
    had = F.col("topic_id").isNotNull()
    made = {"topic_id": F.when(had, F.col("topic_id")).otherwise(F.col("_t")), "topic_score": F.when(had, F.col("topic_score")).otherwise(F.col("_s"))}
    return out.select(*[made.get(c, F.col(c)).alias(c) for c in articles.columns])
