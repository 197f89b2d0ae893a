"""Ingest, upkeep and side inputs of the store: queries with their SQL."""

from __future__ import annotations


from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import numbers
from broadsheet.functions import text as tx
from broadsheet.operators import frames, lexicon, snapshot, topics
from broadsheet.operators.store import Store
from broadsheet.plans import roles
from broadsheet.plans.registry import query
from broadsheet.scratch import Scratch, passing_folder, passing_name
from broadsheet.session import table
from broadsheet.sources import side_inputs
from broadsheet.streaming import first_last, liveness
from broadsheet.streaming import pages as page_stream


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


# Sinks and upkeep.


@query("SELECT user_id, min(event_id) AS event_id FROM events GROUP BY 1")
def insert_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that two batches are appended to: of each key only the first row is added."""
    events = table(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    path = passing_folder(spark, "inserted")
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    stored = None
    for part in (events.where(F.col("ts") < half), events.where(F.col("ts") >= half)):
        first = part.groupBy("user_id").agg(F.min("event_id").alias("event_id"))
        stored = snapshot.append(first, path, "user_id")
    return stored


@query("SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01') THEN TIMESTAMP '2024-05-01' ELSE TIMESTAMP '2024-01-01' END AS last_accessed FROM customer")
def touch_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that a batch holds again get a new last sighting."""
    store = table(spark, sf_dir, "customer").select("c_custkey", F.lit("2024-01-01").cast("timestamp_ntz").alias("last_accessed"))
    batch = table(spark, sf_dir, "orders").where(F.col("o_orderdate") >= F.lit("2000-01-01").cast("timestamp_ntz")).select(F.col("o_custkey").alias("c_custkey"))
    return snapshot.touch(store, batch, "c_custkey", F.lit("2024-05-01").cast("timestamp_ntz"))


_BRANDS = "SELECT p_brand AS name, CASE WHEN count(*) % 2 = 0 THEN '#446' END AS color, list_sort(list(DISTINCT p_name)) AS keywords, list_sort(list(DISTINCT p_type)) AS essential FROM part WHERE {} GROUP BY 1"


def _topics(spark: SparkSession, sf_dir: str, wanted: str = "true") -> DataFrame:
    """A topic for each brand: the names of its parts are keywords, their types the essential ones, and some have no colour."""
    lists = [F.array_sort(F.collect_set(c)).alias(n) for c, n in (("p_name", "keywords"), ("p_type", "essential"))]
    return table(spark, sf_dir, "part").where(wanted).groupBy(F.col("p_brand").alias("name")).agg(F.when(F.count("*") % 2 == 0, "#446").alias("color"), *lists)


@query(
    f"WITH topic AS ({_BRANDS.format('true')}) SELECT name, color, array_to_string(keywords, ',') AS keywords, array_to_string(essential, ',') AS essential, "
    "string_split(array_to_string(keywords, ','), ',') AS again, len(string_split(array_to_string(essential, ','), ',')) AS parts FROM topic"
)
def topic_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of the topics as comma-joined text and split again."""
    joined = _topics(spark, sf_dir).select("name", "color", F.array_join("keywords", ",").alias("keywords"), F.array_join("essential", ",").alias("essential"))
    return joined.withColumns({"again": F.split("keywords", ","), "parts": F.size(F.split("essential", ",")).cast("long")})


@query(
    f"WITH topic AS ({_BRANDS.format('p_partkey % 3 <> 0')}), batch AS ({_BRANDS.format('p_size > 45')}) "
    "SELECT name, coalesce(b.color, t.color) AS color, array_to_string(coalesce(b.keywords, t.keywords), ',') AS keywords, array_to_string(coalesce(b.essential, t.essential), ',') AS essential FROM topic t FULL JOIN batch b USING (name)"
)
def topic_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The topic table brought up to date by name: a missing colour of the batch does not wipe out the one that is there."""
    merged = snapshot.merge(_topics(spark, sf_dir, "p_partkey % 3 <> 0"), _topics(spark, sf_dir, "p_size > 45"), "name")
    return merged.select("name", "color", F.array_join("keywords", ",").alias("keywords"), F.array_join("essential", ",").alias("essential"))


@query(
    "WITH topic AS (SELECT DISTINCT CAST(split_part(p_brand, '#', 2) AS INT) AS topic_id, p_brand AS name FROM part), "
    "dated AS (SELECT o_orderkey AS i, o_orderpriority AS name, CASE WHEN o_orderkey % 500 = 0 THEN 'all' ELSE 'Brand#' || (o_custkey % 40) END AS topic, CAST(o_orderdate AS DATE) AS date FROM orders) "
    "SELECT topic_id, d.i, d.name, d.date, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY d.date, d.i) AS INT) AS place FROM topic JOIN dated d ON d.topic = topic.name OR d.topic = 'all'"
)
def special_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Special dates (orders) joined to their topics (brands) by name, those of all topics included, in order of date; dates
    of a topic that is none go."""
    topics_ = table(spark, sf_dir, "part").select(F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int").alias("topic_id"), F.col("p_brand").alias("name")).distinct()
    topic = F.when(F.col("o_orderkey") % 500 == 0, "all").otherwise(F.concat(F.lit("Brand#"), (F.col("o_custkey") % 40).cast("string")))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("i"), F.col("o_orderpriority").alias("name"), topic.alias("topic"), F.col("o_orderdate").cast("date").alias("date"))
    return side_inputs.dated(topics_, orders)


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table written as CSV and read again by its declared schema."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    path = passing_folder(spark, "csv")
    side_inputs.write_csv(s, path)
    return side_inputs.csv(spark, path, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")


# Filters and samples.

_DRAW = "('0x' || substr(md5({0} || ':{1}'), 1, 8))::BIGINT / 4294967296"


@query(f"SELECT event_id, CASE WHEN {_DRAW.format('event_id', 42)} < 0.8 THEN 'train' ELSE 'test' END AS part FROM events")
def train_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.split(table(spark, sf_dir, "events").select("event_id"), "event_id")


@query(f"SELECT event_id, user_id FROM events ORDER BY {_DRAW.format('event_id', 7)}, event_id LIMIT 50")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty rows at random (the number is the feature), the same at every run."""
    return frames.sample(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", 50, 7)


@query("SELECT doc_id, length(t) AS text_length FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE text END AS t FROM documents) WHERE t IS NOT NULL")
def processed_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without processed text are dropped; an empty one is text."""
    n = F.col("doc_id") % 3
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(n == 1, "").when(n == 2, F.col("text")).alias("processed"))
    return snapshot.without_null(docs).select("doc_id", F.length("processed").cast("long").alias("text_length"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 <> 1")
def empties_deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clean-up: rows whose processed text is empty are deleted by id."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 1, "...").otherwise(F.concat(F.lit("x"), F.col("text"))).alias("text"))
    done = docs.select("doc_id", tx.preprocess("text").alias("processed"))
    return snapshot.delete(done, snapshot.empties(done), "doc_id").select("doc_id")


@query(f"WITH {roles.STORY} SELECT id FROM story WHERE last_accessed - first_accessed <= INTERVAL 3 DAY")
def short_lived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.short_lived(roles.stories(spark, sf_dir), "first_accessed", "last_accessed").select("id")


_FIVE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey"]
_GAPS = ", ".join(f"CASE WHEN (l_orderkey + l_linenumber) % {7 + 2 * k} = 0 THEN NULL ELSE {c} END AS {c}" for k, c in enumerate(_FIVE))


@query(f"SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, {_GAPS} FROM lineitem) WHERE {' OR '.join(f'{c} IS NULL' for c in _FIVE)}")
def any_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lack one of five scores."""
    key = F.col("l_orderkey") + F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *[F.when(key % (7 + 2 * k) != 0, F.col(c)).alias(c) for k, c in enumerate(_FIVE)])
    return rows.where(lexicon.lacks_any(_FIVE)).select("l_orderkey", "l_linenumber")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def not_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(~F.col("event_type").isin("click", "view")).select("event_id")


@query(
    "SELECT s_suppkey, CASE WHEN v > 1 THEN '😊' WHEN v < -1 THEN '😭' ELSE '' END AS face, CASE WHEN v IS NOT NULL THEN round(least(greatest((v + 1) / 2.0 * 120, 0), 120), 6) END AS hue, v IS NULL AS missing FROM (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN NULL ELSE s_acctbal / 3000 END AS v FROM supplier)"
)
def score_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces and colours of scores; a missing score is grey."""
    v = F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 3000)
    s = table(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))
    shown = s.withColumn("colour", numbers.colour(F.col("v"), 1.0, 2.0))
    return shown.select("s_suppkey", numbers.smiley(F.col("v"), 1.0).alias("face"), F.when(F.col("v").isNotNull(), F.round(numbers.hue(F.col("v"), 1.0, 2.0), 6)).alias("hue"), (F.col("colour") == "#f9fafb").alias("missing"))


# Topics.

_NAMED = "named AS (SELECT * FROM (VALUES (1, '1-URGENT'), (2, '2-HIGH'), (9, 'none')) v(topic_id, topic))"


@query(f"WITH {roles.AGENCY}, {roles.ARTICLE}, {_NAMED} SELECT article_id, agency, topic_id, topic FROM article JOIN agency USING (agency_id) JOIN named USING (topic)")
def topic_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of agencies joined to a table of topics: articles of other topics fall out."""
    named = spark.createDataFrame([(1, "1-URGENT"), (2, "2-HIGH"), (9, "none")], "topic_id int, topic string")
    joined = roles.articles(spark, sf_dir).join(roles.agencies(spark, sf_dir).select("agency_id", "agency"), "agency_id")
    return joined.join(F.broadcast(named), "topic").select("article_id", "agency", "topic_id", "topic")  # three rows


_SIDE = [(1, ["the", "and", "the and"], ["the"]), (2, ["de", "la", "de la"], ["de", "la"]), (3, ["und", "der"], ["der"])]
_VALUES = ", ".join(f"({i}, {_list(k)}, {_list(e)})" for i, k, e in _SIDE)
_TOKENS = r"regexp_extract_all(lower(title), '[\p{L}\p{N}\p{M}_-]*\p{L}[\p{L}\p{N}\p{M}_-]*', 0)"
_BATCH = (
    f"{roles.STORY}, side AS (SELECT * FROM (VALUES {_VALUES}) v(topic_id, keywords, essential)), c AS (SELECT id, id // 4 AS article_id, {_TOKENS} AS t FROM story WHERE id % 5 <> 0 AND ({' OR '.join(f'contains(lower(title), {chr(39)}{w}{chr(39)})' for w in sorted({w for _, _, e in _SIDE for w in e}))})), "
    "g AS (SELECT id, article_id, t, CASE WHEN len(t) < 2 THEN t ELSE list_concat(t, list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1])) END AS g FROM c), "
    "sc AS (SELECT id, article_id, topic_id, CASE WHEN list_has_any(t, essential) THEN len(list_filter(g, lambda x: list_contains(keywords, x))) / (len(t) + 1) ELSE 0 END AS score FROM g CROSS JOIN side), "
    "best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, topic_id) AS rn FROM sc) WHERE rn = 1 AND score > 0.05)"
)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, article_id, topic_id, score) of the headlines that the batch run reads; every fifth has a topic already."""
    side = spark.createDataFrame(_SIDE, "topic_id int, keywords array<string>, essential array<string>")
    s = roles.stories(spark, sf_dir).select("id", "title", F.when(F.col("id") % 5 == 0, 1).alias("topic_id"))
    tokens = topics.candidates(s, side).select("id", tx.tokenize(F.lower("title")).alias("tokens"))
    return topics.scores(tokens, side, len(_SIDE), "id", "tokens").withColumn("article_id", F.expr("id div 4"))


@query(f"WITH {_BATCH} SELECT article_id, topic_id, round(score, 9) AS topic_score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY id DESC) AS last FROM best) WHERE last = 1")
def topic_assign_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch assignment as rows are written one by one: of an article's headlines the last one with a topic stands."""
    out = topics.assign_last(_scored(spark, sf_dir), "article_id", "id")
    return out.withColumn("topic_score", F.round("topic_score", 9))


@query(f"WITH {_BATCH} SELECT article_id, topic_id, round(score, 9) AS topic_score FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY score DESC, topic_id) AS top FROM best) WHERE top = 1")
def topic_assign_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch assignment by the best headline of an article."""
    out = topics.assign(_scored(spark, sf_dir), "article_id")
    return out.withColumn("topic_score", F.round("topic_score", 9))


# Counters and guards.

_FOUND = "f AS (SELECT agency_id, title, href, regexp_matches(href, '^https?://') AS valid, contains(title, ' ') AS many FROM (SELECT id % 7 AS agency_id, title, CASE WHEN id % 6 = 0 THEN 'ftp://x' ELSE 'https://h.example/' || id END AS href FROM story))"


@query(f"WITH {roles.STORY}, {_FOUND} SELECT count(*) AS found, count(*) FILTER (valid) AS valid, count(*) FILTER (valid AND many) AS headlines, count(DISTINCT title) FILTER (valid AND many) AS distinct_titles FROM f")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an ingest run counts on its way, by observations of the one pass that writes the result."""
    s = roles.stories(spark, sf_dir).select("title", F.when(F.col("id") % 6 == 0, "ftp://x").otherwise(F.concat(F.lit("https://h.example/"), F.col("id"))).alias("href"))
    found, valid, kept = Observation("found"), Observation("valid"), Observation("kept")
    one = s.observe(found, F.count(F.lit(1)).alias("n"))
    two = one.where(F.col("href").rlike("^https?://")).observe(valid, F.count(F.lit(1)).alias("n"))
    three = two.where(tx.many_words("title")).observe(kept, F.count(F.lit(1)).alias("n"))
    stored = Scratch(spark, "ingest").keep(three.select("title"), "headlines")
    counts = spark.createDataFrame([(found.get["n"], valid.get["n"], kept.get["n"])], "found long, valid long, headlines long")
    return counts.join(stored.agg(F.countDistinct("title").alias("distinct_titles")), how="cross")  # one row each


_TWO_RUNS = (
    f"{roles.STORY}, link AS (SELECT id, 'src' || id % 7 AS agency, title AS processed, CASE WHEN id % 6 = 0 THEN 'ftp://x' ELSE 'https://h.example/' || id // 3 END AS href, id % 10 < 6 AS earlier FROM story), "
    "kept AS (SELECT * FROM link WHERE regexp_matches(href, '^https?://') AND contains(processed, ' ')), old AS (SELECT * FROM kept WHERE earlier), "
    "one AS (SELECT agency, processed, arg_min(href, id) AS href FROM kept WHERE NOT earlier GROUP BY 1, 2), k AS (SELECT one.*, processed IN (SELECT processed FROM old) AS known, href IN (SELECT href FROM old) AS article FROM one), "
    "f AS (SELECT agency, count(*) AS found FROM link WHERE NOT earlier GROUP BY 1), "
    "c AS (SELECT agency, count(*) FILTER (NOT known) AS headlines, count(*) FILTER (known) AS updated, count(DISTINCT CASE WHEN NOT known AND NOT article THEN href END) AS articles FROM k GROUP BY 1), "
    "r AS (SELECT agency, found, coalesce(articles, 0) AS articles, coalesce(headlines, 0) AS headlines, coalesce(updated, 0) AS updated FROM f LEFT JOIN c USING (agency))"
)


def _second_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a run over four tenths of the headlines, against a store of the rest."""
    s = roles.stories(spark, sf_dir)
    href = F.when(F.col("id") % 6 == 0, "ftp://x").otherwise(F.concat(F.lit("https://h.example/"), F.floor(F.col("id") / 3)))
    links = s.select(F.concat(F.lit("src"), F.col("id") % 7).alias("agency"), F.col("id").alias("position"), href.alias("href"), F.col("title").alias("processed"), (F.col("id") % 10 < 6).alias("earlier"))
    links = links.withColumn("counts", F.col("href").rlike("^https?://") & tx.many_words("processed"))
    return page_stream.counters(links.where("not earlier"), links.where("earlier and counts"), F.length("agency") * 10)


@query(f"WITH {_TWO_RUNS} SELECT agency, found, articles, headlines, updated, round(length(agency) * 10 / found, 9) AS seconds_each FROM r")
def agency_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run found for each agency: links, new articles and headlines, known ones, seconds for each link."""
    return _second_run(spark, sf_dir).withColumn("seconds_each", F.round("seconds_each", 9))


@query(f"WITH {_TWO_RUNS} SELECT agency, agency || ': (' || articles || ',' || headlines || ',' || updated || ')' AS line, 0 AS n_exceptions FROM r")
def day_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's report as rows: one line for each agency."""
    made = page_stream.day_report(_second_run(spark, sf_dir))
    return made.select("agency", "line", F.size("exceptions").alias("n_exceptions"))


@query("SELECT event_type AS topic, count(*) AS n FROM events WHERE event_type IN ('click', 'view', 'absent') GROUP BY 1")
def topics_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame for each topic asked for; those without rows are skipped."""
    events = table(spark, sf_dir, "events")
    parts = frames.non_empty({t: events.where(F.col("event_type") == t) for t in ("click", "view", "absent")})
    frames.required(events, "events")
    counts = [df.agg(F.lit(t).alias("topic"), F.count("*").alias("n")) for t, df in parts.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out


# Sentiment.

_LEXICON = {"the": 0.5, "of": -1.0, "and": 0.25, "de": -0.5, "und": 1.0}
_LEX = "lex AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', CAST({v} AS DOUBLE))" for t, v in _LEXICON.items()) + ") v(token, valence))"
_PER_WORD = f"s AS (SELECT id, sum(valence) AS s FROM (SELECT id, unnest({_TOKENS}) AS token FROM story) JOIN lex USING (token) GROUP BY 1), new AS (SELECT id, coalesce(s, 0) / greatest(len(list_filter(regexp_split_to_array(title, '[\\s\\x0B\\x{{85}}\\p{{Z}}]+'), lambda w: w <> '')), 1) AS score FROM story LEFT JOIN s USING (id))".replace("{{", "{").replace("}}", "}")


@query(f"WITH {roles.STORY}, {_LEX}, {_PER_WORD} SELECT id, round(CASE WHEN id % 4 = 0 THEN score ELSE id * 0.5 END, 6) AS afinn FROM story JOIN new USING (id)")
def rescore_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment is computed anew and written back to rows that lack it only."""
    s = roles.stories(spark, sf_dir).select("id", "title", F.when(F.col("id") % 4 != 0, F.col("id") * 0.5).alias("afinn"))
    lacking = s.where(lexicon.lacks_any(["afinn"]))
    return lexicon.rescore(s.select("id", "afinn"), _new_scores(spark, lacking), "id", ["afinn"], False).withColumn("afinn", F.round("afinn", 6))


@query(f"WITH {roles.STORY}, {_LEX}, {_PER_WORD} SELECT id, round(score, 6) AS afinn FROM new")
def rescore_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentiment of every title, whatever was there."""
    s = roles.stories(spark, sf_dir).select("id", "title", F.lit(9.0).alias("afinn"))
    return lexicon.rescore(s.select("id", "afinn"), _new_scores(spark, s), "id", ["afinn"], True).withColumn("afinn", F.round("afinn", 6))


def _new_scores(spark: SparkSession, rows: DataFrame) -> DataFrame:
    lex = spark.createDataFrame(list(_LEXICON.items()), "token string, valence double")
    return lexicon.per_word(rows, lex, "id", "title", tx.tokenize(F.lower("title")), len(_LEXICON)).withColumnRenamed("score", "afinn")


# Streams.

_SNAP = "SELECT user_id, min(ts) AS first_accessed, max(ts) AS last_accessed FROM events GROUP BY 1"


def _several_files(spark: SparkSession, sf_dir: str) -> str:
    """The access log as four files, so that a stream over it has several batches."""
    path = passing_folder(spark, "log")
    table(spark, sf_dir, "events").select("user_id", "ts").repartition(4).write.parquet(path)
    return path


@query(_SNAP)
def stream_first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sighting from a stream of several micro-batches, and a restart that finds nothing new."""
    path, name = _several_files(spark, sf_dir), passing_name(spark, "sightings")
    schema = spark.read.parquet(path).schema
    first_last.ingest(first_last.stream(spark, path, schema, 1), "user_id", "ts", name)
    return first_last.ingest(first_last.stream(spark, path, schema, 1), "user_id", "ts", name)


@query("SELECT user_id, min(ts) AS first_accessed, max(ts) AS last_accessed, count(*) AS n FROM events GROUP BY 1")
def stream_sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stateful query: running minimum, maximum and count per key in Spark's state store."""
    path = _several_files(spark, sf_dir)
    rows = first_last.stream(spark, path, spark.read.parquet(path).schema, 1)
    return first_last.latest(rows, "user_id", "ts", passing_name(spark, "running"))


@query(_SNAP)
def stream_bucketed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last sighting from a stream into a store dealt by key hash, of which a batch rewrites what it touches."""
    path, name = _several_files(spark, sf_dir), passing_name(spark, "bucketed")
    return first_last.ingest_buckets(first_last.stream(spark, path, spark.read.parquet(path).schema, 1), "user_id", "ts", name, 16).read()


@query(
    "SELECT user_id, min(ts) AS first_accessed, CASE WHEN max(ts) >= TIMESTAMP '2024-01-30' THEN TIMESTAMP '2024-05-01' ELSE max(ts) END AS last_accessed "
    "FROM events WHERE user_id % 5 <> 0 GROUP BY 1"
)
def bucketed_upkeep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucketed store through two upserts, a touch of the keys of the last days, and a delete."""
    events = table(spark, sf_dir, "events").select("user_id", F.col("ts").alias("first_accessed"), F.col("ts").alias("last_accessed"))
    stored = Store(spark, passing_folder(spark, "upkeep"), events.schema, "user_id", 16)
    half, late = (F.lit(d).cast("timestamp_ntz") for d in ("2024-01-16", "2024-01-30"))
    stored.upsert(events.where(F.col("first_accessed") < half))
    stored.upsert(events.where(F.col("first_accessed") >= half))
    stored.touch(events.where(F.col("first_accessed") >= late), F.lit("2024-05-01").cast("timestamp_ntz"))
    stored.delete(events.where("user_id % 5 = 0").select("user_id").distinct())
    stored.vacuum(1)
    return stored.read()


_GAP, _FORGET, _DELAY = 12 * 3600, 3 * 86400, 3600
_STAYS = f"""WITH seen AS (SELECT user_id, ts, event_id, epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS since FROM events),
cut AS (SELECT *, sum(CASE WHEN since IS NULL OR since > {_GAP}000000 THEN 1 ELSE 0 END) OVER w AS stay, sum(CASE WHEN since IS NULL OR since > {_FORGET}000000 THEN 1 ELSE 0 END) OVER w AS life
  FROM seen WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
made AS (SELECT user_id, life, stay, min(ts) AS f, max(ts) AS last_accessed, count(*) AS m FROM cut GROUP BY 1, 2, 3),
whole AS (SELECT user_id, min(f) OVER (PARTITION BY user_id, life) AS first_accessed, last_accessed, CAST(sum(m) OVER (PARTITION BY user_id, life ORDER BY stay ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM made)
SELECT * FROM whole WHERE epoch_us(last_accessed) + {_GAP}000000 < (SELECT max(epoch_us(ts)) - {_DELAY}000000 FROM events)"""


@query(_STAYS)
def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays of each agency on its page that ended: sightings at most twelve hours apart, lives at most three days."""
    return liveness.stays(table(spark, sf_dir, "events"), "user_id", "ts", _GAP, _FORGET, _DELAY)


@query(_STAYS)
def stream_left_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in the order of time: timers close stays, state is freed after three days."""
    events = table(spark, sf_dir, "events").select("user_id", "ts")
    path, name = passing_folder(spark, "log"), passing_name(spark, "left")
    cuts = [F.lit(d).cast("timestamp_ntz") for d in ("1000-01-01", "2024-01-11", "2024-01-21", "9999-01-01")]
    for a, b in zip(cuts, cuts[1:]):
        events.where((F.col("ts") >= a) & (F.col("ts") < b)).coalesce(1).write.mode("append").parquet(path)
    return liveness.run_left(first_last.stream(spark, path, events.schema, 1), "user_id", "ts", name, _GAP, _FORGET, _DELAY)
