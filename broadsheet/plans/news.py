"""Newsiness, stories and similarity over headlines with times: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import dates
from broadsheet.functions import text as tx
from broadsheet.operators import baseline, frames, intervals, similarity
from broadsheet.plans import roles
from broadsheet.plans.registry import query

_TERM = r"[\p{L}\p{N}\p{M}_]{2,}"
_STOPS = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in tx.STOPWORDS) + "]"
_EXEMPT = ["src1", "src5", "src9"]
_EX = ", ".join(f"'{x}'" for x in _EXEMPT)


def _pairs(source: str, by: str = "") -> str:
    """TF-IDF weights of ``source`` (by, id, title) and pairs of cosine 0.5 and more, in groups of ``by``, as SQL."""
    k, eq = (f"{by}, ", f"{{0}}.{by} = {{1}}.{by} AND ") if by else ("", "")
    on = lambda a, b: eq.format(a, b)
    return (
        f"tok AS (SELECT {k}id, unnest(list_filter(regexp_extract_all(lower(title), '{_TERM}', 0), lambda t: NOT list_contains({_STOPS}, t))) AS term FROM {source}), tf AS (SELECT {k}id, term, count(*) AS tf FROM tok GROUP BY ALL), "
        + f"nd AS (SELECT {k}count(*) AS n FROM {source} {'GROUP BY ' + by if by else ''}), df AS (SELECT {k}term, count(*) AS df FROM tf GROUP BY ALL), "
        + f"raw AS (SELECT tf.*, tf * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN df ON {on('tf', 'df')}tf.term = df.term JOIN nd ON {on('tf', 'nd')}true), "
        + f"nrm AS (SELECT {k}id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL), wt AS (SELECT raw.*, w / norm AS weight FROM raw JOIN nrm ON {on('raw', 'nrm')}raw.id = nrm.id), "
        + f"pr AS (SELECT {'x.' + by + ', ' if by else ''}x.id AS a, y.id AS b, round(sum(x.weight * y.weight), 9) AS sim FROM wt x JOIN wt y ON {on('x', 'y')}x.term = y.term AND x.id < y.id GROUP BY ALL HAVING round(sum(x.weight * y.weight), 9) >= 0.5)"
    )


_HOME = f"home AS (SELECT * FROM story WHERE country = 'us' OR agency IN ({_EX}))"


def _home(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines of the country, and of exempt agencies."""
    return roles.stories(spark, sf_dir).where((F.col("country") == "us") | F.col("agency").isin(_EXEMPT))


@query(f"WITH {roles.STORY}, {_HOME}, {_pairs('home')} SELECT round(coalesce(2 * count(*), 0) / any_value(n * n) * 10000, 6) AS newsiness FROM nd LEFT JOIN pr ON true")
def newsiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of all ordered pairs of headlines are similar, in ten thousandths; stop words do not count."""
    similar = similarity.Similar(_home(spark, sf_dir), "id", "title", stopwords=tx.STOPWORDS)
    return similar.newsiness().withColumn("newsiness", F.round("newsiness", 6))


_SLOTS = (
    f"{roles.STORY}, {_HOME}, slot AS (SELECT id, title, unnest(generate_series(date_trunc('hour', first_accessed), date_trunc('hour', last_accessed) - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS slot "
    f"FROM home WHERE last_accessed - first_accessed <= INTERVAL 3 DAY), {_pairs('slot', 'slot')}, news AS (SELECT nd.slot, 2 * count(a) / any_value(n * n) * 10000 AS newsiness FROM nd LEFT JOIN pr ON nd.slot = pr.slot GROUP BY nd.slot)"
)
_BASE = "base AS (SELECT CAST(hour(slot) * 60 + minute(slot) AS INT) AS halfhour, dayname(slot) AS day, avg(newsiness) AS mean, median(newsiness) AS median, stddev_samp(newsiness) AS std FROM news {0} GROUP BY 1, 2)"


def _per_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, newsiness) of every half hour: headlines that were up for three days at most, similar within the half hour."""
    short = frames.short_lived(_home(spark, sf_dir), "first_accessed", "last_accessed", 3)
    hour = lambda c: intervals.slot_number(F.date_trunc("hour", c)).cast("long")
    up = short.select("id", "title", hour("first_accessed").alias("begin"), (hour("last_accessed") - 1).alias("end"))
    found = intervals.Intervals(up, "id", "title", "begin", "end", stopwords=tx.STOPWORDS).newsiness()
    return found.select(intervals.slot_time(F.col("slot")).alias("slot"), "newsiness")


@query(f"WITH {_SLOTS} SELECT slot, round(newsiness, 6) AS newsiness FROM news")
def newsiness_halfhours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_slot(spark, sf_dir).select("slot", F.round("newsiness", 6).alias("newsiness"))


@query(f"WITH {_SLOTS}, {_BASE.format('')} SELECT halfhour, day, round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std FROM base")
def newsiness_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, median and sample deviation of newsiness by half hour and weekday."""
    made = baseline.build(_per_slot(spark, sf_dir), "slot", "newsiness")
    return made.select("halfhour", "day", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


_LEARNED = "WHERE slot < TIMESTAMP '2024-01-09 06:00:00'"


@query(
    f"WITH {_SLOTS}, {_BASE.format(_LEARNED)}, z AS (SELECT slot, newsiness, round((newsiness - mean) / nullif(std, 0), 6) AS z FROM news LEFT JOIN base ON halfhour = CAST(hour(slot) * 60 + minute(slot) AS INT) AND day = dayname(slot)) "
    "SELECT slot, round(newsiness, 6) AS newsiness, z, CASE WHEN z IS NULL THEN 'unknown' WHEN z > 1.5 THEN 'big' WHEN z < 0.25 THEN 'slow' ELSE 'average' END AS kind FROM z"
)
def newsiness_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every half hour against a baseline of the first days; unknown where the baseline has no such half hour."""
    news = _per_slot(spark, sf_dir)
    base = baseline.build(news.where(F.col("slot") < F.lit("2024-01-09 06:00:00").cast("timestamp_ntz")), "slot", "newsiness")
    out = baseline.classify(news, base, "slot", "newsiness")
    return out.select("slot", F.round("newsiness", 6).alias("newsiness"), F.round("z", 6).alias("z"), "kind")


_LABELS = (
    "e AS (SELECT {0}a, b FROM pr UNION SELECT {0}b, a FROM pr), r AS (SELECT {0}a AS id, a AS n FROM e UNION SELECT {1}r.id, e.b FROM r JOIN e ON {2}e.a = r.n), lab AS (SELECT {0}id, min(n) AS label FROM r GROUP BY ALL), "
    "big AS (SELECT {0}label, row_number() OVER ({3}ORDER BY label) - 1 AS cluster FROM lab GROUP BY {0}label HAVING count(*) >= {4})"
)
_REPORT = f"WITH RECURSIVE {roles.STORY}, home AS (SELECT * FROM story WHERE country = 'us' OR (country = 'gb' AND agency IN ({_EX}))), {_pairs('home')}, {_LABELS.format('', '', '', '', 3)}, st AS (SELECT home.*, cluster FROM home JOIN lab USING (id) JOIN big USING (label)), o AS (SELECT cluster, agency, min(id) AS id FROM st GROUP BY 1, 2), m AS (SELECT cluster, o.agency, o.id, bias, first_accessed FROM o JOIN story USING (id))"


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines that clustering reads (the country, and exempt British agencies), with their story."""
    s = roles.stories(spark, sf_dir)
    narrow = s.where((F.col("country") == "us") | ((F.col("country") == "gb") & F.col("agency").isin(_EXEMPT)))
    named = similarity.Similar(narrow, "id", "title", stopwords=tx.STOPWORDS).clusters(3)
    return narrow.join(named, "id")


@query(
    f"{_REPORT} SELECT CAST(cluster AS INT) AS cluster, count(*) AS members, max(date_diff('second', first_accessed, TIMESTAMP '2024-02-01')) AS first, arg_min(id, CAST(abs(bias) AS BIGINT) * 1000000000 + id) AS summary_id, round_even(count(*) / 124 * 100, 2) AS coverage "
    "FROM m GROUP BY 1 HAVING count(*) >= 3 ORDER BY first, cluster"
)
def story_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of at least three agencies: members, coverage, age, the most neutral title; the youngest story first."""
    since = F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.col("first_accessed").cast("timestamp"))
    out = similarity.cluster_summary(_report(spark, sf_dir).withColumn("howlong", since), 124, 3)
    return out.select(F.col("cluster").cast("int").alias("cluster"), "members", "first", "summary_id", "coverage")


@query(
    f"{_REPORT}, a AS (SELECT cluster, count(*) AS members, max(date_diff('second', first_accessed, TIMESTAMP '2024-02-01') % 9000) // 60 AS minutes FROM m GROUP BY 1 HAVING count(*) >= 3) "
    "SELECT CAST(cluster AS INT) AS cluster, minutes < 90 AS breaking, members || ' headlines, ' || CASE WHEN minutes < 90 THEN 'BREAKING! ' || minutes || 'm ago!' ELSE 'First broken ' || (minutes // 60) || ' hours ago' END AS mark FROM a"
)
def story_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories marked as breaking below ninety minutes (ages are taken from a span of 150 minutes), or by their hours."""
    since = F.unix_seconds(F.lit("2024-02-01").cast("timestamp")) - F.unix_seconds(F.col("first_accessed").cast("timestamp"))
    summary = similarity.cluster_summary(_report(spark, sf_dir).withColumn("howlong", since % 9000), 124, 3)
    return similarity.age_marks(summary).select(F.col("cluster").cast("int").alias("cluster"), "breaking", "mark")


@query(
    f"{_REPORT}, w AS (SELECT cluster, agency, bias, lag(bias) OVER (PARTITION BY cluster ORDER BY bias, agency) AS before FROM m) "
    "SELECT CAST(cluster AS INT) AS cluster, string_agg(CASE WHEN before <> bias THEN '| ' ELSE '' END || agency, ' ' ORDER BY bias, agency) AS agencies FROM w GROUP BY 1 HAVING count(*) >= 3"
)
def story_agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The agencies of a story by bias and name, with a bar where the bias changes."""
    return similarity.agency_lists(_report(spark, sf_dir), 3).select(F.col("cluster").cast("int").alias("cluster"), "agencies")


@query(
    f"WITH RECURSIVE {roles.STORY}, dayed AS (SELECT *, CAST(first_accessed AS DATE) AS day FROM story), {_pairs('dayed', 'day')}, {_LABELS.format('day, ', 'r.day, ', 'e.day = r.day AND ', 'PARTITION BY day ', 3)}, "
    "st AS (SELECT dayed.day, agency, cluster, CAST(dayed.day AS VARCHAR) || '-' || CAST(cluster AS VARCHAR) AS story FROM dayed JOIN lab ON lab.day = dayed.day AND lab.id = dayed.id JOIN big ON big.day = lab.day AND big.label = lab.label), "
    "o AS (SELECT DISTINCT day, story, agency FROM st), k AS (SELECT day, story, count(*) AS n FROM o GROUP BY ALL HAVING count(*) >= 3), d AS (SELECT day, CAST(sum(n) AS BIGINT) AS n FROM k GROUP BY 1) "
    "SELECT day, n, n < (SELECT median(n) FROM d) AS slow FROM d"
)
def slow_news_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stories of each day by themselves; members of large ones are counted, and days below the median are slow."""
    dayed = roles.stories(spark, sf_dir).withColumn("day", F.to_date("first_accessed"))
    named = similarity.Similar(dayed, "id", "title", stopwords=tx.STOPWORDS, by=["day"]).clusters(3).where("cluster <> -1")
    members = dayed.join(named, ["day", "id"]).select("day", F.concat_ws("-", F.col("day").cast("string"), "cluster").alias("story"), "agency").distinct()
    daily = frames.keep_groups(members, ["story"], 3).groupBy("day").agg(F.count("*").alias("n"))
    return daily.join(F.broadcast(daily.agg(F.median("n").alias("m"))), how="cross").select("day", "n", (F.col("n") < F.col("m")).alias("slow"))  # one row


_PROBE = "the river and this thing is in that"
_ASKED = (
    f"{roles.STORY}, tok AS (SELECT id, unnest(regexp_extract_all(lower(title), '{_TERM}', 0)) AS term FROM story), tf AS (SELECT id, term, count(*) AS tf FROM tok GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), "
    "w AS (SELECT id, tf.term, tf * (ln((1 + (SELECT count(*) FROM story)) / (1 + df)) + 1) AS w FROM tf JOIN df USING (term)), "
    f"q AS (SELECT term, count(*) * any_value(ln((1 + (SELECT count(*) FROM story)) / (1 + df)) + 1) AS q FROM (SELECT unnest(regexp_extract_all('{_PROBE}', '{_TERM}', 0)) AS term) JOIN df USING (term) GROUP BY 1), "
    "s AS (SELECT story.id, title, coalesce((SELECT sum(w.w * q.q) FROM w JOIN q USING (term) WHERE w.id = story.id) / (SELECT sqrt(sum(w * w)) FROM w WHERE w.id = story.id) / (SELECT sqrt(sum(q * q)) FROM q), 0) AS similarity FROM story)"
)


@query(f"WITH {_ASKED} SELECT id, round(similarity, 6) AS similarity FROM s")
def similar_to_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every headline against one text."""
    return similarity.to_probe(roles.stories(spark, sf_dir), "id", "title", _PROBE).select("id", F.round("similarity", 6).alias("similarity"))


@query(f"WITH {_ASKED}, c AS (SELECT count(*) FILTER (contains(title, 'The')) AS holds, count(*) FILTER (NOT contains(title, 'The')) AS lacks FROM s WHERE round(similarity, 9) > 0.2) SELECT holds, lacks, round(holds / (holds + lacks), 6) AS ratio FROM c")
def probe_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the headlines above a cutoff, how many hold a word."""
    s = roles.stories(spark, sf_dir)
    near = similarity.to_probe(s, "id", "title", _PROBE).withColumn("similarity", F.round("similarity", 9)).join(s.select("id", "title"), "id")
    return similarity.precision(near, "title", "The", 0.2).withColumn("ratio", F.round("ratio", 6))


_SLOT_BASE = f"WITH {_SLOTS}, {_BASE.format('')}"


def _means(spark: SparkSession, sf_dir: str, key: str) -> DataFrame:
    base = baseline.build(_per_slot(spark, sf_dir), "slot", "newsiness")
    return base.groupBy(key).agg(F.round(F.avg("mean"), 6).alias("mean")).orderBy(F.desc("mean"), key)


@query(f"{_SLOT_BASE} SELECT day, round(avg(mean), 6) AS mean FROM base GROUP BY 1")
def newsiness_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekdays by mean newsiness, the busiest first."""
    return _means(spark, sf_dir, "day")


@query(f"{_SLOT_BASE} SELECT halfhour, round(avg(mean), 6) AS mean FROM base GROUP BY 1")
def newsiness_by_halfhour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half hours of the day by mean newsiness, the busiest first."""
    return _means(spark, sf_dir, "halfhour")
