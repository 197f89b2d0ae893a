"""Time series, roll-ups, joins and rankings: queries with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import dates, numbers
from broadsheet.operators import baseline, frames
from broadsheet.plans import roles
from broadsheet.plans.registry import query
from broadsheet.session import table


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _scores() -> dict:
    return {"vader": F.col("vader"), "afinn": F.col("afinn"), "pvi": F.col("vader") * F.col("bias"), "pai": F.col("afinn") * F.col("bias")}


_MA = ", ".join(f"round({c}, 6) AS {c}, CASE WHEN count({c}) OVER w = 7 THEN round(avg({c}) OVER w, 6) END AS {c}_ma" for c in ("vader", "afinn", "pvi", "pai"))
_MEANS = "avg(vader) AS vader, avg(afinn) AS afinn, avg(vader * bias) AS pvi, avg(afinn * bias) AS pai"


def _ma(daily: DataFrame) -> DataFrame:
    columns = ["vader", "afinn", "pvi", "pai"]
    return _round(frames.rolling_mean(daily, columns, ["day"]), *columns, *[c + "_ma" for c in columns])


@query(f"WITH {roles.LOG}, d AS (SELECT CAST(ts AS DATE) AS day, {_MEANS} FROM log GROUP BY 1) SELECT day, {_MA} FROM d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def daily_partisan_ma7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily means of both scores and of the partisan indices, with seven-row averages."""
    return _ma(frames.daily_means(roles.access_log(spark, sf_dir), "ts", _scores()))


_MENTIONS = {"odd": '(?i)"k": \\d*[13579]\\}', "nine": '(?i)"k": 9'}
_M = "SELECT '{0}' AS subset, day, " + _MA + " FROM (SELECT CAST(ts AS DATE) AS day, " + _MEANS + " FROM log WHERE regexp_matches(props, '{1}') GROUP BY 1) d WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)"


@query(f"WITH {roles.LOG} " + " UNION ALL ".join(_M.format(n, p) for n, p in _MENTIONS.items()))
def mention_daily_ma7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over rows that mention something; a row may count in both subsets."""
    log = roles.access_log(spark, sf_dir)
    parts = [_ma(frames.daily_means(log.where(F.col("props").rlike(p)), "ts", _scores())).withColumn("subset", F.lit(n)) for n, p in _MENTIONS.items()]
    return parts[0].unionByName(parts[1])


_ROLLUP = (
    f"{roles.AGENCY}, {roles.ARTICLE}, {roles.HEADLINE}, rollup AS (SELECT agency, any_value(credibility) AS credibility, any_value(bias) AS bias, any_value(country) AS country, "
    "round_even(round(count(headline_id) / count(DISTINCT article_id), 9), 2) AS churn, round_even(round(avg(vader), 9), 2) AS vader, round_even(round(avg(afinn), 9), 2) AS afinn "
    "FROM headline JOIN article USING (article_id) JOIN agency USING (agency_id) GROUP BY agency)"
)


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = roles.headlines(spark, sf_dir).join(roles.articles(spark, sf_dir).select("article_id", "agency_id"), "article_id").join(roles.agencies(spark, sf_dir), "agency_id")
    return frames.agency_rollup(joined)


@query(f"WITH {_ROLLUP} SELECT * FROM rollup")
def agency_rollup_churn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines joined to articles and agencies, rolled up by agency name."""
    return _rollup(spark, sf_dir)


@query(
    f"WITH {_ROLLUP} SELECT median(vader) AS median_vader, round(avg(vader), 6) AS mean_vader, round(avg(bias * vader), 6) AS partisan_mean_vader, "
    "median(afinn) AS median_afinn, round(avg(afinn), 6) AS mean_afinn, round(avg(bias * afinn), 6) AS partisan_mean_afinn FROM rollup WHERE country = 'NATION_3'"
)
def agency_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.agency_metrics(_rollup(spark, sf_dir), F.col("country") == "NATION_3")
    return _round(out, "mean_vader", "partisan_mean_vader", "mean_afinn", "partisan_mean_afinn")


@query(f"WITH {roles.AGENCY} SELECT agency_id, agency, credibility, CASE credibility WHEN 0 THEN 'Very Low' WHEN 1 THEN 'Low' WHEN 2 THEN 'Mixed' WHEN 3 THEN 'Mostly Factual' WHEN 4 THEN 'High' ELSE 'Very High' END AS credibility_name, CASE bias WHEN -3 THEN 'Extreme Left' WHEN -2 THEN 'Left' WHEN -1 THEN 'Left Center' WHEN 0 THEN 'Unbiased' WHEN 1 THEN 'Right Center' WHEN 2 THEN 'Right' ELSE 'Extreme Right' END AS bias_name FROM agency")
def agency_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enumeration codes as their names."""
    a = roles.agencies(spark, sf_dir)
    return a.select("agency_id", "agency", "credibility", numbers.pretty(numbers.named(F.col("credibility"), numbers.CREDIBILITY)).alias("credibility_name"), numbers.pretty(numbers.named(F.col("bias"), numbers.BIAS)).alias("bias_name"))


@query(f"WITH {roles.AGENCY}, {roles.ARTICLE} SELECT agency.agency_id, agency, coalesce(topic, '') AS topic, article_id FROM agency LEFT JOIN article ON agency.agency_id = article.agency_id AND topic = '1-URGENT'")
def left_topic_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left outer join; what has no topic gets the empty string."""
    topics = roles.articles(spark, sf_dir).where("topic = '1-URGENT'").select("agency_id", "topic", "article_id")
    return roles.agencies(spark, sf_dir).join(topics, "agency_id", "left").select("agency_id", "agency", F.coalesce("topic", F.lit("")).alias("topic"), "article_id")


@query(
    f"WITH {roles.AGENCY}, {roles.ARTICLE}, {roles.HEADLINE} SELECT article_id, headline_id, position, agency, topic, first_accessed, last_accessed, date_diff('second', first_accessed, TIMESTAMP '2001-10-01') AS howlong, "
    "round_even(round(vader, 9), 2) AS vader, round_even(round(afinn, 9), 2) AS afinn FROM headline JOIN article USING (article_id) JOIN agency USING (agency_id) WHERE last_accessed > TIMESTAMP '2001-06-01' AND first_accessed > TIMESTAMP '2001-06-01' - INTERVAL 3 DAY"
)
def live_headlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main frame: headlines still up at a given time, with article and agency."""
    joined = roles.headlines(spark, sf_dir).join(roles.articles(spark, sf_dir), "article_id").join(roles.agencies(spark, sf_dir).select("agency_id", "agency"), "agency_id")
    up = frames.live(joined, F.lit("2001-06-01").cast("timestamp_ntz")).orderBy(F.desc("first_accessed"), "position", "headline_id")
    howlong = F.unix_seconds(F.lit("2001-10-01").cast("timestamp")) - F.unix_seconds(F.col("first_accessed").cast("timestamp"))
    return up.select("article_id", "headline_id", "position", "agency", "topic", "first_accessed", "last_accessed", howlong.alias("howlong"), F.bround(F.round("vader", 9), 2).alias("vader"), F.bround(F.round("afinn", 9), 2).alias("afinn"))


def _suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return table(spark, sf_dir, "supplier").join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))  # 25 rows


_EXEMPT = ["Supplier#000000003", "Supplier#000000005", "Supplier#000000007"]
_EX = ", ".join(f"'{x}'" for x in _EXEMPT)


@query(f"SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR s_name IN ({_EX})")
def us_or_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suppliers(spark, sf_dir).where((F.col("n_name") == "NATION_3") | F.col("s_name").isin(_EXEMPT)).select("s_suppkey", "s_name", "n_name")


@query(f"SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_3' OR (n_name = 'NATION_15' AND s_name IN ({_EX}))")
def us_or_gb_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrower filter in front of clustering."""
    return _suppliers(spark, sf_dir).where((F.col("n_name") == "NATION_3") | ((F.col("n_name") == "NATION_15") & F.col("s_name").isin(_EXEMPT))).select("s_suppkey", "s_name", "n_name")


@query("SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3)")
def having_semijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of groups with at least three of them, by a semi join on the aggregate."""
    return frames.keep_groups(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], 3)


@query("SELECT event_id, user_id FROM (SELECT event_id, user_id, ts, min(ts) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts > f + INTERVAL 1 DAY")
def first_day_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.after_first_day(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id")


@query("SELECT user_id, round(avg(CASE WHEN isnan(value) THEN NULL ELSE value END), 6) AS score FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM events) WHERE ts > f + INTERVAL 1 DAY GROUP BY 1")
def agency_current_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score per agency that skips NaN and its first day."""
    later = frames.after_first_day(table(spark, sf_dir, "events"), "user_id", "ts")
    return _round(later.groupBy("user_id").agg(F.avg(numbers.no_nan(F.col("value"))).alias("score")), "score")


_E = (
    f"{roles.ARTICLE}, {roles.HEADLINE}, j AS (SELECT article_id, headline_id, position, vader, afinn, floor((epoch_us(last_accessed) - epoch_us(first_accessed)) / 86400000000.0) + 1 AS duration "
    "FROM headline JOIN article USING (article_id)), e AS (SELECT *, 1.0 / (1 + position) * duration AS raw FROM j)"
)


@query(
    f"WITH {_E} SELECT article_id, headline_id, position, CAST(duration AS BIGINT) AS duration, round(coalesce((nullif(afinn, 0) + vader) / 2, nullif(afinn, 0), vader), 6) AS sentiment, round(1.0 / (1 + position), 6) AS positionnorm, "
    "round((raw - min(raw) OVER ()) / nullif(max(raw) OVER () - min(raw) OVER (), 0), 6) AS emphasis FROM e"
)
def emphasis_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration in days, mean of the scores that are there, position weight and emphasis scaled over the frame."""
    j = roles.headlines(spark, sf_dir).join(roles.articles(spark, sf_dir).select("article_id", "first_accessed"), "article_id")
    j = j.withColumn("duration", dates.whole_days(F.col("first_accessed"), F.col("last_accessed")))
    j = j.withColumn("sentiment", numbers.mean_of(F.nullif("afinn", F.lit(0.0)), F.col("vader")))
    out = frames.emphasis(j, "position", "duration").select("article_id", "headline_id", "position", "duration", "sentiment", "positionnorm", "emphasis")
    return _round(out, "sentiment", "positionnorm", "emphasis")


@query(f"WITH {roles.LOG} SELECT bias, topic, count(afinn) AS n FROM log GROUP BY 1, 2")
def topic_bias_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.access_log(spark, sf_dir).groupBy("bias", "topic").agg(F.count("afinn").alias("n"))


@query(f"WITH {roles.LOG} SELECT topic, CAST(hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York') AS INT) AS hour, CAST(sign(bias) AS INT) AS side, count(*) AS n FROM log GROUP BY 1, 2, 3")
def hour_side_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per topic, Eastern hour and side."""
    log = roles.access_log(spark, sf_dir)
    return log.groupBy("topic", F.hour(dates.eastern(F.col("ts"))).alias("hour"), numbers.side(F.col("bias")).alias("side")).agg(F.count("*").alias("n"))


@query(
    f"WITH {roles.LOG}, w AS (SELECT topic, CAST(date_trunc('week', ts) AS DATE) + 6 AS week, count(*) AS n FROM log GROUP BY 1, 2), "
    "s AS (SELECT CAST(unnest(generate_series((SELECT min(week) FROM w), (SELECT max(week) FROM w), INTERVAL 7 DAY)) AS DATE) AS week), t AS (SELECT DISTINCT topic FROM w), "
    "c AS (SELECT s.week, t.topic, coalesce(n, 0) AS n FROM s CROSS JOIN t LEFT JOIN w ON w.week = s.week AND w.topic = t.topic) "
    "SELECT week, topic, n, CAST(coalesce(sum(n) OVER (PARTITION BY week ORDER BY topic ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM c"
)
def weekly_topic_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per topic and week ending on Sunday, empty weeks as 0, with the base of the stacked bars."""
    counts = roles.access_log(spark, sf_dir).groupBy("topic", dates.week_label(F.to_date("ts")).alias("week")).agg(F.count("*").alias("n"))
    filled = frames.fill_spine(counts, frames.spine(counts, "week", 7), "week", counts, "topic", "n")
    return frames.stacked_base(filled, "n", ["week"], ["topic"]).select("week", "topic", "n", "base")


@query(f"WITH {roles.LOG} SELECT topic, count(*) AS n FROM log GROUP BY 1")
def topic_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.access_log(spark, sf_dir).groupBy("topic").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "topic")


_TOPICS = ["click", "error", "purchase", "signup", "view"]


@query(
    f"WITH {roles.LOG}, p AS (SELECT CAST(ts AS DATE) AS day, {', '.join(f'count(*) FILTER (topic = {chr(39)}{t}{chr(39)}) AS {t}' for t in _TOPICS)} FROM log GROUP BY 1), "
    f"m AS (SELECT day, {', '.join(f'CASE WHEN count({t}) OVER w = 7 THEN round(avg({t}) OVER w, 6) END AS {t}' for t in _TOPICS)} FROM p WINDOW w AS (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)) SELECT * FROM m WHERE click IS NOT NULL"
)
def topic_pivot_ma7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by topic counts, missing as 0, as seven-row averages without the first six rows."""
    pivot = roles.access_log(spark, sf_dir).groupBy(F.to_date("ts").alias("day")).pivot("topic", _TOPICS).agg(F.count(F.lit(1))).na.fill(0)
    ma = frames.rolling_mean(pivot, _TOPICS, ["day"]).select("day", *[F.round(f"{t}_ma", 6).alias(t) for t in _TOPICS])
    return ma.na.drop("any")


_AISLE = f"{roles.LOG}, a AS (SELECT CASE WHEN bias < 0 THEN 'left' WHEN bias > 0 THEN 'right' ELSE 'center' END AS aisle, CAST(ts AS DATE) AS day, avg(vader) AS vader FROM log GROUP BY 1, 2)"


def _aisles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.access_log(spark, sf_dir).groupBy(numbers.aisle(F.col("bias")).alias("aisle"), F.to_date("ts").alias("day")).agg(F.avg("vader").alias("vader"))


@query(f"WITH {_AISLE} SELECT aisle, day, round(vader, 6) AS vader, CASE WHEN count(vader) OVER w = 7 THEN round(avg(vader) OVER w, 6) END AS vader_ma FROM a WINDOW w AS (ORDER BY aisle, day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def aisle_ma_unpartitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages that run over the borders of the aisles, as the reference has them."""
    return _round(frames.rolling_mean(_aisles(spark, sf_dir), ["vader"], ["aisle", "day"]), "vader", "vader_ma")


@query(f"WITH {_AISLE} SELECT aisle, day, round(vader, 6) AS vader, CASE WHEN count(vader) OVER w = 7 THEN round(avg(vader) OVER w, 6) END AS vader_ma FROM a WINDOW w AS (PARTITION BY aisle ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
def aisle_ma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, restarted in each aisle."""
    return _round(frames.rolling_mean(_aisles(spark, sf_dir), ["vader"], ["day"], by=["aisle"]), "vader", "vader_ma")


@query(
    f"WITH {roles.LOG}, c AS (SELECT topic, bias, CAST(ts AS DATE) AS day, count(*) AS n FROM log GROUP BY 1, 2, 3) "
    "SELECT topic, day, bias, n, CAST(coalesce(sum(n) OVER (PARTITION BY topic, day ORDER BY bias ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM c"
)
def bias_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = roles.access_log(spark, sf_dir).groupBy("topic", F.to_date("ts").alias("day"), "bias").agg(F.count("*").alias("n"))
    return frames.stacked_base(counts, "n", ["topic", "day"], ["bias"]).select("topic", "day", "bias", "n", "base")


@query(f"WITH {roles.AGENCY} SELECT bias, credibility, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bias) * 100, 6) AS pct FROM agency GROUP BY 1, 2")
def cred_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(frames.share(roles.agencies(spark, sf_dir), ["bias", "credibility"], ["bias"]), "pct").withColumnRenamed("count", "n")


@query(f"WITH {roles.AGENCY} SELECT bias, count(*) AS n, round(avg(credibility), 6) AS mean_credibility, round(count(*) / sum(count(*)) OVER () * 100, 6) AS pct FROM agency GROUP BY 1")
def bias_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = roles.agencies(spark, sf_dir).groupBy("bias").agg(F.count("*").alias("n"), F.round(F.avg("credibility"), 6).alias("mean_credibility"))
    return counts.withColumn("pct", F.round(F.col("n") / F.sum("n").over(W.partitionBy()) * 100, 6))  # at most seven rows


@query("SELECT count(DISTINCT event_id) FILTER (d) AS headlines, count(DISTINCT user_id) FILTER (d) AS articles, CASE WHEN count(DISTINCT user_id) FILTER (d) = 0 THEN 1.0 ELSE count(DISTINCT event_id) FILTER (d) / count(DISTINCT user_id) FILTER (d) END AS churn FROM (SELECT *, CAST(ts AS DATE) = DATE '2024-01-15' AS d FROM events)")
def churn_today(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.churn_on(table(spark, sf_dir, "events"), F.to_date("ts") == F.lit("2024-01-15").cast("date"), "event_id", "user_id")


_SLOTS = "s AS (SELECT event_id, unnest(generate_series(date_trunc('hour', ts), date_trunc('hour', ts + to_microseconds(CAST(round(value * 3600000000) AS BIGINT))) - INTERVAL 30 MINUTE, INTERVAL 30 MINUTE)) AS slot FROM events)"


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("until", F.expr("ts + make_dt_interval(0, 0, 0, cast(round(value * 3600, 6) as decimal(18, 6)))"))
    return baseline.expand(events, "ts", "until").select("event_id", "slot")


_H = f"{_SLOTS}, v AS (SELECT slot, count(*) AS n FROM s GROUP BY 1), b AS (SELECT CAST(hour(slot) * 60 + minute(slot) AS INT) AS halfhour, dayname(slot) AS day, avg(n) AS mean, median(n) AS median, stddev_samp(n) AS std FROM v GROUP BY 1, 2)"


@query(f"WITH {_H} SELECT halfhour, day, round(mean, 6) AS mean, median, round(std, 6) AS std FROM b")
def halfhour_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows are up in each half hour, as mean, median and deviation by half hour and weekday."""
    counts = _slots(spark, sf_dir).groupBy("slot").agg(F.count("*").alias("n"))
    return _round(baseline.build(counts, "slot", "n"), "mean", "std")


@query(f"WITH {_H} SELECT slot, n, round((n - mean) / nullif(std, 0), 6) AS z, CASE WHEN (n - mean) / nullif(std, 0) IS NULL THEN 'unknown' WHEN round((n - mean) / nullif(std, 0), 6) > 1.5 THEN 'big' WHEN round((n - mean) / nullif(std, 0), 6) < 0.25 THEN 'slow' ELSE 'average' END AS kind FROM v JOIN b ON b.halfhour = CAST(hour(slot) * 60 + minute(slot) AS INT) AND b.day = dayname(slot)")
def activity_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each half hour against the baseline: busy, average or slow."""
    counts = _slots(spark, sf_dir).groupBy("slot").agg(F.count("*").alias("n"))
    return baseline.classify(counts, baseline.build(counts, "slot", "n"), "slot", "n").select("slot", "n", F.round("z", 6).alias("z"), "kind")


@query(
    f"WITH {_H}, p AS (SELECT day, CASE WHEN halfhour > 0 AND halfhour <= 360 THEN 'night' WHEN halfhour > 360 AND halfhour <= 720 THEN 'morning' WHEN halfhour > 720 AND halfhour <= 1080 THEN 'afternoon' WHEN halfhour > 1080 THEN 'evening' END AS period, mean FROM b) "
    "SELECT day, period, round(avg(mean), 6) AS mean, CAST(rank() OVER (ORDER BY round(avg(mean), 6) DESC) AS INT) AS rank FROM p WHERE period IS NOT NULL GROUP BY 1, 2"
)
def period_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekday and quarter of the day by mean activity; midnight falls into none. At most 28 rows are ranked."""
    counts = _slots(spark, sf_dir).groupBy("slot").agg(F.count("*").alias("n"))
    base = baseline.build(counts, "slot", "n").withColumn("period", dates.period(F.col("halfhour"))).where("period is not null")
    means = base.groupBy("day", "period").agg(F.round(F.avg("mean"), 6).alias("mean"))
    return means.withColumn("rank", F.rank().over(W.orderBy(F.desc("mean"))))


@query(f"WITH {_H} SELECT halfhour, day, round(mean, 6) AS mean FROM b WHERE round(mean, 6) = (SELECT max(round(mean, 6)) FROM b)")
def busiest_halfhour(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _slots(spark, sf_dir).groupBy("slot").agg(F.count("*").alias("n"))
    base = _round(baseline.build(counts, "slot", "n"), "mean")
    top = base.agg(F.max("mean").alias("mean"))
    return base.join(F.broadcast(top), "mean", "left_semi").select("halfhour", "day", "mean")  # one row


@query("SELECT event_id, user_id, event_type FROM (SELECT *, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events) WHERE n >= 6")
def group_size_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.keep_groups(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], 6)


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The earliest row of each group, as an aggregate that combines before the shuffle."""
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    return best.select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id, CAST(rn AS INT) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn <= 50")
def topn_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 50 rows of each agency; Spark drops all but each task's first 50 of a group before the shuffle."""
    w = W.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return table(spark, sf_dir, "events").select("event_id", "user_id", "ts").withColumn("rn", F.row_number().over(w)).where("rn <= 50").select("event_id", "user_id", "rn")


@query(f"WITH {roles.LOG} SELECT topic, day, event_id, bias FROM (SELECT topic, CAST(ts AS DATE) AS day, event_id, bias, row_number() OVER (PARTITION BY topic, CAST(ts AS DATE) ORDER BY abs(bias), event_id) AS rn FROM log) WHERE rn = 1")
def argmin_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each group the row with the least absolute bias."""
    best = roles.access_log(spark, sf_dir).groupBy("topic", F.to_date("ts").alias("day")).agg(F.min_by(F.struct("event_id", "bias"), F.struct(F.abs("bias"), "event_id")).alias("m"))
    return best.select("topic", "day", "m.event_id", "m.bias")


@query("WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1) SELECT day, n, n < (SELECT median(n) FROM d) AS slow FROM d")
def slow_day_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return daily.join(F.broadcast(daily.agg(F.median("n").alias("m"))), how="cross").select("day", "n", (F.col("n") < F.col("m")).alias("slow"))  # one row


@query("SELECT CAST(ts AS DATE) AS day, round(avg(value), 6) AS value_mean, round(median(value), 6) AS value_median FROM events GROUP BY 1")
def daily_mean_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("value_mean"), F.round(F.median("value"), 6).alias("value_median"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds, round(stddev_samp(value), 6) AS std FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1 AND stddev_samp(value) > 0.1")
def varied_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("kinds"), F.stddev_samp("value").alias("std"))
    return _round(g.where("kinds > 1 and std > 0.1"), "std")


@query("SELECT count(value) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, min(value) AS low, round(quantile_cont(value, 0.25), 6) AS q1, round(median(value), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS high FROM events")
def summary_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6)
    return table(spark, sf_dir, "events").agg(
        F.count("value").alias("n"), r(F.avg("value")).alias("mean"), r(F.stddev_samp("value")).alias("std"), F.min("value").alias("low"), r(F.percentile("value", 0.25)).alias("q1"), r(F.median("value")).alias("median"), r(F.percentile("value", 0.75)).alias("q3"), F.max("value").alias("high")
    )


@query("SELECT CAST(CASE WHEN value < 0 THEN 0 WHEN value >= 500 THEN 51 ELSE floor(value / 10) + 1 END AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 50).withColumnRenamed("count", "n")


@query("SELECT max(ts) AS latest, min(ts) AS earliest, max(ts) - INTERVAL 30 MINUTE AS cutoff FROM events")
def latest_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").agg(F.max("ts").alias("latest"), F.min("ts").alias("earliest"), (F.max("ts") - F.expr("interval 30 minutes")).alias("cutoff"))


@query("SELECT s_suppkey, s_name, s_acctbal, CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END AS shown, CAST(row_number() OVER (ORDER BY CASE WHEN s_acctbal < 0 THEN NULL ELSE s_acctbal END ASC NULLS LAST, regexp_replace(s_name, '^The ', ''), s_suppkey) AS INT) AS place FROM supplier QUALIFY place > 25 AND place <= 50")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 25 of a table sorted with nulls last and leading articles ignored (paging is the feature)."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_acctbal").withColumn("shown", F.when(F.col("s_acctbal") < 0, None).otherwise(F.col("s_acctbal")))
    page = s.orderBy(F.asc_nulls_last("shown"), F.regexp_replace("s_name", "^The ", ""), "s_suppkey").limit(50)
    w = W.orderBy(F.asc_nulls_last("shown"), F.regexp_replace("s_name", "^The ", ""), "s_suppkey")
    return page.withColumn("place", F.row_number().over(w)).where("place > 25")


@query(f"WITH {roles.LOG} SELECT topic, CAST(count(*) AS BIGINT) AS total, CAST(row_number() OVER (ORDER BY count(*) DESC, topic) AS INT) AS place FROM log GROUP BY 1")
def topic_column_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which order the columns of the day by topic table stand: by their totals. One row per topic is ranked."""
    return frames.by_total(roles.access_log(spark, sf_dir), "topic")


_DAYS = "s AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(ts AS DATE)) FROM log), (SELECT max(CAST(ts AS DATE)) FROM log), INTERVAL 1 DAY)) AS DATE) AS day)"


@query(
    f"WITH {roles.LOG}, {_DAYS}, k AS (SELECT DISTINCT topic, bias FROM log WHERE topic = 'purchase'), c AS (SELECT CAST(ts AS DATE) AS day, bias, count(*) AS n FROM log WHERE topic = 'purchase' GROUP BY 1, 2), "
    "f AS (SELECT s.day, k.bias, coalesce(n, 0) AS n FROM s CROSS JOIN k LEFT JOIN c ON c.day = s.day AND c.bias = k.bias) SELECT day, bias, n, CAST(coalesce(sum(n) OVER (PARTITION BY day ORDER BY bias ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM f"
)
def bias_stack_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a topic per bias on every day of the log, 0 on days without one, with the base of the stacked bars."""
    log = roles.access_log(spark, sf_dir)
    counts = log.where("topic = 'purchase'").groupBy(F.to_date("ts").alias("day"), "bias").agg(F.count("*").alias("n"))
    days = frames.spine(log.select(F.to_date("ts").alias("day")), "day")
    filled = frames.fill_spine(counts, days, "day", counts, "bias", "n")
    return frames.stacked_base(filled, "n", ["day"], ["bias"]).select("day", "bias", "n", "base")


@query(
    f"WITH {roles.AGENCY}, c AS (SELECT bias, credibility, count(*) AS n FROM agency WHERE (bias + credibility) % 3 <> 0 GROUP BY 1, 2), g AS (SELECT * FROM (SELECT DISTINCT bias FROM c), (SELECT DISTINCT credibility FROM c)) "
    "SELECT bias, credibility, coalesce(n, 0) AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY bias) * 100, 6) AS pct FROM g LEFT JOIN c USING (bias, credibility)"
)
def cred_share_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Credibility shares within each bias, 0 for pairs that no agency has."""
    some = roles.agencies(spark, sf_dir).where("(bias + credibility) % 3 <> 0")
    counts = some.groupBy("bias", "credibility").agg(F.count("*").alias("n"))
    filled = frames.fill_pairs(counts, "bias", "credibility", "n")
    return filled.select("bias", "credibility", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("bias")) * 100, 6).alias("pct"))


@query("SELECT user_id, round(avg(CASE WHEN isnan(value) THEN NULL ELSE value END), 6) AS score FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f, (SELECT max(ts) FROM events) - INTERVAL 2 DAY AS since FROM events) WHERE ts > f + INTERVAL 1 DAY AND ts > since GROUP BY 1")
def agency_recent_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score per agency over the last two days of the log, without the agency's first day."""
    events = table(spark, sf_dir, "events")
    later = frames.after_first_day(events, "user_id", "ts")
    since = F.broadcast(events.agg((F.max("ts") - F.expr("interval 2 days")).alias("since")))  # one row
    recent = later.join(since, how="cross").where("ts > since")
    return _round(recent.groupBy("user_id").agg(F.avg(numbers.no_nan(F.col("value"))).alias("score")), "score")


@query("SELECT event_id, strftime(ts, '%b %-d %-I:%M %p') AS shown, CAST(row_number() OVER (ORDER BY strftime(ts, '%b %-d %-I:%M %p') DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 25")
def text_date_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of a table that is sorted by its dates as text, as the reference sorts it (the page is the feature)."""
    shown = table(spark, sf_dir, "events").select("event_id", dates.shown(F.col("ts")).alias("shown"))
    return frames.page(shown, [F.desc("shown"), F.col("event_id")], 1)


@query("SELECT event_id, ts, CAST(row_number() OVER (ORDER BY ts DESC, event_id) AS INT) AS place FROM events QUALIFY place <= 25")
def date_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sorted by time."""
    return frames.page(table(spark, sf_dir, "events").select("event_id", "ts"), [F.desc("ts"), F.col("event_id")], 1)


@query("SELECT c_custkey, c_name, CAST(row_number() OVER (ORDER BY c_name, c_custkey) AS INT) AS place FROM customer WHERE contains(lower(c_name), '00001') QUALIFY place <= 25")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of the rows that hold a search word in any case (the page is the feature)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return frames.page(c.where(F.contains(F.lower("c_name"), F.lit("00001"))), [F.col("c_name"), F.col("c_custkey")], 1)


_SHOWN = {"shown": "%b %-d %-I:%M %p", "day": "%A, %B %-d", "iso": "%Y-%m-%dT%H:%M:%S", "stamp": "%Y%m%d%H%M%S", "clock": "%-I:%M %p", "year": "%Y"}


@query("SELECT event_id, " + ", ".join(f"strftime(ts, '{f}') AS {n}" for n, f in _SHOWN.items()) + " FROM events")
def date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times as the pages show them."""
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", dates.shown(ts).alias("shown"), *[F.date_format(ts, p).alias(n) for n, p in dates.PATTERNS.items()])
