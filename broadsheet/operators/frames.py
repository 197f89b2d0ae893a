"""DataFrame -> DataFrame operators on headline and access-log frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.functions import numbers
from broadsheet.scratch import maybe_broadcast


def rolling_mean(df: DataFrame, columns: list[str], order: list[str], rows: int = 7, by: list[str] | None = None, suffix: str = "_ma") -> DataFrame:
    """Mean of the last ``rows`` rows, null until there are so many. Rows, not days: gaps collapse.

    Without ``by`` the frame is one series (one row per day or group, so it is small) and runs through groups, which is
    the reference behaviour; with ``by`` it restarts in each.
    """
    w = (W.partitionBy(*by) if by else W.partitionBy()).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumns({c + suffix: F.when(F.count(c).over(w) == rows, F.avg(c).over(w)) for c in columns})


def daily_means(df: DataFrame, ts: str, values: dict[str, Column]) -> DataFrame:
    """Means per day that skip NaN; days without one of the means are dropped."""
    return df.groupBy(F.to_date(ts).alias("day")).agg(*[F.avg(numbers.no_nan(v)).alias(n) for n, v in values.items()]).na.drop("any")


def spine(df: DataFrame, day: str, step_days: int = 1, first: Column | None = None) -> DataFrame:
    """Every day (or week label) from the first to the last of ``df``."""
    ends = df.agg(F.min(day).alias("a"), F.max(day).alias("b"))
    return ends.select(F.explode(F.sequence(first if first is not None else F.col("a"), F.col("b"), F.expr(f"interval {step_days} days"))).alias(day))


def fill_spine(counts: DataFrame, spine_days: DataFrame, day: str, groups: DataFrame, group: str, value: str) -> DataFrame:
    """One row for each day and group, 0 where nothing was counted. The result has days times groups rows by its meaning."""
    known = groups.select(group).distinct()
    grid = spine_days.join(maybe_broadcast(known, known.count()), how="cross")
    return grid.join(counts, [day, group], "left").withColumn(value, F.coalesce(value, F.lit(0).cast("long")))


def stacked_base(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Where each bar of a stack begins: the running sum of those before it."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("base", F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))


def first_of(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each group in a total order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def keep_groups(df: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of groups that have at least ``least`` rows: counted first, so that a hot group is not sorted in one task."""
    large = df.groupBy(*by).count().where(F.col("count") >= least).select(*by)
    return df.join(large, by, "left_semi")


def dedupe(df: DataFrame, key: str, first_seen: str, last_seen: str, id_col: str) -> DataFrame:
    """Of rows with an equal key the one seen first stays (least id among equals), with the group's last sighting.

    Both are aggregates that combine before the shuffle, so a key that a third of the rows share is no bottleneck.
    """
    rest = [c for c in df.columns if c not in (key, last_seen)]
    best = F.min_by(F.struct(*rest), F.struct(first_seen, id_col)).alias("_row")
    return df.groupBy(key).agg(best, F.max(last_seen).alias(last_seen)).select(*[F.col(f"_row.{c}").alias(c) for c in rest], key, last_seen)


def agency_rollup(headlines: DataFrame) -> DataFrame:
    """Per agency name: attributes, churn (headlines per article), mean scores to two digits, half to even.

    Nine digits come first, so that the order in which a mean was summed cannot tip a half.
    """
    return headlines.groupBy("agency").agg(
        F.any_value("credibility").alias("credibility"),
        F.any_value("bias").alias("bias"),
        F.any_value("country").alias("country"),
        F.bround(F.round(F.count("headline_id") / F.countDistinct("article_id"), 9), 2).alias("churn"),
        F.bround(F.round(F.avg("vader"), 9), 2).alias("vader"),
        F.bround(F.round(F.avg("afinn"), 9), 2).alias("afinn"),
    )


def agency_metrics(rollup: DataFrame, country: Column) -> DataFrame:
    """Medians and means over the roll-ups (rounded as they are) of one country."""
    own = rollup.where(country)
    return own.agg(
        F.median("vader").alias("median_vader"),
        F.avg("vader").alias("mean_vader"),
        F.avg(F.col("bias") * F.col("vader")).alias("partisan_mean_vader"),
        F.median("afinn").alias("median_afinn"),
        F.avg("afinn").alias("mean_afinn"),
        F.avg(F.col("bias") * F.col("afinn")).alias("partisan_mean_afinn"),
    )


def emphasis(df: DataFrame, position: str, duration: str) -> DataFrame:
    """1 / (1 + position) times duration, scaled to 0..1 over the frame; null where all are equal."""
    raw = df.withColumn("positionnorm", 1 / (1 + F.col(position))).withColumn("_e", F.col("positionnorm") * F.col(duration))
    ends = F.broadcast(raw.agg(F.min("_e").alias("_lo"), F.max("_e").alias("_hi")))
    return raw.join(ends, how="cross").withColumn("emphasis", F.try_divide(F.col("_e") - F.col("_lo"), F.col("_hi") - F.col("_lo"))).drop("_e", "_lo", "_hi")


def share(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """Per cent of each group's rows in each subgroup."""
    counts = df.groupBy(*by).count()
    total = F.sum("count").over(W.partitionBy(*within) if within else W.partitionBy())
    return counts.withColumn("pct", F.col("count") / total * 100)


def live(df: DataFrame, as_of: Column, days: int = 3) -> DataFrame:
    """Rows still seen at ``as_of`` and first seen not long before."""
    return df.where((F.col("last_accessed") > as_of) & (F.col("first_accessed") > as_of - F.expr(f"interval {days} days")))


def after_first_day(df: DataFrame, by: str, ts: str) -> DataFrame:
    """Rows later than a day after their group's first one."""
    first = df.groupBy(by).agg((F.min(ts) + F.expr("interval 1 day")).alias("_from"))
    return df.join(first, by).where(F.col(ts) > F.col("_from")).drop("_from")


def churn_on(df: DataFrame, day: Column, headline: str, article: str) -> DataFrame:
    """Headlines per article of a day, 1 if there is none."""
    seen = df.agg(F.countDistinct(F.when(day, F.col(headline))).alias("headlines"), F.countDistinct(F.when(day, F.col(article))).alias("articles"))
    return seen.withColumn("churn", F.when(F.col("articles") == 0, 1.0).otherwise(F.try_divide(F.col("headlines"), F.col("articles"))))


def short_lived(df: DataFrame, first: str, last: str, days: int = 3) -> DataFrame:
    """Rows that were up for at most so many days."""
    return df.where(F.col(last) - F.col(first) <= F.expr(f"interval {days} days"))


def _draw(key: str, seed: int) -> Column:
    """A number from 0 to 1 that depends on the key and the seed only, so a rerun or another partitioning draws alike."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("double") / 2**32


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``part``: train for about ``share`` of the rows, test for the others."""
    return df.withColumn("part", F.when(_draw(key, seed) < share, "train").otherwise("test"))


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows at random (the number is the feature): each task keeps its first n of the drawn order."""
    return df.withColumn("_d", _draw(key, seed)).orderBy("_d", key).limit(n).drop("_d")


def fill_pairs(counts: DataFrame, left: str, right: str, value: str) -> DataFrame:
    """One row for each left and right value that occur, 0 where they do not occur together. Both are enumerations."""
    grid = counts.select(left).distinct().join(F.broadcast(counts.select(right).distinct()), how="cross")
    return grid.join(counts, [left, right], "left").withColumn(value, F.coalesce(value, F.lit(0).cast(counts.schema[value].dataType)))


def non_empty(parts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The frames that have a row; what comes after skips the others."""
    return {name: df for name, df in parts.items() if not df.isEmpty()}


def required(df: DataFrame, what: str) -> DataFrame:
    """The frame, or an error that names what is missing."""
    if df.isEmpty():
        raise LookupError(f"no rows: {what}")
    return df


def by_total(df: DataFrame, column: str) -> DataFrame:
    """(value, total, place) of the values of an enumeration, the most frequent first."""
    totals = df.groupBy(column).agg(F.count("*").alias("total"))
    return totals.withColumn("place", F.row_number().over(W.orderBy(F.desc("total"), column)))


def page(df: DataFrame, order: list[Column], number: int, rows: int = 25) -> DataFrame:
    """One page of a sorted table with the place of each row: only the rows up to its end are gathered and ranked."""
    top = df.orderBy(*order).limit(number * rows)
    return top.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") > (number - 1) * rows)


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    return df.groupBy(F.width_bucket(value, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).count()
