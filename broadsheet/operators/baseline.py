"""How busy the news is: half-hour expansion, baseline statistics and z-scores against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import dates


def expand(df: DataFrame, first: str, last: str) -> DataFrame:
    """One row for each half hour in which a headline was up."""
    return df.withColumn("slot", F.explode(dates.half_hours(F.col(first), F.col(last))))


def build(values: DataFrame, slot: str, value: str) -> DataFrame:
    """Mean, median and sample deviation by half hour of the day and weekday."""
    return values.groupBy(dates.half_hour(F.col(slot)).alias("halfhour"), dates.weekday(F.col(slot)).alias("day")).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"))


def classify(values: DataFrame, baseline: DataFrame, slot: str, value: str) -> DataFrame:
    """z-score of each value and its class; ``unknown`` where the baseline has no such half hour. The baseline has at most
    336 rows."""
    keyed = values.withColumn("halfhour", dates.half_hour(F.col(slot))).withColumn("day", dates.weekday(F.col(slot)))
    z = F.try_divide(F.col(value) - F.col("mean"), F.col("std"))
    joined = keyed.join(F.broadcast(baseline), ["halfhour", "day"], "left").withColumn("z", z)
    return joined.withColumn("kind", F.when(F.col("z").isNull(), "unknown").when(F.col("z") > 1.5, "big").when(F.col("z") < 0.25, "slow").otherwise("average"))
