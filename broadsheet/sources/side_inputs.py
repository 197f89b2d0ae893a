"""Topics, special dates and the newsiness baseline from their files, with explicit schemas."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TOPICS = "topic_id int, name string, color string, keywords array<string>, essential array<string>"
SPECIAL_DATES = "i int, name string, topic string, date date"
NEWSINESS = "halfhour int, day string, mean double, median double, std double"


def topics(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Numbered from 1 in file order; a missing list is empty."""
    import yaml

    rows = [(n, str(t["name"]), t.get("color"), [str(k) for k in t.get("keywords") or []], [str(k) for k in t.get("essential") or []]) for n, t in enumerate(yaml.safe_load(yaml_text) or [], 1)]
    return spark.createDataFrame(rows, TOPICS)


def special_dates(spark: SparkSession, yaml_text: str) -> DataFrame:
    """Numbered from 1 in file order, which is not the order of dates."""
    import yaml

    def day(d: object) -> datetime.date:
        return d if isinstance(d, datetime.date) else datetime.date.fromisoformat(str(d))

    rows = [(n, str(x["name"]), str(x["topic"]), day(x["date"])) for n, x in enumerate(yaml.safe_load(yaml_text) or [], 1)]
    return spark.createDataFrame(rows, SPECIAL_DATES)


def dates_of(special: DataFrame, topic: str) -> DataFrame:
    """The special dates of a topic, and those of all topics."""
    return special.where(special.topic.isin(topic, "all")).orderBy("date", "i")


def dated(topics: DataFrame, special: DataFrame) -> DataFrame:
    """(topic_id, i, name, date, place): the special dates of every topic by its name, with those of all topics, numbered
    by date. Dates of all topics are written out for each topic, which is their meaning: the list of topics is one row."""
    ids = topics.agg(F.collect_list("topic_id").alias("_ids"))
    everywhere = special.where("topic = 'all'").join(F.broadcast(ids)).withColumn("topic_id", F.explode("_ids"))
    own = special.join(topics.select("topic_id", F.col("name").alias("topic")), "topic")
    both = own.select("topic_id", "i", "name", "date").unionByName(everywhere.select("topic_id", "i", "name", "date"))
    return both.withColumn("place", F.row_number().over(W.partitionBy("topic_id").orderBy("date", "i")))


def newsiness(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(NEWSINESS).csv(path, header=True)


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header and a declared schema: no inference pass over the file."""
    return spark.read.schema(schema).csv(path, header=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
