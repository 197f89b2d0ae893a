"""From front pages to the headline store, batch by batch, with counters for each agency.

A page gives links by its agency's rule, links become headlines (valid address, several words, clean text), and headlines
are merged into a snapshot: first and last sighting for each clean text. What a run found is counted for each agency in the
pass that writes the headlines; counts of new ones compare with the snapshot before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.scratch import checkpoint_dir
from broadsheet.sources import html
from broadsheet.streaming.first_last import _delete, versions

STORE = "processed string, first_accessed timestamp, last_accessed timestamp, href string, agency string"
FOUND = "agency string, position int, href string, title string, processed string, fetched timestamp, counts boolean"


def headlines(pages: DataFrame, rules: list[html.Rule]) -> DataFrame:
    """``FOUND``: every link of the pages (agency, url, fetched, html); ``counts`` says whether it is a headline."""
    source = pages.where("html is not null").select(F.struct("agency", "url", "fetched").alias("page"), "agency", "html")
    links = html.extract_links(source, rules, id_col="page")
    base = F.regexp_extract("page.url", "^[a-z]+://[^/?]+", 0)
    made = links.select("agency", "position", tx.clean_href("href", base).alias("href"), "title", F.col("page.fetched").alias("fetched"))
    made = made.withColumn("processed", tx.preprocess("title"))
    counts = tx.is_url("href") & tx.many_words("title") & F.col("processed").isNotNull() & (F.col("processed") != "")
    return made.select("agency", "position", "href", "title", "processed", "fetched", F.coalesce(counts, F.lit(False)).alias("counts"))


def counters(found: DataFrame, store: DataFrame, seconds: Column | None = None) -> DataFrame:
    """For each agency: links found, articles and headlines that the store lacks, headlines that it holds (``updated``), and,
    with ``seconds`` for an agency's run, the mean seconds for each link.

    A headline that a page shows twice is one; an article is new if no headline of the store has its address.
    """
    kept = found.where("counts")
    known = store.select(F.unhex(F.md5("processed")).alias("_p")).distinct().withColumn("_known", F.lit(True))
    addresses = store.select(F.unhex(F.md5("href")).alias("_h")).distinct().withColumn("_article", F.lit(True))
    one = kept.groupBy("agency", F.unhex(F.md5("processed")).alias("_p")).agg(F.min_by("href", "position").alias("href")).join(known, "_p", "left")
    new = one.where("_known is null").withColumn("_h", F.unhex(F.md5("href"))).join(addresses, "_h", "left")
    by_headline = one.groupBy("agency").agg(F.count_if(F.col("_known").isNull()).alias("headlines"), F.count_if("_known").alias("updated"))
    by_article = new.where("_article is null").groupBy("agency").agg(F.countDistinct("_h").alias("articles"))
    # An agency's links are counted before the joins, so that each of these has one row for an agency.
    out = found.groupBy("agency").agg(F.count("*").alias("found"), *([F.max(seconds).alias("_seconds")] if seconds is not None else []))
    out = out.join(by_headline, "agency", "left").join(by_article, "agency", "left")
    columns = [F.coalesce(c, F.lit(0)).alias(c) for c in ("articles", "headlines", "updated")]
    mean = [F.try_divide("_seconds", "found").alias("seconds_each")] if seconds is not None else []
    return out.select("agency", "found", *columns, *mean)


def day_report(counted: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """(agency, line, exceptions): a line ``agency: (articles,headlines,updated)`` for each agency, summed over the runs of
    ``counted``, and the messages of ``errors`` (agency, error), of which equal ones count once."""
    summed = counted.groupBy("agency").agg(*[F.sum(c).alias(c) for c in ("articles", "headlines", "updated")])
    line = F.concat(F.col("agency"), F.lit(": ("), F.concat_ws(",", *[F.col(c).cast("string") for c in ("articles", "headlines", "updated")]), F.lit(")"))
    # Made before the join: an agency that is only in the errors has no counts.
    summed = summed.select("agency", line.alias("line"))
    if errors is None:
        return summed.select("agency", "line", F.array().cast("array<string>").alias("exceptions"))
    said = errors.where("error is not null").groupBy("agency").agg(F.sort_array(F.collect_set("error")).alias("exceptions"))
    none = F.array().cast("array<string>")
    return summed.join(said, "agency", "full").select("agency", F.coalesce("line", F.concat("agency", F.lit(": (0,0,0)"))).alias("line"), F.coalesce("exceptions", none).alias("exceptions"))


def ingest(pages: DataFrame, rules: list[html.Rule], name: str) -> tuple[DataFrame, DataFrame]:
    """Runs the stream of pages as far as it goes; the last snapshot (``STORE``) and the counters of every batch.

    Each batch writes its own version of the snapshot and its own counters, named by its number, so that a batch that runs
    again rewrites only these; the version before stays until the next one is there.
    """
    spark: SparkSession = pages.sparkSession
    root = f"{checkpoint_dir(spark)}/broadsheet/{name}"

    def batch(df: DataFrame, n: int) -> None:
        own = df.sparkSession
        # A batch is fetched once: everything below reads what is written here.
        df.write.mode("overwrite").parquet(f"{root}/pages/p{n}")
        fetched = own.read.schema(df.schema).parquet(f"{root}/pages/p{n}")
        headlines(fetched, rules).write.mode("overwrite").parquet(f"{root}/found/f{n}")
        found = own.read.schema(FOUND).parquet(f"{root}/found/f{n}")
        done = [v for v in versions(own, f"{root}/store") if v < n]
        store = own.read.schema(STORE).parquet(f"{root}/store/v{done[-1]}") if done else own.createDataFrame([], STORE)
        counters(found, store).withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{root}/counters/c{n}")
        kept = found.where("counts").select("processed", F.col("fetched").alias("first_accessed"), F.col("fetched").alias("last_accessed"), "href", "agency")
        both = store.unionByName(kept)
        first = lambda c: F.min_by(c, F.struct("first_accessed", "agency", "href")).alias(c)
        merged = both.groupBy("processed").agg(F.min("first_accessed").alias("first_accessed"), F.max("last_accessed").alias("last_accessed"), first("href"), first("agency"))
        merged.write.mode("overwrite").parquet(f"{root}/store/v{n}")
        for v in done[:-1]:
            _delete(own, f"{root}/store/v{v}")
        _delete(own, f"{root}/pages/p{n}")

    query = pages.writeStream.foreachBatch(batch).option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    done = versions(spark, f"{root}/store")
    store = spark.read.schema(STORE).parquet(f"{root}/store/v{done[-1]}") if done else spark.createDataFrame([], STORE)
    counted = spark.read.parquet(f"{root}/counters/*") if done else spark.createDataFrame([], "agency string, found long, articles long, headlines long, updated long, batch int")
    return store, counted
