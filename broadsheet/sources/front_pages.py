"""Front pages over HTTP as a Python data source: one partition per agency, fetched by the executors.

    spark.dataSource.register(FrontPages)
    spark.read.format("front_pages").option("agencies", json.dumps([{"agency": …, "url": …, "headers": {…}}])).load()
    spark.readStream.format("front_pages").option("agencies", …).option("every", 1800).load()

As a stream its offsets are the half hours (or stretches of ``every`` seconds) since 1970: a batch fetches every page once,
as it is then, however many half hours have passed since the batch before; within one half hour there is no second batch.
A restart goes on from the offset in the checkpoint. A batch that has to run again fetches again, so pages come at least
once, and what keeps them merges by key (:func:`broadsheet.streaming.pages.ingest`).

``headers`` is optional and goes over the default ones.

A page that cannot be fetched, or whose status is not 2xx, is a row with null html and the reason in ``error``.
"""

from __future__ import annotations

import datetime
import json
import ssl
import time
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

AGENT = "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/115.0"
#: What is sent to agencies that the rule table marks so: our own name, or that of a search robot (a fixed value).
AGENTS = {
    "bot": "Broadsheet Bot",
    "search": "Mozilla/5.0 AppleWebKit/537.36 (KHTML, like Gecko; compatible; Googlebot/2.1; +http://www.google.com/bot.html) Chrome/W.X.Y.Z Safari/537.36",
}
TIMEOUT_S = 60
EVERY_S = 1800


class AgencyPage(InputPartition):
    def __init__(self, agency: str, url: str, headers: dict[str, str]):
        self.agency, self.url, self.headers = agency, url, headers


class FrontPages(DataSource):
    @classmethod
    def name(cls) -> str:
        return "front_pages"

    def schema(self) -> str:
        return "agency string, url string, fetched timestamp, status int, html string, error string"

    def reader(self, schema) -> DataSourceReader:
        return FrontPageReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FrontPageStream(self.options)


class _Fetcher:
    def __init__(self, options: dict[str, str]):
        self.agencies = json.loads(options.get("agencies", "[]"))
        self.timeout = float(options.get("timeout", TIMEOUT_S))
        self.verify = options.get("verify", "false").lower() == "true"

    def pages(self) -> list[AgencyPage]:
        return [AgencyPage(a["agency"], a["url"], a.get("headers") or {}) for a in self.agencies]

    def read(self, partition: AgencyPage) -> Iterator[tuple]:
        context = ssl.create_default_context()
        if not self.verify:
            context.check_hostname, context.verify_mode = False, ssl.CERT_NONE
        now = datetime.datetime.now(datetime.timezone.utc)
        status, page, error = None, None, None
        try:
            request = urllib.request.Request(partition.url, headers={"User-Agent": AGENT} | partition.headers)
            with urllib.request.urlopen(request, timeout=self.timeout, context=context) as answer:
                status = answer.status
                page = answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
        except OSError as e:
            status, error = getattr(e, "code", None), str(e)
        yield (partition.agency, partition.url, now, status, page, error)


class FrontPageReader(_Fetcher, DataSourceReader):
    def partitions(self) -> list[AgencyPage]:
        return self.pages()


class FrontPageStream(_Fetcher, DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.every = float(options.get("every", EVERY_S))

    def initialOffset(self) -> dict:
        return {"slot": -1}

    def latestOffset(self) -> dict:
        return {"slot": int(time.time() // self.every)}

    def partitions(self, start: dict, end: dict) -> list[AgencyPage]:
        return self.pages() if end["slot"] > start["slot"] else []

    def commit(self, end: dict) -> None:
        """Nothing is kept for a batch."""
