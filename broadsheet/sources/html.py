"""Links and text of front pages.

``front_page_rules.tsv`` holds fixed values: addresses, enumerations and patterns that decide which links are found.

``links`` takes the plain anchors with Spark's own regular expressions. ``extract_links`` applies a table of rules, one row
per agency, in an Arrow map: short programs that say which links count, what becomes their title, and which are left out.
"""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from broadsheet.session import small_batches
from broadsheet.sources.dom import Page, Tests
from broadsheet.sources.front_pages import AGENT, AGENTS

ANCHOR = r'<a href="([^"]*)"[^>]*>([^<]*)</a>'


def links(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, position, href, title) of the anchors whose text has no markup."""
    both = F.arrays_zip(F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(1)).alias("href"), F.regexp_extract_all(html_col, F.lit(ANCHOR), F.lit(2)).alias("title"))
    return pages.select(id_col, F.posexplode(both).alias("position", "a")).select(id_col, "position", F.col("a.href").alias("href"), F.col("a.title").alias("title"))


@dataclass(frozen=True)
class Step:
    """One move through a page: ``first`` or ``all`` inside, the nearest ``up``, the first ``down``; ``drop`` leaves the
    first such element out of what follows."""

    move: str
    tags: tuple[str, ...]
    tests: Tests


def _selector(text: str) -> tuple[tuple[str, ...], Tests]:
    """``tag,tag ;; attribute=pattern ;; attribute=``: an empty pattern asks for presence. Patterns are searched for."""
    tags, *tests = text.split(" ;; ")
    return tuple(tags.strip().split(",")), tuple((n, p or None) for n, _, p in (x.partition("=") for x in tests))


@dataclass(frozen=True)
class Rule:
    """One agency's way of finding headlines on its front page.

    ``steps`` is a program, its steps parted by `` > ``: ``first main ;; class=^page$ > all a ;; href=/story/`` (several
    programs, run one after the other, by `` || ``). ``title`` says what becomes the title: nothing for the whole link,
    ``@attribute``, or a selector inside the link, with `` | link`` for the whole link where it is missing; without that the
    link is left out. ``need`` says what must hold text for a link to count: nothing, ``link``, ``match`` for what the last
    ``all`` found, or a selector as above. ``exclude`` are patterns on the href, ``exclude_titles`` on the text of ``need``, or
    of the link. ``cut`` is removed from the href, and ``base`` put before it. A link without a href is left out.
    """

    agency: str
    steps: str = "all a ;; href="
    title: str = ""
    need: str = ""
    exclude: tuple[str, ...] = ()
    exclude_titles: tuple[str, ...] = ()
    base: str = ""
    cut: str = ""

    def programs(self) -> list[list[Step]]:
        """The compiled steps."""
        moves = [[x.strip().partition(" ") for x in p.split(" > ")] for p in self.steps.split(" || ")]
        return [[Step(m, *_selector(rest)) for m, _, rest in p] for p in moves]

    def is_plain(self) -> bool:
        """Whether the rule is one test of the href of any link, whose whole text is the title."""
        (one, *more), *others = self.programs()
        tests = one.tests
        return not more and not others and one.move == "all" and one.tags == ("a",) and len(tests) == 1 and tests[0][0] == "href" and not (self.title or self.exclude or self.exclude_titles or self.base or self.cut) and self.need in ("", "link")


def _cleaned(text: str) -> str:
    """A string node without conditional comments and raw JSON."""
    if "[" in text:
        text = re.sub(r"\[if.*?\].*\[endif\]", "", text, flags=re.S)
    if "{" in text:
        text = re.sub(r"\{.*?\}", "", text, flags=re.S)
    return text.replace("\\n", "").strip()


class Finder:
    """A rule ready to run over pages."""

    def __init__(self, rule: Rule):
        self.rule, self.compiled = rule, rule.programs()
        self.title = self._choice(rule.title) if rule.title and rule.title[0] != "@" else None
        self.need = self._choice(rule.need) if rule.need not in ("", "link", "match") else None

    @staticmethod
    def _choice(text: str) -> tuple[tuple[tuple[str, ...], Tests], bool]:
        chosen, _, other = text.partition(" | ")
        return _selector(chosen), other == "link"

    @staticmethod
    def _chosen(page: Page, link: int, choice: tuple) -> int | None:
        selector, otherwise = choice
        return next(page.inside(link, *selector), link if otherwise else None)

    def _matches(self, page: Page, program: list[Step]) -> Iterator[tuple[int, int]]:
        """(what the last ``all`` found, the link)."""
        at, dropped = [(0, 0)], []
        for step in program:
            if step.move == "drop":
                dropped += [(x, page.end[x]) for n, _ in at for x in page.inside(n, step.tags, step.tests)][:1]
                continue
            after = []
            for match, node in at:
                if step.move == "up":
                    found = page.around(node, step.tags, step.tests)
                    after += [(match, found)] if found is not None else []
                    continue
                inside = (x for x in page.inside(node, step.tags, step.tests) if not any(a <= x < b for a, b in dropped))
                if step.move == "all":
                    after += [(x, x) for x in inside]
                else:
                    after += [(x if step.move == "first" else match, x) for x in [next(inside, None)] if x is not None]
            at = after
        yield from at

    def run(self, page: Page) -> Iterator[tuple[str, str]]:
        """(href, title) of every link, in the order in which they are found."""
        rule = self.rule
        for program in self.compiled:
            for match, link in self._matches(page, program):
                href = page.attrs[link].get("href")
                if href is None or any(re.search(p, href) for p in rule.exclude):
                    continue
                judged = match if rule.need == "match" else self._chosen(page, link, self.need) if self.need else link
                text = page.seen(judged) if judged is not None else ""
                if (rule.need and not text) or any(re.search(p, text) for p in rule.exclude_titles):
                    continue
                if rule.title.startswith("@"):
                    title = _cleaned(page.attrs[link].get(rule.title[1:], ""))
                else:
                    chosen = self._chosen(page, link, self.title) if self.title else link
                    if chosen is None:
                        continue
                    title = " ".join(_cleaned(x) for x in page.all_strings(chosen))
                yield rule.base + (re.sub(rule.cut, "", href) if rule.cut else href), title


#: Links that a Python worker holds before it hands them on.
BATCH_LINKS = 10_000


def extract_links(pages: DataFrame, rules: list[Rule], agency_col: str | None = "agency", html_col: str = "html", id_col: str | None = None) -> DataFrame:
    """(id if asked for, agency, position, href, title) by the rule of each page's agency, or by all rules without an agency
    column. A page is parsed once; pages of other agencies and null pages give nothing. Positions count a rule's links."""
    table = {r.agency: Finder(r) for r in rules}
    keys, k = [F.col(id_col)] if id_col else [], 1 if id_col else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(batch: pa.RecordBatch, at: list[int], rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), (), ()]
            made = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))]
            ids = [batch.column(0).take(pa.array(at, pa.int64()))] if k else []
            return pa.RecordBatch.from_arrays([*ids, *made], names=[*([id_col] if k else []), "agency", "position", "href", "title"])

        for batch in batches:
            at, rows = [], []
            for n, (agency, source) in enumerate(zip(batch.column(k), batch.column(k + 1))):
                wanted = list(table) if agency_col is None else [a for a in [agency.as_py()] if a in table]
                if not wanted or not source.is_valid:
                    continue
                page = Page(source.as_py())
                for name in wanted:
                    for place, x in enumerate(table[name].run(page)):
                        at.append(n)
                        rows.append((name, place, *x))
                        if len(rows) == BATCH_LINKS:
                            yield packed(batch, at, rows)
                            at, rows = [], []
            yield packed(batch, at, rows)

    small_batches(pages.sparkSession)
    agency = F.col(agency_col) if agency_col else F.lit(None).cast("string")
    source = pages.select(*keys, agency.alias("agency"), F.col(html_col).alias("html"))
    schema = "agency string, position int, href string, title string"
    return source.mapInArrow(run, f"`{id_col}` {dict(source.dtypes)[id_col]}, {schema}" if keys else schema)


class _Strings(HTMLParser):
    """All string nodes, comments, scripts and styles included."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        self.parts.append(_cleaned(data))

    def handle_comment(self, data: str) -> None:
        self.parts.append(_cleaned(data))


RULES = Path(__file__).with_name("front_page_rules.tsv")


def load_rules(path: str | Path = RULES, registered_only: bool = True) -> list[Rule]:
    """The rule table: one row per agency, in the words of :class:`Rule`; excluded patterns are parted by `` ;; ``."""
    out = []
    with open(path, encoding="utf-8", newline="") as f:
        for r in csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE):
            if registered_only and r["registered"] != "yes":
                continue
            listed = lambda c, r=r: tuple(x for x in (r[c] or "").split(" ;; ") if x)
            base = r["url"] if r["address"] == "base" else ""
            out.append(Rule(r["agency"], r["steps"], r["title"], r["need"], listed("exclude_href"), listed("exclude_title"), base, r["cut"]))
    return out


def agencies(spark: SparkSession, path: str | Path = RULES) -> DataFrame:
    """The agencies of the rule table: name, address, bias, credibility, country, how their page is fetched, and as whom."""
    with open(path, encoding="utf-8", newline="") as f:
        rows = [(r["agency"], r["url"], int(r["bias"]), int(r["credibility"]), r["country"], r["fetch"], r["registered"] == "yes", AGENTS.get(r["agent"], AGENT)) for r in csv.DictReader(f, delimiter="\t", quoting=csv.QUOTE_NONE)]
    return spark.createDataFrame(rows, "agency string, url string, bias int, credibility int, country string, fetch string, registered boolean, user_agent string")


def _text(page: str) -> str:
    finder = _Strings()
    finder.feed(page)
    finder.close()
    return " ".join(finder.parts)


@F.arrow_udf(T.StringType())
def _texts(pages: pa.Array) -> pa.Array:
    # One page after the other becomes a Python string, and only texts are kept.
    return pa.array((_text(p.as_py()) if p.is_valid else None for p in pages), pa.string())


def extract_text(page: Column | str) -> Column:
    """Text of a fragment: its string nodes, stripped and joined by one space, empty ones included. Null stays null."""
    small_batches(SparkSession.active())
    return _texts(page)
