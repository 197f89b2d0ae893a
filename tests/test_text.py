"""Hand-made cases of the text functions."""

from __future__ import annotations

import html as html_lib
import re
import unicodedata

import pytest
import regex
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from broadsheet.functions import dates
from broadsheet.functions import text as tx
from broadsheet.plans import text  # noqa: F401  registers the queries
from broadsheet.plans.registry import QUERIES


def one(spark, f, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(f(*[F.col(c) for c in df.columns]).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Jane Doe/Getty Images", ""),
        ("Jane Doe / AP", ""),
        ("Reuters/Jane Doe", ""),
        ("Reuters/Jane Q Doe", "Reuters/Jane Q Doe"),
        ("An ordinary title", "An ordinary title"),
        ("“Smart” ‘quotes’ — dash", "\"Smart\" 'quotes' -- dash"),
        ("updated 5M ago Storm hits", "Storm hits"),
        ("Just now Storm", "Storm"),
        ("Storm 3 hours ago", "Storm"),
        ("a b   c\n\td", "a b c d"),
        ("...Dots.", "Dots"),
        ("", ""),
        (None, None),
    ],
)
def test_preprocess(spark, text, want):
    assert one(spark, tx.preprocess, text) == want


@pytest.mark.parametrize(
    ("text", "want"),
    [("breakingNews today", "breaking News today"), ("mRNA vaccine", "mRNA vaccine"), ("McDonald wins", "McDonald wins"), ("site.com rises", "site.com rises"), ("end.Next one", "end. Next one")],
)
def test_split_camelcases(spark, text, want):
    assert one(spark, tx.split_camelcases, text) == want


@pytest.mark.parametrize(("href", "want"), [("//h/p", "https://h/p"), ("/p", "https://b.com/p"), ("p", "https://b.com/p"), ("https://h/p ", "https://h/p")])
def test_clean_href(spark, href, want):
    assert one(spark, tx.clean_href, href, "https://b.com/") == want


def test_url_and_words(spark):
    urls = {"https://a.com/x": True, "notaurl": False, "ftp://a.com": False, "https://localhost": False, "http://a.co:80/?q=1": True, "https://a b.com": False}
    assert {u: one(spark, tx.is_url, u) for u in urls} == urls
    assert one(spark, tx.many_words, "one two") and not one(spark, tx.many_words, "one")


def test_tokens(spark):
    assert one(spark, tx.tokenize, "café-noir 2025 x1 naïveté --") == ["café-noir", "x1", "naïveté"]
    assert one(spark, lambda c: tx.ngrams(tx.tokenize(c), 2), "a b c") == ["a b", "b c"]
    assert one(spark, lambda c: tx.ngrams(tx.tokenize(c), 2), "a") == []
    assert one(spark, lambda c: tx.ngrams(tx.tokenize(c), 2, stopwords=["b"]), "a b c d") == ["c d"]
    assert one(spark, lambda c: tx.remove_stop(tx.tokenize(c)), "The cat and Dog") == ["cat", "Dog"]
    assert one(spark, lambda c: tx.decontract(F.split(c, " ")), "we re done s") == ["we", "are", "done", "is"]
    assert one(spark, lambda c: tx.expand_contractions(F.split(c, " ")), "I can't go") == ["I", "cannot", "go"]
    assert one(spark, lambda c: tx.lemmatize(F.split(c, " ")), "prices ladies boxes women bus class") == ["price", "lady", "box", "woman", "bus", "class"]


def test_pipelines(spark):
    text = "The “Café” (closed) re-opens: it's naïve 2025"
    assert one(spark, lambda c: tx.prepare(c, tx.DEFAULT_PIPELINE), text)[:2] == ["the", "cafe"]
    got = one(spark, lambda c: tx.prepare(c, tx.TOPIC_PIPELINE), text)
    assert "cafe" in got and "the" not in got and "closed" not in got


def test_html_fragments(spark):
    assert one(spark, tx.strip_ie_conditionals, "a[if IE]b\nc[endif]d") == "ad"
    assert one(spark, tx.strip_raw_json, 'x{"a":\n1}y') == "xy"
    assert one(spark, lambda c: tx.format_title(c, 5), "ab\"c'defg") == "abcde..."
    assert one(spark, tx.slug, "a b") == "a_b.html"
    assert one(spark, tx.paragraphs, "One. \nTwo!\nThree") == ["One", "Two", "Three"]


def test_dates(spark):
    row = spark.sql(
        "select timestamp_ntz'2024-03-10 12:40:00' a, timestamp_ntz'2024-03-10 12:10:00' b, timestamp_ntz'2024-03-11 00:10:00' c, timestamp_ntz'2024-03-10 23:10:00' d"
    ).select(
        dates.half_hour(F.col("a")).alias("hh"),
        dates.week_label(F.to_date("a")).alias("sunday"),
        dates.week_label(F.to_date("c")).alias("monday"),
        dates.half_hours(F.col("b"), F.col("a")).alias("none"),
        F.size(dates.half_hours(F.col("d"), F.col("c"))).alias("two"),
        dates.whole_days(F.col("b"), F.col("c")).alias("days"),
        dates.period(F.lit(0)).alias("p0"),
        dates.period(F.lit(360)).alias("p360"),
    ).first()
    assert (row.hh, str(row.sunday), str(row.monday), row.none, row.two, row.days, row.p0, row.p360) == (750, "2024-03-10", "2024-03-17", None, 2, 1, None, "night")


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab cD.é\n", max_size=12), min_size=1, max_size=20))
def test_ngrams_follow_tokens(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", tx.tokenize("t").alias("w"), tx.ngrams(tx.tokenize("t"), 3).alias("g")).collect():
        assert r.g == [" ".join(r.w[i : i + 3]) for i in range(len(r.w) - 2)]


def test_plug_ins_and_stop_lists(spark):
    df = spark.createDataFrame([(["Mice", "run", "cities"], "e\u0301 Ǻ ñ")], "t array<string>, s string")
    r = df.select(
        tx.lemmatize(F.col("t"), {"Mice": "mouse"}).alias("table"),
        tx.lemmatize(F.col("t"), F.reverse).alias("function"),
        tx.lemmatize(F.col("t")).alias("rules"),
        tx.pos_filter(F.col("t"), lambda t: ["NN" if w[0].isupper() else "VB" for w in t]).alias("nouns"),
        tx.pos_filter(F.col("t")).alias("all"),
        tx.normal_form(F.col("s")).alias("nfc"),
        tx.remove_accents(F.col("s"), all_scripts=True).alias("plain"),
    ).first()
    assert r.table == ["mouse", "run", "cities"] and r.function == ["cities", "run", "Mice"] and r.rules == ["Mice", "run", "city"]
    assert r.nouns == ["Mice"] and r.all == ["Mice", "run", "cities"] and r.nfc == "é Ǻ ñ" and r.plain == "e A n"
    assert tx.stop_list(["The", "a"], ["Say"], ["A"]) == ["say", "the"]
    assert {"the", "say", "may,june", "x", "!"} <= set(tx.CLOUD_STOPWORDS) and "ago" in tx.TOPIC_PAGE_STOPWORDS


def plain_pipeline(text, name):
    """The named pipelines with Python's own functions."""
    steps = {
        "join": lambda s: re.sub(r"(\w{2,})-\s*\n\s*(\w{2,})", r"\1\2", s),
        "quotes": lambda s: s.translate(str.maketrans("“”„‟«»‘’‚‛‹›`´", '"' * 6 + "'" * 8)),
        "form": lambda s: unicodedata.normalize("NFC", s),
        "space": lambda s: re.sub(r"[^\S\n]+", " ", re.sub("[\u200b\ufeff]", "", s)).strip(" "),
        "accents": lambda s: s.translate(str.maketrans(tx._ACCENTED, tx._PLAIN)),
        "brackets": lambda s: re.sub(r"\([^()]*\)|\[[^\[\]]*\]|\{[^{}]*\}", "", s),
        "punctuation": lambda s: "".join(" " if unicodedata.category(c).startswith("P") else c for c in s),
        "lower": str.lower,
        "tokens": lambda s: regex.findall(r"[\w-]*\p{L}[\w-]*", s),
        "decontract": lambda t: [tx.TOKEN_EXPANSIONS.get(w, w) for w in t],
        "expand": lambda t: [tx.CONTRACTIONS.get(w, w) for w in t],
        "stop": lambda t: [w for w in t if w.lower() not in tx.STOPWORDS],
        "cloud_stop": lambda t: [w for w in t if w.lower() not in tx.CLOUD_STOPWORDS],
        "page_stop": lambda t: [w for w in t if w.lower() not in tx.TOPIC_PAGE_STOPWORDS],
        "lemma": lambda t: [plain_lemma(w) for w in t],
    }
    order = {
        "default": "join quotes form space accents brackets punctuation lower tokens decontract",
        "topic": "lower join quotes accents brackets punctuation tokens expand lemma stop",
        "cluster": "lower join quotes space accents brackets punctuation tokens expand stop lemma",
        "cloud": "join quotes space accents brackets punctuation tokens expand cloud_stop lemma",
        "topic_page": "join quotes space accents brackets punctuation tokens expand page_stop lemma",
    }
    for step in order[name].split():
        text = steps[step](text)
    return text


def plain_lemma(w):
    if re.search("(ss|us|is)$", w) or len(w) < 4:
        return w
    if w.endswith("ies"):
        return w[:-3] + "y"
    if re.search("(ches|shes|xes|zes|sses)$", w):
        return w[:-2]
    if w.endswith("men"):
        return w[:-3] + "man"
    return w.removesuffix("s")


def test_pipelines_of_all_messages_match_a_plain_version(spark, sf):
    texts = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    got = QUERIES["pipelines"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        for name in tx.PIPELINES:
            assert r[name] == plain_pipeline(texts[r.conv_id, r.turn], name), (r.conv_id, r.turn, name)


def test_text_of_all_pages_matches_a_plain_walk(spark, sf):
    """String nodes between tags, by a scan for tags; scripts and styles run to their own end tag."""

    def walk(page):
        page = re.sub(r"<!DOCTYPE[^>]*>", "", page)
        out, at = [], 0
        for m in re.finditer(r"<!--(.*?)-->|<(script|style)[^>]*>(.*?)</\2>|</?[a-zA-Z][^>]*>", page, re.S):
            if m.start() > at:
                out.append(html_lib.unescape(page[at : m.start()]))
            out += [x for x in (m.group(1), m.group(3)) if x]
            at = m.end()
        out += [html_lib.unescape(page[at:])] if at < len(page) else []
        return " ".join(re.sub(r"\{.*?\}", "", x, flags=re.S).replace("\\n", "").strip() for x in out)

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["html_text"](spark, sf).collect():
        assert r.text == walk(pages[r.page_id]), r.page_id


def test_contractions_written_out(spark):
    row = spark.range(1).select(tx.expand_contractions(F.split(F.lit("we can't say it's done"), " ")).alias("a"), tx.decontract(F.split(F.lit("they re late t ll"), " ")).alias("b")).first()
    assert row.a == [tx.CONTRACTIONS.get(w, w) for w in "we can't say it's done".split()] and row.a != "we can't say it's done".split()
    assert row.b == [tx.TOKEN_EXPANSIONS.get(w, w) for w in "they re late t ll".split()] and row.b != "they re late t ll".split()
