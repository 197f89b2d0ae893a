"""Pages, side inputs, the HTTP source against a local server, and the stream."""

from __future__ import annotations

import html as html_text
import http.server
import json
import re
import threading

import pyarrow as pa
from pyspark.sql import functions as F

from broadsheet.plans import text  # noqa: F401  registers the queries
from broadsheet.plans.registry import QUERIES
from broadsheet.sources import html, side_inputs
from broadsheet.sources.dom import Page
from broadsheet.sources.front_pages import FrontPages

PAGE = '<main><div class="page"><a href="/story/1"><h2> First  one </h2></a><a href="/video/2"><h2>Clip</h2></a><a href="/story/3"></a></div></main><a href="/story/4"><h2>Outside</h2></a>'


def test_rules_choose_links(spark):
    rule = html.Rule("A", "first div ;; class=page > all a ;; href=/story/|/video/", title="h1,h2", need="h1,h2", exclude=("/video/",))
    df = spark.createDataFrame([("A", PAGE), ("B", PAGE), ("A", None)], "agency string, html string")
    assert [(r.agency, r.position, r.href, r.title) for r in html.extract_links(df, [rule]).collect()] == [("A", 0, "/story/1", "First  one")]


def test_elements_end_where_html_says_so():
    page = Page('<ul><li>a<li>b<a href=1>x<a href=2>y</a></ul><p>one<div>two</div><table><tr><td>c<td>d</table><a id=q><div>in</a> still</div></a>out<br>x<!-- c --><script>s</script>')
    text = lambda tag: [page.seen(n) for n in page.inside(0, [tag], ())]
    assert text("li") == ["a", "bxy"] and text("a") == ["x", "y", "in still"] and text("p") == ["one"] and text("td") == ["c", "d"]
    assert page.all_strings(0)[-4:] == ["out", "x", " c ", "s"] and page.seen(0).endswith("outx")
    assert page.around(next(page.inside(0, ["td"], ())), ("table",), ()) is not None and Page("").seen(0) == ""


#: Pages for the rules that do more than to test an href: what is wanted beside what is not, and what comes out.
PAGES = {
    "ABC News": ('<a href="/story?id=1"><i>Kick</i><h2>A title</h2></a><a href="/story?id=2"><h2> </h2>text</a><a href="/story?id=3">Plain</a><a href="/v?id=4">V</a>', [("/story?id=1", "Kick A title"), ("/story?id=3", "Plain")]),
    "Al Arabiya": ('<a title="" href="/x">One two</a><a title="t" href="/y"> </a><a href="/z">No</a>', [("https://english.alarabiya.net/x", "One two")]),
    "Alternet": ('<a aria-label="l" href="/x">One</a><a aria-label="l">No</a><a href="/y">No</a>', [("/x", "One")]),
    "AP": ('<a href="/article/y">Out</a><main class="a Page-oneColumn"><a href="/article/x">In it</a><a href="/hub/x">Hub</a><a href="/article/z"></a></main><main class="Page-oneColumn"><a href="/article/w">Second</a></main>', [("/article/x", "In it")]),
    "Axios": ('<a href="/2024/01/02/a">Go deeper (1 min)</a><a href="/2024/01/02/b">Real one</a>', [("/2024/01/02/b", "Real one")]),
    "BBC": ('<a data-testid="internal-link" href="/n/1"><span>Kick</span><h2 data-testid="card-headline">Title</h2></a><a data-testid="internal-link" href="/n/2"><h2>Section</h2></a><a data-testid="internal-link" href="https://cloud.email.bbc/x"><h2 data-testid="card-headline">No</h2></a><a data-testid="internal-link" href="/n/3"><h2 data-testid="card-headline"> </h2></a>', [("/n/1", "Title")]),
    "The Blaze": ('<a class="big headline-x" href="/a">T</a><a class="head" href="/b">No</a>', [("/a", "T")]),
    "Business Insider": ('<a data-analytics-product-module="hp_tout_clicks" href="/a">T</a><a data-analytics-product-module="hp_tout_clicks2" href="/b">No</a>', [("/a", "T")]),
    "Caixin Global": ('<a href="//h/2024-01-02/x.html\n?a=b">T</a>', [("//h/2024-01-02/x.html", "T")]),
    "CBC": ('<a href="/news/a"><h3 class="headline">T</h3>more</a><a href="/news/b"><h3>No</h3></a><a href="/x/news/c"><h3 class="headline">No</h3></a>', [("https://www.cbc.ca/news/a", "T more")]),
    "CBS News": ('<article><p><a href="/a"><h4>T</h4>sub</a><a href="/b">Second</a></p></article><article>none</article><article><a href="/c"> </a></article><a href="/d">Out</a>', [("/a", "T sub")]),
    "CNN": ('<a data-link-type="article" href="/a">T</a><a data-link-type="article" href="/cnn-underscored/b">No</a><a data-link-type="article" href="/wbd/c">No</a><a data-link-type="video" href="/d">No</a>', [("https://www.cnn.com/a", "T")]),
    "Current Affairs": ('<a href="/2024/03/x">T</a><a href="https://o.org/2024/03/x">No</a>', [("https://www.currentaffairs.org/2024/03/x", "T")]),
    "The Daily Beast": ('<a class="TrackingLink a" href="/a">T</a><a class="b" href="/b">No</a>', [("/a", "T")]),
    "The Daily Kos": ('<a href="/stories/2024/1/2/3/-a">kick<h3>T</h3></a><a href="/stories/2024/1/2/4/-b">No</a>', [("/stories/2024/1/2/3/-a", "T")]),
    "Daily Mail": ('<a href="/news/article-12/x.html#v">T</a><a href="https://o/article-13/y">No</a>', [("/news/article-12/x.html", "T")]),
    "The Daily Wire": ('<article><a href="/news/a"><span>k</span><h3>T</h3></a></article><article><a href="/news/b">no heading</a></article>', [("/news/a", "T")]),
    "Der Spiegel": ('<section aria-label="International"><a title="t" href="/a">T</a><a href="/b">No</a></section><section aria-label="International"><a title="t" href="/c">Second</a></section>', [("/a", "T")]),
    "The Epoch Times": ('<a data-title="true" href="/a">k<h3>T</h3></a><a data-title="true" href="/b">Whole</a><a data-title="false" href="/c">No</a>', [("/a", "T"), ("/b", "Whole")]),
    "Foreign Affairs": ('<div class="content"><a href="/a/b">T</a><a href="http://x/a/b">No</a></div><a href="/c/d">Out</a>', [("/a/b", "T")]),
    "Fox News": ('<div class="page home"><a href="//www.foxnews.com/politics/some-story">A</a><a href="//www.foxnews.com/category/some">C</a><a href="//www.foxnews.com/lifestyle/some">L</a></div><div class="page"><a href="//www.foxnews.com/politics/other">Second</a></div>', [("//www.foxnews.com/politics/some-story", "A")]),
    "Fox Business": ('<div class="page"><a href="//www.foxbusiness.com/a/b-c">A</a></div><div class="page"><a href="//www.foxbusiness.com/a/d">No</a></div>', [("//www.foxbusiness.com/a/b-c", "A")]),
    "The Guardian": ('<a href="/us/2024/mar/02/x" aria-label="Real headline here"></a><a href="/us/2024/mar/02/y" aria-label="Other one">Kicker</a><a href="/us/2024/mar/02/z">No</a>', [("/us/2024/mar/02/x", "Real headline here"), ("/us/2024/mar/02/y", "Other one")]),
    "Hindustan Times": ('<a data-articleid="1" href="/a">T</a><a href="/b">No</a>', [("/a", "T")]),
    "Independent Journal Review": ('<div class="jeg_content"><a href="/a">T</a><a>No</a></div><a href="/b">Out</a>', [("/a", "T")]),
    "The Intercept": ('<a href="/2024/1/2/a">k<h3>T</h3></a><a href="/2024/1/2/b">Whole</a>', [("/2024/1/2/a", "T"), ("/2024/1/2/b", "Whole")]),
    "Jacobin": ('<a href="/2024/03/x">T</a><a href="https://o.com/2024/03/x">No</a>', None),
    "The Japan Times": ('<a href="/2024/03/02/a">T</a><a href="https://www.japantimes.co.jp/archive/2024/03/02/">No</a>', [("/2024/03/02/a", "T")]),
    "The Kyiv Independent": ('<a rel="nofollow dofollow" href="/a">T</a><a rel="nofollow" href="/b">No</a><a rel="dofollow" href="http://x">No</a>', [("/a", "T")]),
    "Le Monde": ('<a href="/en/article/a"><span>k</span><h3 class="article__title--x">T</h3></a><a href="/en/article/b"><h3>No</h3></a>', [("/en/article/a", "T")]),
    "Military.com": ('<a href="/2024/1/2/a"><span>k</span><span property="schema:name">T</span></a><a href="/2024/1/2/b"><span>No</span></a>', [("https://www.military.com/2024/1/2/a", "T")]),
    "Mother Jones": ('<a href="https://h/2024/03/x">T</a><a href="/2024/03/x">No</a>', [("https://h/2024/03/x", "T")]),
    "MSNBC": ('<a href="/a-1">T w</a><a href="/b-2">A / B</a>', [("/a-1", "T w")]),
    "National Post": ('<a href="/news/x"><em>Before</em><div><span class="card__headline-clamp wide">A headline</span></div><b>after</b></a><a href="/y"><span class="card__headline-clamp">Your Horoscope</span></a><a href="/z"><span>No</span></a><span class="card__headline-clamp">No link</span>', [("/news/x", "Before A headline after")]),
    "National Review": ('<a data-testid="dynamic-link" href="/a">T</a><a data-testid="link" href="/b">No</a>', [("/a", "T")]),
    "NBC News": ('<a href="https://www.nbcnews.com/a/b/c">T</a><a href="https://www.nbcnews.com/select/b/c">No</a>', [("https://www.nbcnews.com/a/b/c", "T")]),
    "NDTV": ('<a class="x item-title" href="/a">T</a><a class="item-titles" href="/b">No</a>', [("/a", "T")]),
    "The New Republic": ('<a href="/post/1/a"><div>k</div><div class="Hed">T</div></a><a href="/post/2/b"><div>No</div></a>', [("https://newrepublic.com/post/1/a", "T")]),
    "News Nation": ('<a data-link-label="x" href="/a">T</a><a href="/b">No</a>', [("/a", "T")]),
    "New Yorker": ('<a href="/news/a">T</a><a href="/x">No</a>', [("https://www.newyorker.com/news/a", "T")]),
    "Nikkei Asia": ('<a data-trackable="x-headline" href="/a">T</a><a data-trackable="x" href="/b">No</a>', [("/a", "T")]),
    "NPR": ('<a class="topic-title first" href="/1">T</a><a class="topic-titles" href="/2">No</a>', None),
    "New York Times": ('<a aria-hidden="false" href="https://www.nytimes.com/2024/03/02/us/a"><p>k</p><p class="indicate-hover">T</p></a><a aria-hidden="false" href="https://www.nytimes.com/2024/03/02/podcasts/b"><p class="indicate-hover">No</p></a><a aria-hidden="true" href="https://www.nytimes.com/2024/03/02/us/c"><p class="indicate-hover">No</p></a>', [("https://www.nytimes.com/2024/03/02/us/a", "T")]),
    "One America News Network": ('<a href="https://www.oann.com/a/b">T</a><a href="https://www.oann.com/category/b">No</a>', [("https://www.oann.com/a/b", "T")]),
    "Political Wire": ('<a href="/2024/1/2/a">T</a><a href="/2024/1/2/b">Quote of the Day</a>', [("/2024/1/2/a", "T")]),
    "The Post Millennial": ('<header><a href="/h">No</a></header><a href="/a">T</a><footer><a href="/f">No</a></footer><footer><a href="/g">Second</a></footer>', [("/a", "T"), ("/g", "Second")]),
    "Real Clear Politics": ('<a onclick="return ClickTracking.record_click(1)" href="/a">T</a><a onclick="x" href="/b">No</a>', [("/a", "T")]),
    "Salon": ('<a href="2024/03/02/a">T</a><a href="/2024/03/02/b">U</a><a href="https://x/2024/03/02/c">No</a>', [("2024/03/02/a", "T"), ("/2024/03/02/b", "U")]),
    "Scripps News": ('<a class="promo__link" href="/a">T</a><a class="promo__link-x" href="/b">No</a>', [("/a", "T")]),
    "Semafor": ('<div class="styles_grid__1"><a href="/article/a">k<h2>T</h2></a><a href="/article/b">No</a></div><a href="/article/c"><h2>Out</h2></a>', [("https://www.semafor.com/article/a", "T")]),
    "Sydney Morning Herald": ('<a data-testid="article-link" href="/a">T</a><a href="/b">No</a>', [("/a", "T")]),
    "Taipei Times": ('<a href="/x/2024/1/2/a">k<h3>T</h3></a><a href="/x/2024/1/2/b">Whole</a><a href="/x/2024/1/2/c"></a>', [("/x/2024/1/2/a", "T"), ("/x/2024/1/2/b", "Whole")]),
    "Time": ('<a href="/123/a">T</a><a href="/124/b">Go to item 2</a>', [("/123/a", "T")]),
    "Toronto Sun": ('<a href="/news/a">k<h3>T</h3></a><a href="/opinion/b">Whole</a><a href="/sports/c">No</a>', [("/news/a", "T"), ("/opinion/b", "Whole")]),
    "Vanity Fair": ('<a data-component-type="recirc-river" href="/a">T</a><a href="/b">No</a>', [("/a", "T")]),
    "The Wall Street Journal": ('<article><h3><a href="/a">T</a></h3><a href="/b">Second</a></article><a href="/c">Out</a>', [("/a", "T")]),
    "The Washington Free Beacon": ('<main><a href="/a">T</a></main><main><a href="/b">Second</a></main>', [("/a", "T")]),
    "The Week": ('<div id="main"><a class="listing__link" href="/x">L</a><a href="/a-2024-03-02-1">T</a></div><a class="listing__link" href="/y">Out</a>', [("/a-2024-03-02-1", "T"), ("/x", "L")]),
}


def test_rule_table(spark):
    rules = html.load_rules()
    assert len(rules) == 124 and len(html.load_rules(registered_only=False)) == 131 == html.agencies(spark).count()
    assert sum(r.is_plain() for r in html.load_rules(registered_only=False)) > 60


def test_rules_on_pages_written_for_them(spark):
    """Every rule that does more than to test an href: what it wants, next to what it does not."""
    rules = {r.agency: r for r in html.load_rules(registered_only=False)}
    assert set(PAGES) <= set(rules)
    rows = [(a, p) for a, (p, _) in PAGES.items()]
    got: dict = {}
    for r in html.extract_links(spark.createDataFrame(rows, "agency string, html string"), list(rules.values())).orderBy("agency", "position").collect():
        got.setdefault(r.agency, []).append((r.href, r.title))
    for a, (_, want) in PAGES.items():
        # Where the address stands before the path it is taken from the table.
        assert got[a] == (want or [(rules[a].base + ("/2024/03/x" if a == "Jacobin" else "1"), "T")]), a


def test_links_of_all_rules_equal_a_plain_walk(spark, sf):
    """Rules of one ``all`` step, over the anchors of every page as a regular expression sees them."""
    from broadsheet.plans import text as plans

    rules = [r for r in html.load_rules(registered_only=False) if r.steps.startswith("all a") and " > " not in r.steps and " || " not in r.steps]
    assert len(rules) > 110
    want = set()
    for page in plans._dealt_pages(spark, sf).collect():
        anchors = [(dict(re.findall(r'([a-z-]+)="([^"]*)"', m[1])), m[2]) for m in re.finditer(r"<a ([^>]*)>(.*?)</a>", page.html)]
        for rule in rules:
            place = 0
            for attrs, inner in anchors:
                tests = [t.partition("=")[::2] for t in rule.steps.split(" ;; ")[1:]]
                fits = all(n in attrs and (not p or any(re.search(p, v) for v in ([attrs[n], *attrs[n].split()] if n in ("class", "rel") else [attrs[n]]))) for n, p in tests)
                if not fits or "href" not in attrs or any(re.search(p, attrs["href"]) for p in rule.exclude):
                    continue
                heading = re.match(r"<h2>(.*)</h2>$", inner)
                text = html_text.unescape(heading[1] if heading else inner).strip()
                choice = lambda c, h=heading: c.partition(" | ")[2] == "link" or (h is not None and "h2" in c.split(" ;; ")[0].split(",") and " ;; " not in c)
                if (rule.need and not ((rule.need == "link" or choice(rule.need)) and text)) or any(re.search(p, text) for p in rule.exclude_titles):
                    continue
                if rule.title and rule.title[0] != "@" and not choice(rule.title):
                    continue
                title = attrs[rule.title[1:]] if rule.title.startswith("@") else text
                want.add((page.page_id, rule.agency, place, rule.base + (re.sub(rule.cut, "", attrs["href"]) if rule.cut else attrs["href"]), html_text.unescape(title)))
                place += 1
    names = {r.agency for r in rules}
    got = {tuple(r) for r in QUERIES["front_page_rules"](spark, sf).collect() if r.agency in names}
    assert got == want and len({a for _, a, *_ in want}) >= 60


def test_agencies_and_their_headers(spark):
    from broadsheet.sources.front_pages import AGENT

    agents = {r.agency: r.user_agent for r in html.agencies(spark).collect()}
    assert agents["BBC"] == AGENT and agents["National Post"] == "Broadsheet Bot" and "Googlebot" in agents["Al Arabiya"]


def test_text_of_fragments(spark):
    cases = {"<a><b>One</b> <i>two</i></a>": "One  two", "<p>x{\"a\":1}y</p>": "xy", "plain": "plain", "": "", None: None}
    df = spark.createDataFrame([(k,) for k in cases], "h string")
    assert {r.h: r.t for r in df.select("h", html.extract_text("h").alias("t")).collect()} == cases


def test_text_of_all_pages(spark, sf):
    got = QUERIES["html_text"](spark, sf).collect()
    assert len(got) == 50 and all("<article" not in r.text for r in got)


def test_pipelines_and_polarity_cover_all_messages(spark, sf):
    n = spark.read.parquet(f"{sf}/conversations.parquet").count()
    assert QUERIES["pipelines"](spark, sf).count() == n and QUERIES["vader_scores"](spark, sf).where("abs(compound) <= 1").count() == n


def test_side_inputs(spark, tmp_path):
    t = side_inputs.topics(spark, "- name: A\n  color: '#fff'\n  keywords: ['81', x y]\n  essential: [z]\n- name: B\n")
    assert [(r.topic_id, r["name"], r.keywords, r.essential) for r in t.collect()] == [(1, "A", ["81", "x y"], ["z"]), (2, "B", [], [])]
    d = side_inputs.special_dates(spark, "- name: Later\n  topic: A\n  date: 2024-02-02\n- name: Always\n  topic: all\n  date: 2024-01-01\n- name: Other\n  topic: B\n  date: 2024-01-01\n")
    assert [(r.i, r["name"]) for r in side_inputs.dates_of(d, "A").collect()] == [(2, "Always"), (1, "Later")]
    side_inputs.write_csv(spark.createDataFrame([(0, "Monday", 1.0, 1.0, 0.5)], side_inputs.NEWSINESS), str(tmp_path / "n"))
    assert side_inputs.newsiness(spark, str(tmp_path / "n")).first().std == 0.5


def test_front_pages_over_http(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200 if self.path == "/ok" else 404)
            self.end_headers()
            self.wfile.write(f"<p>{self.headers['User-Agent']}</p>".encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    spark.dataSource.register(FrontPages)
    agencies = [{"agency": "A", "url": base + "/ok", "headers": {"User-Agent": "hi"}}, {"agency": "B", "url": base + "/gone"}]
    got = {r.agency: (r.status, r.html) for r in spark.read.format("front_pages").option("agencies", json.dumps(agencies)).load().collect()}
    server.shutdown()
    assert got == {"A": (200, "<p>hi</p>"), "B": (404, None)}


def test_topics_of_a_file_and_their_dates(spark):
    """Missing lists are empty, rows are numbered in file order, dates of a topic that is none go."""
    topics = side_inputs.topics(spark, "- name: Weather\n  color: '#446'\n  keywords: [storm, rain, the river]\n  essential: [storm, rain]\n- name: Sport\n")
    assert [tuple(r) for r in topics.orderBy("topic_id").collect()] == [(1, "Weather", "#446", ["storm", "rain", "the river"], ["storm", "rain"]), (2, "Sport", None, [], [])]
    dates = side_inputs.special_dates(spark, "- {name: Flood, topic: Weather, date: 2024-03-02}\n- {name: New year, topic: all, date: 2024-01-01}\n- {name: Nowhere, topic: Space, date: 2024-04-01}\n")
    got = sorted((r.topic_id, r.i, r.name, r.place) for r in side_inputs.dated(topics, dates).collect())
    assert got == [(1, 1, "Flood", 2), (1, 2, "New year", 1), (2, 2, "New year", 1)]
    assert side_inputs.dated(topics, dates.limit(0)).count() == side_inputs.dated(topics.limit(0), dates).count() == 0


def test_pages_reach_python_in_small_batches(spark, sf, monkeypatch):
    """The memory of a worker does not grow with the table: neither the pages of a batch nor its links are held at once."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for name in ("html_text", "front_page_rules"):
        spark.conf.unset(key)
        QUERIES[name](spark, sf)
        assert int(spark.conf.get(key)) <= 4 << 20

    @F.arrow_udf("long")
    def rows_at_once(pages: pa.Array) -> pa.Array:
        return pa.array([len(pages)] * len(pages), pa.int64())

    long = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("<p>x</p>"), 1250).alias("h"))
    assert long.select(rows_at_once("h").alias("n")).agg(F.max("n")).first()[0] <= 600

    page = "".join(f'<a href="/story/{k}">t {k}</a>' for k in range(50))
    df = spark.createDataFrame([(i, "A", page) for i in range(3)] + [(3, "A", None), (4, "B", page)], "id long, agency string, html string").coalesce(1)
    monkeypatch.setattr(html, "BATCH_LINKS", 7)
    got = [tuple(r) for r in html.extract_links(df, [html.Rule("A")], id_col="id").collect()]
    assert got == [(i, "A", k, f"/story/{k}", f"t {k}") for i in range(3) for k in range(50)]
