"""Hand-made cases of the DataFrame operators."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from broadsheet.functions import numbers
from broadsheet.operators import baseline, frames, lexicon, similarity, snapshot, topics
from broadsheet.operators.components import components
from broadsheet.plans.text import topic_assign_many
from broadsheet.scratch import Scratch


def test_rolling_mean_waits_for_seven_rows(spark):
    df = spark.createDataFrame([(d, float(d)) for d in (1, 2, 3, 4, 5, 6, 9)], "day int, x double")
    got = {r.day: r.x_ma for r in frames.rolling_mean(df, ["x"], ["day"]).collect()}
    assert got == {1: None, 2: None, 3: None, 4: None, 5: None, 6: None, 9: 30 / 7}


def test_spine_fills_gaps(spark):
    df = spark.sql("select * from values (date'2024-01-01', 'a', 2L), (date'2024-01-03', 'b', 1L) t(day, topic, n)")
    got = frames.fill_spine(df, frames.spine(df, "day"), "day", df, "topic", "n").collect()
    assert len(got) == 6 and sum(r.n for r in got) == 3


def test_dedupe(spark):
    rows = [(1, "x", 5, 6), (2, "x", 3, 9), (3, "x", 3, 4), (4, "y", 1, 1)]
    got = {r.processed: (r.id, r.a, r.z) for r in frames.dedupe(spark.createDataFrame(rows, "id int, processed string, a int, z int"), "processed", "a", "z", "id").collect()}
    assert got == {"x": (2, 3, 9), "y": (4, 1, 1)}


def test_emphasis_of_equal_rows_is_null(spark):
    df = spark.createDataFrame([(0, 1), (0, 1)], "position int, duration int")
    assert [r.emphasis for r in frames.emphasis(df, "position", "duration").collect()] == [None, None]


def test_means_skip_nulls_and_nan(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0), (1.0, 3.0), (None, None)], "a double, b double")
    assert [r.m for r in df.select(numbers.mean_of(F.col("a"), F.col("b")).alias("m")).collect()] == [1.0, 2.0, 2.0, None]
    assert spark.createDataFrame([(1.0,), (math.nan,)], "x double").agg(F.avg(numbers.no_nan(F.col("x")))).first()[0] == 1.0


def test_components_do_not_depend_on_order(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100)] + [(200, k) for k in range(201, 260)]
    random.Random(4).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.label for r in components(df, Scratch(spark, "test"), "t").collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in (100, 101, 102)}, **{i: 200 for i in range(200, 260)}}
    assert components(df.limit(0), Scratch(spark, "test"), "t").count() == 0


def test_cosine_at_the_threshold_and_clusters(spark):
    texts = ["storm hits coast"] * 3 + ["storm hits coast now", "quiet day", "other thing here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    pairs = similarity.similar_pairs(docs, "id", "title")
    found = {(r.a, r.b) for r in pairs.collect()}
    assert found == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}
    labels = {r.id: r.cluster for r in similarity.clusters(docs, pairs, "id", 4).collect()}
    assert labels == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: -1}
    assert similarity.nearest(pairs).where("id = 3").first().other == 0
    assert similarity.newsiness(pairs, docs).first().newsiness == 12 / 36 * 10000


def test_prefixes_lose_no_pair(spark):
    rng = random.Random(11)
    docs = [(i, " ".join(rng.choice("aa bb cc dd ee ff gg hh".split()) for _ in range(rng.randint(1, 7)))) for i in range(60)]
    df = spark.createDataFrame(docs, "id long, t string")
    w = similarity.tfidf(df, "id", similarity.terms("t"))
    vectors: dict = {}
    for r in w.collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    want = {(a, b) for a in vectors for b in vectors if a < b and round(sum(v * vectors[b].get(t, 0) for t, v in vectors[a].items()), 9) >= 0.5}
    assert {(r.a, r.b) for r in similarity.cosine_pairs(w, "id").collect()} == want


def test_topics(spark):
    docs = spark.createDataFrame([(1, ["gas", "prices", "rise"]), (2, ["gas"]), (3, ["cat", "lady", "gas"]), (4, [])], "id int, tokens array<string>")
    side = spark.createDataFrame([(1, ["prices", "gas", "gas prices"], ["gas"]), (2, ["cat lady"], ["cat"])], "topic_id int, keywords array<string>, essential array<string>")
    got = {(r.id, r.topic_id): r.score for r in topics.scores(docs, side, 2, "id", "tokens").collect()}
    assert got[1, 1] == 3 / 4 and got[2, 1] == 1 / 2 and got[3, 2] == 1 / 4 and got[4, 1] == 0 and got[1, 2] == 0
    scored = spark.createDataFrame([(1, 1, 0.05), (2, 2, 0.3), (2, 1, 0.3)], "id int, topic_id int, score double")
    assert [(r.id, r.topic_id) for r in topics.assign(scored, "id").collect()] == [(2, 1)]
    articles = spark.createDataFrame([(1, None, None), (2, 9, 0.9)], "id int, topic_id int, topic_score double")
    assert {r.id: r.topic_id for r in topics.assign_missing(articles, scored, "id").collect()} == {1: None, 2: 9}


def test_lexicons(spark):
    lex = {"good": 2.0, "bad": -2.0}
    assert lexicon.polarity("", lex) == (0.0, 0.0, 0.0, 0.0) and lexicon.polarity(None, lex) == (0.0, 0.0, 0.0, 0.0)
    good, not_good, very = (lexicon.polarity(t, lex)[3] for t in ("good day", "not good day", "very good day"))
    assert not_good < 0 < good < very and good == round(2 / math.sqrt(19), 4)
    docs = spark.createDataFrame([(1, "good good bad x"), (2, ""), (3, None)], "id int, t string")
    from broadsheet.functions import text as tx

    side = spark.createDataFrame(list(lex.items()), "token string, valence double")
    assert {r.id: r.score for r in lexicon.per_word(docs, side, "id", "t", tx.tokenize("t"), 2).collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    assert docs.select(lexicon.vader(lex)("t").alias("v")).first().v.compound == lexicon.polarity("good good bad x", lex)[3]


def test_snapshot(spark):
    store = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], "k string, first_accessed int, last_accessed int")
    batch = spark.createDataFrame([("b", 5, 5), ("c", 5, 5), ("c", 6, 6)], "k string, first_accessed int, last_accessed int")
    got = {r.k: (r.first_accessed, r.last_accessed) for r in snapshot.upsert(store, batch, "k").collect()}
    assert got == {"a": (1, 2), "b": (1, 5), "c": (5, 6)}
    assert {r.k: r.last_accessed for r in snapshot.touch(store, batch, "k", F.lit(9)).collect()} == {"a": 2, "b": 9}
    assert [r.k for r in snapshot.delete(store, batch, "k").collect()] == ["a"]
    assert {r.k for r in snapshot.unseen(batch, store, "k").collect()} == {"c"}


def test_baseline(spark):
    values = spark.sql("select * from values (timestamp_ntz'2024-01-01 10:00:00', 1), (timestamp_ntz'2024-01-08 10:00:00', 3), (timestamp_ntz'2024-01-02 10:00:00', 5) t(slot, n)")
    base = baseline.build(values, "slot", "n")
    monday = base.where("day = 'Monday'").first()
    assert (monday.mean, monday.median, round(monday["std"], 6)) == (2.0, 2.0, round(math.sqrt(2), 6))
    kinds = {str(r.slot)[:10]: r.kind for r in baseline.classify(values, base, "slot", "n").collect()}
    assert kinds == {"2024-01-01": "slow", "2024-01-08": "average", "2024-01-02": "unknown"}


def test_equal_texts_are_one_class(spark):
    """A text that very many rows share makes one class: clusters and newsiness count copies without their pairs."""
    texts = ["storm hits coast"] * 300 + ["storm hits coast coast"] * 2 + ["quiet day", "", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, title string")
    s = similarity.Similar(docs, "id", "title")
    assert s.pairs.count() == 1 and s.listed().count() == 302 * 301 // 2
    assert s.newsiness().first().newsiness == 302 * 301 / len(texts) ** 2 * 10000
    got = {r.id: r.cluster for r in s.clusters(6).collect()}
    assert got == {i: 0 if i < 302 else -1 for i in range(len(texts))}


def test_groups_have_weights_and_clusters_of_their_own(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["x", "y"]), " ".join(rng.choice("aa bb cc dd ee".split()) for _ in range(rng.randint(1, 4)))) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, day string, title string")
    s = similarity.Similar(df, "id", "title", by=["day"])
    labels = {(r.day, r.id): r.cluster for r in s.clusters(3).collect()}
    busy = {r.day: round(r.newsiness, 6) for r in s.newsiness().collect()}
    for day in ("x", "y"):
        own = similarity.Similar(df.where(F.col("day") == day), "id", "title")
        assert {r.id: r.cluster for r in own.clusters(3).collect()} == {i: c for (d, i), c in labels.items() if d == day}
        assert round(own.newsiness().first().newsiness, 6) == busy[day]
        pairs = similarity.cosine_pairs(similarity.tfidf(df.where(F.col("day") == day), "id", similarity.terms("title")), "id")
        assert {(r.a, r.b) for r in pairs.collect()} == {(r.a, r.b) for r in own.listed().collect()}


def test_probe_and_precision(spark):
    docs = spark.createDataFrame([(1, "storm hits coast"), (2, "storm calm"), (3, "other thing"), (4, None)], "id long, title string")
    near = similarity.to_probe(docs, "id", "title", "storm hits coast")
    got = {r.id: round(r.similarity, 6) for r in near.collect()}
    assert got[1] == 1.0 and 0 < got[2] < 1 and got[3] == got[4] == 0.0
    assert similarity.to_probe(docs, "id", "title", "unknown words").where("similarity <> 0").count() == 0
    r = similarity.precision(near.join(docs, "id"), "title", "hits", 0.1).first()
    assert (r.holds, r.lacks, r.ratio) == (1, 1, 0.5)


def test_samples_do_not_depend_on_partitions(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    one, two = frames.sample(df, "k", 20), frames.sample(df.repartition(7), "k", 20)
    assert one.collect() == two.collect() and len(one.collect()) == 20
    parts = {r.part: r["count"] for r in frames.split(df, "k").groupBy("part").count().collect()}
    assert sum(parts.values()) == 1000 and 750 < parts["train"] < 850


def test_guards(spark):
    full, none = spark.range(3), spark.range(0)
    assert list(frames.non_empty({"a": full, "b": none})) == ["a"] and frames.required(full, "rows") is full
    try:
        frames.required(none, "rows of today")
    except LookupError as e:
        assert "rows of today" in str(e)
    else:
        raise AssertionError


def test_batch_topics(spark):
    side = spark.createDataFrame([(1, ["gas"], ["gas"]), (2, ["cat"], ["Cat"])], "topic_id int, keywords array<string>, essential array<string>")
    rows = spark.createDataFrame([(1, "Gas is up", None), (2, "no match", None), (3, "GAS again", 1), (4, "a cat", None)], "id int, title string, topic_id int")
    assert sorted(r.id for r in topics.candidates(rows, side).collect()) == [1, 4]
    scored = spark.createDataFrame([(7, 1, 1, 0.9), (7, 2, 2, 0.2), (7, 3, 1, 0.05), (8, 4, 2, 0.01)], "article int, id int, topic_id int, score double")
    assert [(r.article, r.topic_id, r.topic_score) for r in topics.assign_last(scored, "article", "id").collect()] == [(7, 2, 0.2)]


def test_age_marks(spark):
    df = spark.createDataFrame([(0, 3, 0), (1, 4, 89 * 60 + 59), (2, 5, 90 * 60), (3, 6, 7300), (4, 7, None)], "cluster int, members long, first long")
    got = [(r.breaking, r.mark) for r in similarity.age_marks(df).orderBy("cluster").collect()]
    assert got == [(True, "3 headlines, BREAKING! 0m ago!"), (True, "4 headlines, BREAKING! 89m ago!"), (False, "5 headlines, First broken 1 hours ago"), (False, "6 headlines, First broken 2 hours ago"), (False, None)]
    assert similarity.age_marks(df.limit(0)).count() == 0


def test_agency_lists(spark):
    rows = [(0, 0, "B", 1), (1, 0, "A", 1), (2, 0, "C", -2), (3, 0, "C", -2), (4, 1, "A", 0), (5, -1, "Z", 0)]
    df = spark.createDataFrame(rows, "id long, cluster int, agency string, bias int")
    assert [(r.cluster, r.agencies) for r in similarity.agency_lists(df, 3).collect()] == [(0, "C | A B")]


def test_many_topics_equal_the_expressions(spark, monkeypatch):
    """5,000 topics by joins, also shuffled ones; on the first 50 of them the scores of the expression path."""
    import random

    from broadsheet.operators import topics
    from broadsheet import scratch

    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    listed = [(i, rng.sample(words, rng.randint(0, 4)) + [" ".join(rng.sample(words, 2))] * rng.randint(0, 2), rng.sample(words, rng.randint(0, 3))) for i in range(5000)]
    side = spark.createDataFrame(listed + [(6000, None, None), (6001, [None, "w1"], ["w1", None])], "topic_id int, keywords array<string>, essential array<string>")
    docs = spark.createDataFrame([(i, [rng.choice(words) for _ in range(rng.randint(0, 30))]) for i in range(40)] + [(90, None)], "id long, t array<string>")
    few = side.where("topic_id < 50")
    want = {(r.id, r.topic_id): round(r.score, 9) for r in topics.scores(docs, few, 50, "id", "t").collect() if r.score > 0}
    for most in (scratch.BROADCAST_BYTES, 0):
        monkeypatch.setattr(topics, "maybe_broadcast", lambda df, rows, most=most: scratch.maybe_broadcast(df, rows, most))
        got = {(r.id, r.topic_id): round(r.score, 9) for r in topics.positive_scores(docs, side, "id", "t").collect()}
        assert {k: v for k, v in got.items() if k[1] < 50} == want and len(want) > 5
        plain = {}
        for i, t in docs.collect():
            grams = [*(t or []), *(" ".join(x) for x in zip(t or [], (t or [])[1:]))]
            for k, keys, ess in listed:
                hits = sum(g in keys for g in grams)
                if hits and set(t or []) & set(ess):
                    plain[i, k] = round(hits / (len(t) + 1), 9)
        assert {k: v for k, v in got.items() if k[1] < 5000} == plain


def test_topics_of_first_words_equal_listed_pairs(spark, sf, monkeypatch):
    """Scores as with every pair listed, and no gram is joined or shuffled: hits are added up by word."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, [rng.choice(words) for _ in range(rng.randint(0, 12))]) for i in range(60)] + [(90, None), (91, ["w1"]), (92, ["w1", "w1"])]
    docs = spark.createDataFrame(texts, "id long, t array<string>")
    listed = [(k, [w, *sorted({f"{a} {b}" for _, t in texts for a, b in zip(t or [], (t or [])[1:]) if a == w})], [w]) for k, w in enumerate(words[:20])]
    side = spark.createDataFrame(listed, "topic_id int, keywords array<string>, essential array<string>")
    want = {(r.id, r.topic_id): round(r.score, 9) for r in topics.positive_scores(docs, side, "id", "t").collect()}
    essential = spark.createDataFrame([(k, w) for k, _, (w,) in listed] + [(50, None)], "topic_id int, word string")
    scored = topics.scores_of_first_words(docs, essential, "id", "t")
    assert {(r.id, r.topic_id): round(r.score, 9) for r in scored.collect()} == want and len(want) > 100

    used = []
    monkeypatch.setattr(topics, "scores_of_words", lambda *a: used.append(a))
    monkeypatch.setattr(topics.tx, "ngrams", lambda *a, **b: used.append(a))
    assert topic_assign_many(spark, sf).count() and not used
