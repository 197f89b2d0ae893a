"""Dictionary forms and the tagger: hand-made cases, a generated corpus, and batches against single sequences."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.operators import lemmas, tagger
from broadsheet.plans import roles, words
from broadsheet.plans.registry import QUERIES
from tests.test_text import plain_pipeline


def test_lemmas(spark):
    index = spark.createDataFrame([(x,) for x in "lady box woman bus class wolf dish go goose axis ax house glass bu".split()] + [("box",), (None,)], "lemma string")
    exceptions = spark.createDataFrame([("geese", "goose"), ("axes", "axis"), ("axes", "ax"), ("geese", "goose"), ("went", "unknown")], "form string, lemma string")
    want = {"ladies": "lady", "boxes": "box", "women": "woman", "bus": "bu", "buses": "bus", "classes": "class", "wolves": "wolf", "dishes": "dish", "geese": "goose", "axes": "ax", "houses": "house", "went": "went", "xyzs": "xyzs", "Boxes": "Boxes", "s": "s", "glassess": "glass", "": ""}
    tokens = spark.createDataFrame([(w,) for w in want] + [(None,), ("ladies",)], "token string")
    table = lemmas.lemma_table(tokens, index, exceptions)
    assert {r.token: r.lemma for r in table.collect()} == want
    docs = spark.createDataFrame([(1, ["ladies", None, "boxes", "ladies", "q"]), (2, []), (3, None)], "id long, tokens array<string>")
    assert {r.id: r.tokens for r in lemmas.lemmatized(docs, "id", "tokens", table).collect()} == {1: ["lady", None, "box", "lady", "q"], 2: [], 3: None}
    assert lemmas.lemma_table(tokens.limit(0), index).count() == 0


WORDS = {"DT": ["the", "a", "every"], "JJ": ["round", "green", "lastable", "workable", "pressive", "massive"], "NN": ["dog", "nation", "station", "motion", "tree", "hope"], "VB": ["eats", "realizes", "organizes", "sees"], "IN": ["of", "in", "by"]}
#: Forms that are nouns or verbs, by what is before them.
EITHER = ["run", "walk", "turn", "play", "back", "set"]


def sentence(rng: random.Random) -> tuple[list[str], list[str]]:
    """A generated sentence with its tags: noun phrases and verbs, some forms of either kind, new words with known endings."""
    out = []

    def add(tag):
        word = rng.choice(WORDS[tag])
        if tag in ("NN", "VB") and rng.random() < 0.4:
            word = rng.choice(EITHER)
        elif rng.random() < 0.2 and tag in ("JJ", "NN", "VB"):
            word = "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(3)) + {"JJ": "able", "NN": "tion", "VB": "izes"}[tag]
        out.append((word, tag))

    for part in ("subject", "verb", "object"):
        if part == "verb":
            add("VB")
            continue
        add("DT")
        if rng.random() < 0.5:
            add("JJ")
        add("NN")
        if rng.random() < 0.3:
            add("IN")
            add("DT")
            add("NN")
    return [w for w, _ in out], [t for _, t in out]


@pytest.fixture(scope="module")
def learned(spark):
    rng = random.Random(3)
    rows = [sentence(rng) for _ in range(600)]
    odd = [([], []), (None, None), (["a"], ["DT", "NN"]), (["a", None], ["DT", None])]
    return tagger.fit(spark.createDataFrame(rows + odd, "tokens array<string>, tags array<string>"), rounds=4, shards=3)


def test_accuracy_on_sentences_not_seen(learned):
    rng = random.Random(99)
    rows = [sentence(rng) for _ in range(400)]
    found = learned.tag([t for t, _ in rows])
    pairs = [(w, g, f) for (t, gold), got in zip(rows, found) for w, g, f in zip(t, gold, got)]
    assert sum(g == f for _, g, f in pairs) / len(pairs) > 0.99
    either = [(g, f) for w, g, f in pairs if w in EITHER]
    # The more frequent tag alone would be right for some 60 per cent of these.
    assert sum(g == f for g, f in either) / len(either) > 0.98 and max(sum(g == t for g, _ in either) for t in ("NN", "VB")) / len(either) < 0.75


def test_batches_equal_single_sequences(spark, learned):
    rng = random.Random(7)
    rows = [sentence(rng)[0] for _ in range(60)] + [[], None, ["the"], ["unknown", "", "Word-9"]]
    assert learned.tag(rows) == [learned.tag([r])[0] for r in rows]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t array<string>")
    got = {r.i: r.g for r in df.select("i", tagger.tags_of("t", learned).alias("g")).collect()}
    assert [got[i] for i in range(len(rows))] == learned.tag(rows)
    nouns = {r.i: r.g for r in df.select("i", tx.pos_filter(F.col("t"), learned, ("NN",)).alias("g")).collect()}
    assert all(nouns[i] == (None if r is None else [w for w, t in zip(r, got[i]) if t == "NN"]) for i, r in enumerate(rows))


def test_fitting_is_the_same_however_rows_come(spark, learned):
    rng = random.Random(3)
    rows = [sentence(rng) for _ in range(600)]
    rng.shuffle(rows)
    again = tagger.fit(spark.createDataFrame(rows, "tokens array<string>, tags array<string>").repartition(5), rounds=4, shards=3)
    assert again.tags == learned.tags and np.array_equal(again.keys, learned.keys) and np.allclose(again.weights, learned.weights, atol=1e-4)
    with pytest.raises(ValueError):
        tagger.fit(spark.createDataFrame([], "tokens array<string>, tags array<string>"))


def test_noun_cloud_counts_what_the_tagger_says(spark, sf):
    """The whole query against single sequences, tagged one by one and counted in Python."""
    words_of = roles.titles(spark, sf).where("id % 4 <> 2").select(tx.tokenize("title").alias("tokens"))
    own = tagger.fit(words_of.select("tokens", words.made_tags(F.col("tokens")).alias("tags")), rounds=3)
    want: Counter = Counter()
    for r in roles.titles(spark, sf).collect():
        left = plain_pipeline(r.title, "cloud")
        want.update(w for w, t in zip(left, own.tag([left])[0]) if t.startswith("NN"))
    assert {r.word: r.n for r in QUERIES["noun_cloud"](spark, sf).collect()} == dict(want) and len(want) > 30


def test_accuracy_on_headlines_not_seen(spark):
    """Measured: 97.0 per cent at sf0.01 (and 99.8 at sf0.1) of the made tags of the fourth that is kept out."""
    made = roles.titles(spark, "/root/testdata/sf0.01").select("id", tx.tokenize("title").alias("tokens")).select("id", "tokens", words.made_tags(F.col("tokens")).alias("tags"))
    own = tagger.fit(made.where("id % 4 <> 2"), rounds=3)
    held = made.where("id % 4 = 2").collect()
    pairs = [(g, x) for r, y in zip(held, own.tag([r.tokens for r in held])) for g, x in zip(r.tags, y)]
    assert len(pairs) > 500 and sum(g == x for g, x in pairs) / len(pairs) > 0.95
