"""Language ID, tokens, quality, HTML and conversations: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import collections
import hashlib
import html
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from broadsheet.llm import html_text, language, outliers, pieces, queries, quotations, rules, text_stats


def documents(spark, sf):
    return {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


# SentencePiece


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = queries.tokenizer_path(spark)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    alphabet = " ▁\n\tab<s>é☃\U0001f600.  ▁"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    texts += ["", " ", "  ", "a ", "▁", "<s>", "</s>", "<0x0A>", "a\x00b", "ﬁ  x　", "word " * 3000, "x" * 5000]
    # A table that starts anew all the time, and one that holds every word; texts one by one and together.
    for encoder, step in ((pieces.Encoder(path, table_bytes=2000), 7), (pieces.Encoder(path), 1), (pieces.Encoder(path), len(texts))):
        for at in range(0, len(texts), step):
            part = texts[at : at + step]
            ids, bounds, back = encoder.encode(part)
            for k, t in enumerate(part):
                want = sp.encode(t)
                assert ids[bounds[k] : bounds[k + 1]].tolist() == want and back[k] == sp.decode(want)


def test_pieces_of_all_documents(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path(spark))
    docs = documents(spark, sf)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in queries.op9_sentencepiece(spark, sf).collect():
        ids = sp.encode(docs[r.doc_id].text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(sp.decode(ids)))


def test_pieces_of_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, 5, "x"), (2, "", 6, None)], "doc_id long, text string, ids int, decoded string")
    got = pieces.encode(df, queries.tokenizer_path(spark)).collect()
    assert [(r.doc_id, r.n_tokens, r.ids, r.decoded) for r in got] == [(1, 0, [], ""), (2, 0, [], "")]
    assert pieces.encode_digest(df.limit(0), queries.tokenizer_path(spark)).count() == 0


# Language ID


def test_language_of_held_out_documents(spark, sf):
    docs = documents(spark, sf)
    got = queries.op4_language_id(spark, sf).collect()
    out = [r for r in got if r.held_out]
    assert len(got) == len(docs) and out
    right = sum(r.lang_pred == docs[r.doc_id].lang for r in out) / len(out)
    assert right >= 0.95 and all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(i, "le chat est dans la maison " * 3, "fr") for i in range(40)] + [(100 + i, "the cat is in the house " * 3, "en") for i in range(40)]
    df = spark.createDataFrame(rows + [(200, None, "fr"), (201, "x", None), (None, "le", "fr")], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert model.langs == ["en", "fr"]
    asked = [(1, None), (2, ""), (3, "123 ... !"), (4, "The house"), (5, "LA MAISON"), (6, "漢字"), (7, "the cat " * 20000), (4, "The house"), (None, "le chat")]
    got = language.identify(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got[:5]] == ["und", "und", "und", "en", "fr"] and got[6].lang_pred == "en" and got[8].lang_pred == "fr"
    assert [r.rejected for r in got[:5]] == [True, True, True, False, False] and got[5].rejected and got[0].score == 0
    nothing = language.fit(df.limit(0))
    assert {r.lang_pred for r in language.identify(df, nothing).collect()} == {"und"}


def test_language_probabilities_sum_to_one():
    """Interpolated Kneser-Ney by a plain recursion over the same counts."""
    texts = pa.array(["abab abba", "baab aab"])
    g, _, _ = language.grams(texts)
    u, c = np.unique(g, return_counts=True)
    model = language.Model(["x"], [(u, c)])
    symbols = [ord("a"), ord("b"), 32]
    context = (32 << 32) | (32 << 16) | ord("a")
    total = 0.0
    for s in range(65536):
        if s in symbols:
            row = model.grams[4].find(np.array([(context << 16) | s], np.uint64))[0]
            key, p, n = (context << 16) | s, None, 4
            weight = 0.0
            while p is None:
                row = model.grams[n].find(np.array([key & ((1 << (16 * n)) - 1)], np.uint64))[0]
                if row >= 0:
                    p = float(model.log[n][row, 0]) + weight
                else:
                    at = model.contexts[n].find(np.array([(key & ((1 << (16 * n)) - 1)) >> 16], np.uint64))[0]
                    weight += float(model.weight[n][at, 0]) if at >= 0 else 0.0
                    n -= 1
            total += np.exp(p)
    assert 0.95 < total <= 1.0001  # what is left is the share of unseen symbols


def plain_kneser_ney(texts):
    """Cross-entropy in nats per symbol by a recursion over dictionaries of strings, straight from the definition."""

    def clean(t):
        return "   " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "

    seen = {4: collections.Counter()}
    for t in texts:
        s = clean(t)
        seen[4].update(s[k : k + 4] for k in range(len(s) - 3))
    for n in (3, 2, 1):
        seen[n] = collections.Counter(g[1:] for g in seen[n + 1])
    discount = {}
    for n, c in seen.items():
        ones, twos = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
        discount[n] = min(max(ones / (ones + 2 * twos), 0.1), 0.95) if ones and twos else 0.75

    def p(g):
        n = len(g)
        if n == 0:
            return 1 / 65536
        row = {k: v for k, v in seen[n].items() if k[:-1] == g[:-1]}
        if not row:
            return p(g[1:])
        total = sum(row.values())
        return max(row.get(g, 0) - discount[n], 0) / total + discount[n] * len(row) / total * p(g[1:])

    def entropy(t):
        s = clean(t)
        return -sum(np.log(p(s[k : k + 4])) for k in range(len(s) - 3)) / (len(s) - 3)

    return entropy


def test_cross_entropies_equal_a_plain_recursion(spark):
    texts = {"aa": ["abab abba, cab!", "Baab aab bca", "zebra a b"], "bb": ["wxyx xyw", "yw yxw wwx 12 xyxy", "ab"]}
    langs = sorted(texts)
    counts = [np.unique(language.grams(pa.array(texts[x]))[0], return_counts=True) for x in langs]
    asked = ["abba cab", "xyx wab", "unseen q", "a", "B! 7 c"]
    want = np.array([[plain_kneser_ney(texts[x])(t) for x in langs] for t in asked])
    assert np.allclose(language.Model(langs, counts).cross_entropies(pa.array(asked))[0], want, atol=1e-5)
    rows = [(i * 10 + k, t, x) for i, x in enumerate(langs) for k, t in enumerate(texts[x])]
    stored = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert np.allclose(stored.cross_entropies(pa.array(asked))[0], want, atol=1e-5)


def test_rejection_is_calibrated(spark, sf):
    """Sentences of languages that were not learned go, texts of the tables and very short ones of their words stay."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(docs)
    other = [
        "Il presidente della repubblica ha detto che il governo non può continuare così per molto tempo senza una nuova legge.",
        "De regering heeft vandaag besloten dat de nieuwe wet niet voor het einde van het jaar wordt ingevoerd.",
        "Tänään eduskunta päätti että uusi laki ei tule voimaan ennen vuoden loppua koska hallitus ei ole valmis.",
        "Prezydent powiedział wczoraj że rząd nie może dalej działać bez nowej ustawy.",
    ]
    assert all(model.predict(pa.array(other))[3]) and model.predict(pa.array([t * 20 for t in other]))[3].all()
    assert not model.predict(pa.array(["Sh is.", "the", "Thnt eringing onheed, with erenenst."]))[3].any()
    gone = language.identify(docs, model).where("rejected").join(docs, F.col("id") == F.col("doc_id")).collect()
    assert all(not any(c.isalpha() for c in r.text or "") for r in gone)


def test_calibration_takes_every_kept_out_row(spark, monkeypatch):
    """However many rows are labelled, a tenth of them sets limits and score (they were about 4,000 at most), as numpy finds them."""
    rows = [(i, f"{'the and of' if i % 2 else 'der und das'} {'abcdefgh'[i % 8] * (1 + i % 5)}", "en" if i % 2 else "de") for i in range(60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked, calibrate = [], language.Model.calibrate

    def noted(self, found):
        asked.append(found.toPandas())
        calibrate(self, found)

    monkeypatch.setattr(language.Model, "calibrate", noted)
    model = language.fit(df)
    (f,) = asked
    assert len(f) == df.where("pmod(xxhash64(doc_id), 10) = 0").count() > 5_500
    right = f[f["right"]]
    for j in range(2):
        assert model.median[j] == pytest.approx(np.median(right[right["best"] == j]["lowest"]))
    above = (right["lowest"] - model.median[right["best"]])[right["symbols"] < 48]
    assert model.excess[0] == pytest.approx(np.quantile(above, 0.999))
    p = 1 / (1 + np.exp(-(model.slope * f["margin"] + model.offset)))
    m = np.median(f["margin"])
    last = 1 / (1 + np.exp(-(model.slope * m + model.offset)))
    first = 1 / (1 + np.exp(-model.offset))
    # The curve's sums are those of the rows, two more rows included.
    assert (f["right"] - p).sum() + (1 - last) - first == pytest.approx(0, abs=1e-4)


def test_languages_of_odd_rows(spark):
    """Ties between equal models, repeated rows, clashing names and a very long text."""
    rows = [(i, "uno dos tres cuatro", lang) for i, lang in enumerate(["xx", "yy"] * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id": F.lit("c"), "score": F.lit(1), "body": F.lit(None).cast("string")})
    model = language.fit(df.where("doc_id < 2"))
    asked = spark.createDataFrame([(1, "uno dos", 0), (1, "uno dos", 0), (None, "tres " * 200_000, 1)], "doc_id long, text string, rejected int")
    got = language.identify(asked, model).collect()
    assert [(r.id, r.lang_pred) for r in got] == [(1, "xx"), (1, "xx"), (None, "xx")]


def test_stored_language_model_keeps_every_gram(spark, monkeypatch):
    """Against the estimates made in memory from all counts; 90 languages left room for 987 grams each under the old cap."""
    rng = random.Random(4)
    monkeypatch.setattr(language, "PART_ROWS", 60_000)
    monkeypatch.setattr(language, "STEP_CELLS", 30_000)
    letters = "abcdefghijklmnopqrstuvwxyzéß漢字가나"
    rows = [(i, " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(250)), f"l{i % 90:02d}") for i in range(90)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts = [np.unique(language.grams(pa.array([t for _, t, own in rows if own == lang]))[0], return_counts=True) for lang in model.langs]
    assert min(len(g) for g, _ in counts) > 987
    plain = language.Model(model.langs, counts)
    asked = pa.array([t[:200] for _, t, _ in rows[:40]] + ["unseen words", "", "漢字가나 漢", None])
    for got, want in zip(model.cross_entropies(asked), plain.cross_entropies(asked)):
        assert np.allclose(got, want, atol=1e-4)


# Quality


def plain_stats(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    count = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = [False] * len(w)
    for k in range(len(w) - 4):
        if count[tuple(w[k : k + 5])] > 1:
            covered[k : k + 5] = [True] * 5
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, sum(covered))


def test_statistics_match_plain_counts(spark, sf):
    rng = random.Random(3)
    texts = [r.text for r in documents(spark, sf).values()] + [None, "", "\n\n", "a b a b a b a b a b a b", "é é  x\n x", "l\nl\n l\nl \n"]
    texts += ["".join(rng.choice("ab \n#é|") for _ in range(60)) for _ in range(300)]
    got = text_stats.count(pa.array(texts))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert [tuple(int(got[n][i]) for n in names) for i in range(len(texts))] == [plain_stats(t) for t in texts]


def test_quality_rules(spark, sf):
    docs = documents(spark, sf)
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    got = queries.op7_quality_rules(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_stats(docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r for r in got if r.doc_id in good and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)


def test_outliers_are_rejected(spark, monkeypatch):
    monkeypatch.setattr(outliers, "MIN_GROUP", 50)
    rng = random.Random(8)
    words = [f"mot{i}" for i in range(400)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(80)) + ".", "fr", "s") for i in range(120)]
    rows += [(1000 + i, " ".join(rng.choice(words) + "###" for _ in range(80)), "fr", "s") for i in range(12)]
    rows += [(2000, None, None, None), (2001, "", "fr", None), (2002, " ".join(words[:40]), None, "s"), (2003, " ".join(words[:40]), None, "s")]
    got = {r.id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(120)) and not any(got[1000 + i] for i in range(12))
    assert not got[2000] and not got[2001] and len(got) == len(rows)
    assert outliers.judge(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_outliers_of_small_sources_are_rejected(spark, monkeypatch):
    """A source of one document is judged by all documents of its language, and a small language by the table."""
    monkeypatch.setattr(outliers, "MIN_GROUP", 50)
    rng = random.Random(8)
    words = [f"mot{i}" for i in range(400)]
    good = lambda: " ".join(rng.choice(words) for _ in range(80)) + "."
    bad = lambda: " ".join(rng.choice(words) + "###" for _ in range(80))
    rows = [(i, good(), "fr", "hot") for i in range(120)]
    rows += [(1000, bad(), "fr", "one"), (1001, good(), "fr", "other"), (1002, bad(), "it", "one"), (1003, good(), "de", None)]
    got = {r.id: r.kept for r in outliers.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(120)) and [got[1000 + i] for i in range(4)] == [False, True, False, True]


def test_distributions_and_cuts():
    """Textbook quantiles, and cuts that approach the chi-square one from above as groups grow."""
    assert abs(outliers.chi2_cdf(14.0671, 7) - 0.95) < 1e-5 and abs(outliers.f_cdf(2.5140, 7, 20) - 0.95) < 1e-4
    cuts = [outliers.cut(n) for n in (100, 200, 1000, 10**5, 10**8)]
    assert cuts == sorted(cuts, reverse=True) and abs(cuts[-1] - 29.88) < 0.05
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200_000, 7))
    d = (x**2).sum(1)
    assert np.allclose(np.cov(x[d <= np.quantile(d, outliers.H)].T) * outliers.consistency(outliers.H), np.eye(7), atol=0.03)


def plain_mcd(x, rng, starts=300):
    """Least log determinant over concentration steps from random subsets."""
    h, best = int(np.ceil(outliers.H * len(x))), np.inf
    for _ in range(starts):
        part = x[rng.choice(len(x), 8, replace=False)]
        for _ in range(60):
            mean, c = part.mean(0), outliers._regular(np.cov(part.T, bias=True))
            d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(c), x - mean)
            new = x[np.argsort(d, kind="stable")[:h]]
            if new.shape == part.shape and (new == part).all():
                break
            part = new
        best = min(best, np.linalg.slogdet(c)[1])
    return best


def test_estimates_reach_the_least_determinant(spark):
    rng = np.random.default_rng(5)
    groups = {}
    for name, share in (("clean", 0.0), ("some", 0.1), ("many", 0.2)):
        shape = rng.normal(size=(7, 7)) * 0.3
        x = rng.normal(size=(160, 7)) @ shape
        bad = int(share * len(x))
        x[:bad] = rng.normal(size=(bad, 7)) * 0.2 + rng.normal(size=7) * 3
        groups[name] = x
    rows = [(name, *map(float, r), *map(float, np.median(x, 0))) for name, x in groups.items() for r in x]
    points = spark.createDataFrame(rows, "g string, " + ", ".join(f"x{i} double" for i in range(7)) + ", " + ", ".join(f"c{i} double" for i in range(7)))
    got = {r.g: r.logdet for r in outliers.estimate(points, 3, outliers.Scratch(spark, "test")).collect()}
    for name, x in groups.items():
        assert got[name] <= plain_mcd(x, rng) + 0.05, name


def test_quality_of_odd_rows(spark):
    """Clashing names, repeated rows, null ids and a very long text."""
    long = " ".join(f"w{k}" for k in range(120_000))
    rows = [(1, long, "en", "s", 7, 0.5), (1, long, "en", "s", 8, 0.5), (None, None, None, None, 9, None), (2, "short", "en", "s", 1, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_symbols int, m_id double").withColumns({"g": F.lit("x"), "f_symbols": F.lit(1), "x0": F.lit(0), "id": F.lit(3), "body": F.lit("b")})
    got = [(r.id, r.n_words, r.base_failed, r.kept) for r in outliers.judge(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 120_000, False, True), (1, 120_000, False, True), (None, 0, True, False), (2, 1, True, False)], key=repr)
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    scored = rules.score(df, rules.fit(df, labels)).collect()
    assert sorted(str(r.id) for r in scored) == ["1", "1", "2", "None"] and all(0 <= r.score <= 1 for r in scored)


def test_lasso_meets_its_optimality_conditions():
    """At the optimum the gradient is opposite to the penalty where a weight is not 0, and within it where it is."""
    rng = np.random.default_rng(4)
    z = (rng.random((400, 25)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * z[:, 0] - 3 * z[:, 1] + z[:, 2] - 0.3)))).astype(float)
    for penalty in (0.002, 0.01, 0.05, 1.0):
        w = rules._lasso(z, y, penalty, np.zeros(26), 20_000)
        g = np.concatenate([np.ones((400, 1)), z], 1).T @ (1 / (1 + np.exp(-(w[0] + z @ w[1:]))) - y) / 400
        assert abs(g[0]) < 1e-4
        on = w[1:] != 0
        assert np.allclose(g[1:][on], -penalty * np.sign(w[1:][on]), atol=1e-4) and (np.abs(g[1:][~on]) <= penalty + 1e-4).all()
        assert on.any() == (penalty < 1)


def test_rules_are_the_paths_of_the_trees():
    """Every rule is a conjunction along a path: it holds for the rows that a walk down the tree brings there."""
    rng = np.random.default_rng(6)
    x = rng.random((300, len(rules._NAMES)))
    y = ((x[:, 0] > 0.5) & (x[:, 3] < 0.4)).astype(float)
    ensemble = rules.train(x, y)
    used = {name for r, _ in ensemble.rules for name, _, _ in r.terms}
    assert {rules._NAMES[0], rules._NAMES[3]} <= used and all(1 <= len(r.terms) <= rules.DEPTH for r, _ in ensemble.rules)
    assert ((ensemble.score(x) > 0.5) == (y > 0.5)).mean() > 0.97
    for r, _ in ensemble.rules:
        want = [all((row[rules._NAMES.index(n)] > c) == above for n, above, c in r.terms) for row in x]
        assert r.holds(x).tolist() == want


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [r for r in queries.op6_quality_classifier(spark, sf).collect() if r.held_out and r.doc_id in labels]
    good, bad = [r.score for r in got if labels[r.doc_id] == 1], [r.score for r in got if labels[r.doc_id] == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad])
    assert auc >= 0.95 and all(r.predicted == int(r.score >= 0.3) for r in got)


def test_compiled_rules_equal_the_ensemble(spark):
    rng = np.random.default_rng(1)
    x = rng.random((600, len(rules.FEATURES)))
    y = ((x[:, 0] < 0.5) & (x[:, 3] > 0.2)).astype(float)
    e = rules.train(x, y)
    assert 0 < len(e.rules) < 60 and np.mean((e.score(x) > 0.5) == y) > 0.97
    df = spark.createDataFrame([tuple(map(float, r)) for r in x[:100]], ", ".join(f"f_{n} double" for n in rules.FEATURES))
    assert np.allclose([r.s for r in df.select(e.column().alias("s")).collect()], e.score(x[:100]))


def test_classifier_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words here")], "doc_id long, text string")
    none = rules.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in rules.score(docs, none).collect()} == {0.5}
    one = rules.fit(docs, spark.createDataFrame([(3, 1), (3, 1), (None, 0), (2, None)], "doc_id long, quality int"))
    assert len({r.score for r in rules.score(docs, one).collect()}) == 1
    assert rules.score(docs.limit(0), one).count() == 0


# HTML


def test_articles_of_all_pages(spark, sf):
    got = {r.page_id: r for r in queries.op3_html_extraction(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(?:p|h1|br)>", " ", article))).split())
        assert (got[r.page_id].text, got[r.page_id].n_chars) == (want, len(want))


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>a &amp; b<br>c&nbsp;d</p>", "a & b c d"),
        ("<article><header><h1>T</h1></header><p>x<b>y</b>z<div class='comments'><p>no</div></article><footer>f</footer>", "T xyz"),
        ("<main><p>keep<form><p>no</form><aside>no</aside><p>end</main>out", "keep end"),
        ("<body><nav>n</nav><div class='cookie-banner'>c</div><script>if (a<b) '</p>'</script><style>p{}</style><p>only", "only"),
        ("<p>open <!-- <p>no</p> --> text</p><textarea>no", "open text"),
        ("<article><p>one</p><ul class='share'><li>no</ul><ul><li>yes</ul></article>", "one yes"),
    ],
)
def test_blocks(page, want):
    assert " ".join(t for _, t in html_text.blocks(page)) == want


def test_host_boilerplate_goes_and_equal_pages_stay(spark):
    menu = "Home News Sport Weather Contact us today"
    rows = [(i, f"https://h.example/{i}", f"<div>{menu}</div><div>Story number {i} has its own text</div>") for i in range(5)]
    rows += [(9, "https://h.example/0?ref=x", rows[0][2]), (10, None, rows[0][2]), (11, "https://other.example/1", rows[0][2]), (12, "https://h.example/n", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.id: r.text for r in html_text.extract(df).collect()}
    for i in range(5):
        assert got[i] == f"Story number {i} has its own text"
    assert got[9] == got[0] and got[10] == got[11] == f"{menu} Story number 0 has its own text" and got[12] == ""
    assert html_text.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><a href="/main">Home</a><h1>Title</h1><p>story', "Home Title story"),
        ('<div class="site no-sidebar"><article><p>text</article></div>', "text"),
        ('<div id="page" class="hfeed site has-header"><main><p>text</main></div>', "text"),
        ('<div class="side-by-side"><p>text</div>', "text"),
        ('<div class="follow-up"><p>text</div>', "text"),
        ('<article class="commentary"><p>text</article>', "text"),
        ('<article><div class="entry-header"><h1>Headline</h1></div><p>text</article>', "Headline text"),
        ('<div class="main-logo">Logo</div><div class="content"><p>Story</div>', "Logo Story"),
        ('<div class="notice sidebar"><article><p>text</article></div>', "text"),
        ('<form id="aspnet"><div class="header">top</div><article><p>text</article></form>', "text"),
        ('<article><p>text</p><article class="comment"><p>reader</article><aside><article><p>teaser</article></aside></article>', "text"),
        ('<div role="navigation">n</div><div role="main"><p>text</p><div class="ad">buy</div></div><div role="contentinfo">f</div>', "text"),
        ('<article><p hidden>no</p><p style="display: none">no</p><p>yes</article>', "yes"),
    ],
)
def test_markup_drops_only_what_it_names(page, want):
    assert " ".join(t for _, t in html_text.blocks(page)) == want


def plain_text(rows, least):
    """The whole rule with sets of token windows and no suffix array, over all pages of a host at once."""
    pages = []
    for i, url, page in rows:
        own = html_text.blocks(page)
        words = [(k, w) for k, (kind, text) in enumerate(own) if kind == html_text.UNSURE for w in text.split(" ")]
        windows = {tuple(w for _, w in words[a : a + least]) for a in range(len(words) - least + 1)}
        pages.append((i, url and url.split("/")[2], own, words, windows, [t for kind, t in own if kind == html_text.UNSURE]))
    out = {}
    for i, host, own, words, _, stream in pages:
        gone = [False] * len(words)
        for a in range(len(words) - least + 1):
            w = tuple(x for _, x in words[a : a + least])
            if host and any(h == host and st != stream and w in ws for _, h, _, _, ws, st in pages):
                gone[a : a + least] = [True] * least
        parts = []
        for k, (kind, text) in enumerate(own):
            if kind == html_text.KEEP:
                parts.append(text)
            else:
                cut = html_text.whole_runs(np.array([g for (b, _), g in zip(words, gone) if b == k]), least)
                parts.append(" ".join(w for w, g in zip(text.split(" "), cut) if not g))
        out[i] = " ".join(x for x in parts if x)
    return out


@pytest.mark.parametrize("shard", [4_000_000, 1500])
def test_hosts_match_brute_force_however_they_are_dealt(spark, monkeypatch, shard):
    """Undecided pages, articles with short blocks, boilerplate on two or many pages, copies under two addresses."""
    monkeypatch.setattr(html_text, "SHARD_CHARS", shard)
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    text = lambda n: " ".join(word() for _ in range(n))
    common = [text(rng.randint(2, 9)) for _ in range(8)]
    rows = []
    for i in range(90):
        host = rng.choice(["big.example", "big.example", "big.example", "small.example", None])
        parts = [text(rng.randint(3, 60)) for _ in range(rng.randint(1, 4))]
        for _ in range(rng.randint(0, 4)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(common))
        body = "".join(f"<{t}>{x}</{t}>" for x in parts for t in [rng.choice(["p", "div", "li"])])
        page = f"<div>{rng.choice(common)}</div><article>{body}</article>" if i % 2 else f"<body>{body}"
        if rows and i % 7 == 0:
            page = rng.choice(rows)[2]
        rows.append((i, host and f"https://{host}/{i}", page))
    got = {r.id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = plain_text(rows, html_text.LEAST_TOKENS)
    assert got == want
    assert sum(want[i] != " ".join(t for _, t in html_text.blocks(rows[i][2])) for i in want) > 20


def test_pages_of_odd_rows(spark):
    """Clashing names, repeated page ids and a very long page."""
    long = "<article>" + "".join(f"<p>{' '.join(f'w{k}x{j}' for j in range(50))}</p>" for k in range(3000)) + "</article>"
    rows = [(1, "https://h/1", long, "a"), (1, "https://h/1", "<p>one two", "b"), (None, None, None, "c")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumns({"host": F.lit("x"), "row": F.lit(1), "kinds": F.lit(2), "id": F.lit(3)})
    got = [(r.id, len(r.text)) for r in html_text.extract(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, len(re.sub("</p><p>", " ", long)) - len("<article><p></p></article>")), (1, 7), (None, 0)], key=repr)


def test_suffix_array_matches_plain_search():
    rng = random.Random(6)
    streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(12)]
    made = html_text.Streams([[" ".join(s)] if s else [] for s in streams])
    covered = made.shared(4, np.zeros(0, np.int64))
    for p, k, a, b in made.bounds:
        s, want = streams[p], [False] * len(streams[p])
        for i in range(len(s) - 3):
            run = s[i : i + 4]
            if any(o != s and any(o[k : k + 4] == run for k in range(len(o) - 3)) for o in streams):
                want[i : i + 4] = [True] * 4
        assert list(covered[a:b]) == want
    tokens = np.array([rng.randrange(3) for _ in range(60)])
    order, ranks = html_text.suffix_array(tokens)
    suffixes = sorted(range(60), key=lambda i: tokens[i:].tolist())
    assert list(order) == suffixes
    lcp = html_text.common_prefixes(order, ranks)
    for k in range(1, 60):
        a, b = tokens[order[k - 1] :].tolist(), tokens[order[k] :].tolist()
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert lcp[k] == n


# Conversations


def test_threads(spark):
    rows = [
        (1, 0, "u", "Hello there everyone, a first message."),
        (1, 1, "a", "Second independent message here"),
        (1, 2, "u", "On Monday A wrote:\n> Hello there everyone,  A FIRST message.\nMy reply to first"),
        (1, 3, "a", "> > Hello there everyone, a first message.\n> My reply to first\nthird level"),
        (1, 4, "u", "> Second independent message here\nok"),
        (2, 0, "u", None),
        (2, 1, "u", "> Second independent message here"),
        (None, 1, "u", "x"),
        (3, 5, "b", "same"),
        (3, 5, "a", "same"),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, head int, label string")
    got = {(r.conv_id, r.turn, r.role): (r.text, r.n_quotes, r.reply_to, r.thread, r.position) for r in quotations.link(df).collect()}
    assert got[1, 0, "u"][2:] == (None, 0, 1) and got[1, 2, "u"] == ("My reply to first", 1, 0, 0, 2)
    assert got[1, 3, "a"] == ("third level", 2, 2, 0, 3)
    assert got[1, 1, "a"][2:] == (None, 1, 4) and got[1, 4, "u"] == ("ok", 1, 1, 1, 5)
    assert got[2, 0, "u"] == ("", 0, None, 0, 1) and got[2, 1, "u"] == ("", 1, None, 1, 2)
    assert got[3, 5, "a"][4] == 1 and got[3, 5, "b"][4] == 2 and got[None, 1, "u"][2:] == (None, 1, 1)
    assert quotations.link(df.limit(0)).count() == 0


def test_short_quotes_are_weak_evidence(spark):
    rows = [
        (1, 0, "u", "A long opening line\n\nsounds good"),
        (1, 1, "a", "Sounds good"),
        (1, 2, "u", "> sounds good\nthanks"),
        (1, 3, "a", "> sounds good\n\n> A long opening line\nboth"),
        (1, 4, "u", "> never said\nown"),
    ]
    got = {r.turn: (r.reply_to, r.thread) for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: (None, 0), 1: (None, 1), 2: (1, 1), 3: (0, 0), 4: (None, 4)}


def plain_links(rows):
    """Parents by comparing every quoted passage with every message of the conversation, from the rule as it is stated."""
    out = {}
    for conv, turn, _, text in rows:
        _, _, quoted = quotations.parse(text)
        votes: dict = {}
        for level, passage in quoted:
            holders = sorted({t for c, t, _, x in rows if c == conv and t < turn and passage in quotations.parse(x)[1]})
            first = sorted({t for c, t, _, x in rows if c == conv and passage in quotations.parse(x)[1]})
            whole = sorted({t for c, t, _, x in rows if c == conv and t < turn and passage in quotations.parse(x)[1] and quotations._normal(quotations.parse(x)[0]) == passage})
            strong = len(passage) >= quotations.LEAST_CHARS
            if not strong and whole:
                votes.setdefault((strong, whole[0]), []).append((True, level, len(passage)))
            elif holders and first[0] == holders[0]:
                votes.setdefault((strong, holders[0]), []).append((False, level, len(passage)))
        if votes:
            best = max(votes.items(), key=lambda v: (v[0][0], any(w for w, _, _ in v[1]), -min(n for _, n, _ in v[1]), sum(s for _, _, s in v[1]), v[0][1]))
            out[conv, turn] = best[0][1]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_links_of_generated_threads_match_brute_force(spark, seed):
    """Messages that quote earlier ones whole or in part, nested, with short quotes, repeats and changed spacing."""
    rng = random.Random(seed)
    words = "plan budget river train meeting lunch notes report yes ok fine later tomorrow never always maybe".split()
    rows = []
    for conv in range(6):
        texts: list[str] = []
        for turn in range(14):
            own = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 3)))
            if texts and rng.random() < 0.75:
                quoted = rng.choice(texts)
                lines = quoted.split("\n")
                if rng.random() < 0.5:
                    lines = lines[rng.randrange(len(lines)) :]
                mark = rng.choice([">", "> ", " > "])
                own = rng.choice(["", "On Monday A wrote:\n"]) + "\n".join(mark + x.replace(" ", rng.choice([" ", "  "])) for x in lines) + "\n\n" + own
            texts.append(own)
            rows.append((conv, turn, "user", own))
    got = quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): r.reply_to for r in got if r.reply_to is not None} == plain_links(rows)
    for r in got:
        assert ">" not in r.text and r.thread <= r.turn
    for conv in range(6):
        own = sorted((r for r in got if r.conv_id == conv), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(1, 15))
        place = {r.turn: r.position for r in own}
        assert all(place[r.reply_to] < r.position for r in own if r.reply_to is not None)


def test_conversations_of_odd_rows(spark):
    """Null ids, turns and texts, repeated rows, clashing names and a very long message."""
    long = "word " * 300_000
    rows = [(1, 1, "user", long, 5), (1, 2, "user", "> " + long + "\nanswer", 6), (1, 2, "user", None, 7), (None, 1, "user", "> " + long, 8), (1, None, None, "x", 9), (2, 1, "a", "same", 1), (2, 1, "a", "same", 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, position int").withColumns({"thread": F.lit("t"), "key": F.lit(1), "head": F.lit(2), "level": F.lit(0)})
    got = quotations.link(df).collect()
    assert len(got) == len(rows)
    assert {(r.conv_id, r.turn, r.text) : r.reply_to for r in got}[1, 2, "answer"] == 1
    assert sorted(r.position for r in got if r.conv_id == 2) == [1, 2] and [r.reply_to for r in got if r.conv_id is None] == [None]


def test_all_conversations_keep_their_order(spark, sf):
    got = queries.op10_chat_formatting(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.conv_id].append((r.position, r.turn))
    assert len(got) == spark.read.parquet(f"{sf}/conversations.parquet").count()
    for v in by.values():
        assert [p for p, _ in sorted(v)] == list(range(1, len(v) + 1)) and [t for _, t in sorted(v)] == sorted(t for _, t in v)
