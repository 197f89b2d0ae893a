"""Matrix models against plain linear algebra, and rule-based polarity against published examples."""

from __future__ import annotations

import numpy as np
import pytest

from broadsheet.operators import lexicon, models
from broadsheet.plans import text  # noqa: F401  registers the queries
from broadsheet.plans.registry import QUERIES


def test_components_equal_an_eigendecomposition(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.array([r.embedding for r in rows], float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    values, vectors = np.linalg.eigh(np.cov(z.T))
    values, vectors = values[::-1], vectors[:, ::-1]
    k = int(np.searchsorted(np.cumsum(values) / values.sum(), 0.95) + 1)
    got = {r.vec_id: r.components for r in QUERIES["pca"](spark, sf).collect()}
    assert len(got) == len(rows) and {len(c) for c in got.values()} == {k}
    found = np.array([got[r.vec_id] for r in rows])
    want = z @ vectors[:, :k]
    signs = np.sign((found * want).sum(0))
    assert np.allclose(found * signs, want, atol=1e-6)


def test_factors_recover_a_product(spark):
    rng = np.random.default_rng(3)
    h = np.zeros((3, 12))
    for c in range(3):
        h[c, 4 * c : 4 * c + 4] = rng.random(4) + 0.5
    w = rng.random((200, 3)) * (rng.random((200, 3)) < 0.5)
    v = w @ h
    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for r in v]
    got = models.nmf(spark.createDataFrame(rows, "at array<int>, values array<double>"), 12, 3, iterations=30)
    assert (got >= 0).all()
    cosine = (got / np.linalg.norm(got, axis=1, keepdims=True)) @ (h / np.linalg.norm(h, axis=1, keepdims=True)).T
    assert sorted(cosine.argmax(1)) == [0, 1, 2] and (cosine.max(1) > 0.98).all()
    # The same rounds on the whole matrix in one place.
    plain = np.random.default_rng(7).random((3, 12)) + 0.1
    for _ in range(30):
        loads = models._loads(v, plain, 20)
        plain = plain * (loads.T @ v) / (loads.T @ loads @ plain + 1e-9)
    assert np.linalg.norm(v - models._loads(v, got, 50) @ got) <= 1.05 * np.linalg.norm(v - models._loads(v, plain, 50) @ plain) + 1e-6


def test_density_clusters():
    rng = np.random.default_rng(1)
    blobs = [rng.normal(c, 0.2, (40, 2)) for c in ((0, 0), (5, 0), (0, 5))]
    noise = np.array([[20.0, 20.0], [-20.0, 9.0], [3.0, -30.0]])
    x = np.concatenate([*blobs, noise])
    got = models.density_clusters(x, 10)
    assert [set(got[40 * k : 40 * k + 40]) - {-1} for k in range(3)] == [{0}, {1}, {2}]
    assert (got[:120] == -1).sum() < 12 and set(got[120:]) == {-1}
    order = rng.permutation(len(x))
    again = models.density_clusters(x[order], 10)
    same = lambda a: {frozenset(np.flatnonzero(a == c)) for c in set(a) - {-1}}
    back = np.empty_like(again)
    back[order] = again
    assert same(back) == same(got)
    assert list(models.density_clusters(x[:3], 10)) == [-1, -1, -1] and len(models.density_clusters(x[:0], 5)) == 0


def test_groups_of_density_clusters(spark):
    rows = [(g, i, [float(g * 10 + i % 2 * 5 + i * 0.01)]) for g in (1, 2) for i in range(40)]
    df = spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>")
    got = {(r.label, r.vec_id): r.cluster for r in models.clustered(df, "vec_id", "embedding", "label").collect()}
    assert all(got[g, i] == i % 2 for g in (1, 2) for i in range(40))


def test_large_groups_of_density_clusters(spark, monkeypatch):
    """A group beyond the limit of one task, which was an error, gets the clusters of one task from blocks."""
    rng = np.random.default_rng(3)
    spots = {7: [(0, 0), (4, 0), (0, 4)], None: [(0, 0), (9, 9)]}
    rows = [(g, i, [float(c) for c in rng.normal(at[i % len(at)], 0.4)]) for g, at in spots.items() for i in range(150)] + [(1, i, [float(i % 2 * 5 + i * 0.01)]) for i in range(20)]
    df = spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>")
    want = {(r.label, r.vec_id): r.cluster for r in models.clustered(df, "vec_id", "embedding", "label").collect()}
    assert len(want) == 320 and max(want.values()) >= 1
    monkeypatch.setattr(models, "MOST_POINTS", 100)
    monkeypatch.setattr(models, "BLOCK_POINTS", 40)
    assert {(r.label, r.vec_id): r.cluster for r in models.clustered(df, "vec_id", "embedding", "label").collect()} == want


def test_grids_and_factors_give_rows(spark, sf):
    grid = QUERIES["lda_grid"](spark, sf).collect()
    assert {(r.k, r.decay) for r in grid} == {(3, 0.6), (3, 0.9), (5, 0.6), (5, 0.9)} and all(r.perplexity > 0 for r in grid)
    topics = QUERIES["nmf_topics"](spark, sf).collect()
    assert {r.topic for r in topics} == set(range(5)) and all(0 <= r.pct <= 100 for r in topics)
    assert QUERIES["density_clusters"](spark, sf).count() == 500


def test_grid_over_folds_equals_a_plain_loop(spark):
    """Two kinds of documents with words of their own: the same means as fits one by one over the same folds."""
    from pyspark.ml.clustering import LDA
    from pyspark.ml.linalg import Vectors
    from pyspark.sql import functions as F

    rng = np.random.default_rng(4)
    rows = [(i, Vectors.sparse(12, sorted((6 * (i % 2) + int(w), float(n)) for w, n in zip(rng.choice(6, 4, replace=False), rng.integers(1, 5, 4))))) for i in range(80)]
    counts = spark.createDataFrame(rows, ["id", "features"])
    got = models.lda_grid(counts, "features", [2, 6], [0.6], iterations=15, folds=3).collect()
    fold = F.pmod(F.xxhash64("id"), F.lit(3))
    want = {}
    for k in (2, 6):
        found = []
        for f in range(3):
            model = LDA(k=k, maxIter=15, seed=7, optimizer="online", learningDecay=0.6).fit(counts.where(fold != f))
            found.append(model.logPerplexity(counts.where(fold == f)))
        want[k] = np.mean(found), np.std(found)
    # Sampling of mini-batches follows the partitions, so the numbers are close, and the order is the same.
    assert [r.k for r in got] == sorted(want, key=lambda k: want[k][0])
    assert all(abs(r.perplexity - want[r.k][0]) < 0.1 for r in got)
    assert models.lda_grid(counts.limit(0), "features", [2], [0.6]).count() == 0
    assert models.lda_grid(counts.limit(1), "features", [2], [0.6], iterations=2).count() == 1


#: Valences of the published lexicon for the words of its authors' examples.
VALENCES = {"smart": 1.7, "handsome": 2.2, "funny": 1.9, "good": 1.9, "great": 3.1, "bad": -2.5, "horrible": -2.5, "sux": -1.5, "uncompelling": -0.9}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("VADER is smart, handsome, and funny.", (0.0, 0.254, 0.746, 0.8316)),
        ("VADER is smart, handsome, and funny!", (0.0, 0.248, 0.752, 0.8439)),
        ("VADER is very smart, handsome, and funny.", (0.0, 0.299, 0.701, 0.8545)),
        ("VADER is VERY SMART, handsome, and FUNNY.", (0.0, 0.246, 0.754, 0.9227)),
        ("VADER is VERY SMART, handsome, and FUNNY!!!", (0.0, 0.233, 0.767, 0.9342)),
        ("VADER is VERY SMART, uber handsome, and FRIGGIN FUNNY!!!", (0.0, 0.294, 0.706, 0.9469)),
        ("VADER is not smart, handsome, nor funny.", (0.646, 0.354, 0.0, -0.7424)),
        ("The book was good.", (0.0, 0.508, 0.492, 0.4404)),
        ("At least it isn't a horrible book.", (0.0, 0.637, 0.363, 0.431)),
        ("The book was only kind of good.", (0.0, 0.697, 0.303, 0.3832)),
        ("The plot was good, but the characters are uncompelling and the dialog is not great.", (0.327, 0.579, 0.094, -0.7042)),
        ("Today SUX!", (0.779, 0.221, 0.0, -0.5461)),
        ("Not bad at all", (0.0, 0.513, 0.487, 0.431)),
        ("", (0.0, 0.0, 0.0, 0.0)),
        (None, (0.0, 0.0, 0.0, 0.0)),
    ],
)
def test_published_examples(text, want):
    assert lexicon.polarity(text, VALENCES) == want


def test_rules_of_polarity():
    p = lambda t: lexicon.polarity(t, VALENCES | {":)": 2.0, "shit": -2.6})[3]
    assert p("that was the shit my friend") != p("that was shit my friend") and p("food is the shit") > 0
    assert p("least good day") < 0 < p("at least good day") and p("never so good") > p("good") > p("never good")
    assert p("good ??") > p("good ?") == p("good") and p("fine :) day") > 0 and p("good!!!!!") == p("good!!!!")


def test_factors_read_their_rows_once(spark):
    """The rounds equal those on the whole matrix, and none of them makes the rows anew."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(6)
    v = rng.integers(0, 3, (60, 9)).astype(float) * (rng.random((60, 9)) < 0.4)
    v[5] = 0
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def seen(values):
        made.add(1)
        return values

    rows = [([int(j) for j in np.flatnonzero(r)], [float(x) for x in r[r > 0]]) for r in v]
    counts = spark.createDataFrame(rows, "at array<int>, values array<double>").select("at", seen.asNondeterministic()("values").alias("values"))
    got = models.nmf(counts, 9, 2, iterations=6)
    assert made.value == len(rows)
    plain = np.random.default_rng(7).random((2, 9)) + 0.1
    for _ in range(6):
        loads = models._loads(v, plain, 20)
        plain = plain * (loads.T @ v) / (loads.T @ loads @ plain + 1e-9)
    assert np.allclose(got, plain, rtol=1e-3, atol=1e-6)
