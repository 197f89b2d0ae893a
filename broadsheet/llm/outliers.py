"""Quality rules: base rules, then robust multivariate outliers per language and source.

Every text gets a vector of transformed statistics (square roots of shares, a logarithm). Per group, a minimum-covariance-
determinant estimate is found by concentration steps over all of its documents. There are three starts: medians with MADs,
and the same with the correlations of hyperbolic tangents or of spatial signs, which outliers cannot bend much. A step keeps
the ``H`` share of documents with the least distances and re-estimates mean and covariance from their sums. After two steps
the start with the least determinant goes on alone until no group's determinant falls any more. A document is rejected if
its Mahalanobis distance is beyond the cut.

The covariance of the inner part is made consistent for the normal distribution by the factor of its share, and by the ratio
of the median distance to its expectation where that is larger. The cut is the ``1 - TAIL`` quantile of the F distribution
that distances from such an estimate follow; its degrees of freedom come from the size of the group.

A share over few words varies by chance, so a vector is drawn towards the group's median by n / (n + PRIOR_WORDS). A
variance below a statistic's least deviation squared (FLOORS) is raised to it: a rare but harmless feature does not make an
outlier in a group that has none of it. A group with fewer than MIN_GROUP documents, six for each of the 35 parameters of an
estimate, uses the estimate of its language, and that of all documents if the language has too few. These two are made from
all passing documents of the language or of the table, also from those that are judged by an estimate of their own.

All estimates are sums and mergeable quantiles, combined before the shuffle: no group's rows meet in one task.

Cases: a null or empty text has no words and fails the base rules. Null languages and sources are groups of their own.
Groups of equal rows have zero covariance, which the floors make regular. Ties at the cut are kept. An empty table gives
an empty result. Rows that repeat an id each get their own answer. Extra columns are not read, so they may have any name.
Memory is bounded by the longest text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import text_stats
from broadsheet.llm.shared import Scratch, maybe_broadcast

#: Statistic -> (SQL expression, least standard deviation).
FEATURES = {
    "symbols": ("sqrt(n_symbols / greatest(word_chars, 1))", 0.06),
    "upper": ("sqrt(n_upper / greatest(n_letters, 1))", 0.06),
    "digits": ("sqrt(n_digits / greatest(word_chars, 1))", 0.06),
    "punct": ("sqrt(n_punct / greatest(word_chars, 1))", 0.05),
    "dup_lines": ("sqrt(n_dup_lines / greatest(n_lines, 1))", 0.10),
    "repeats": ("sqrt(n_repeat_words / greatest(n_words, 1))", 0.10),
    "word_length": ("ln(greatest(word_chars, 1) / greatest(n_words, 1))", 0.15),
}
H = 0.75
MOST_STEPS = 40
#: Change of a log determinant below which a group has settled (quantiles are exact to a thousandth only).
SETTLED = 0.02
MIN_GROUP = 200
PRIOR_WORDS = 50
#: Share of normal documents that the cut would reject.
TAIL = 1e-4
_D = len(FEATURES)
_X = [f"x{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def _gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    term = total = 1.0 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= x / n
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a)) if x > 0 else 0.0


def chi2_cdf(x: float, d: float) -> float:
    return _gamma_share(d / 2, x / 2)


def _beta_share(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(1 - x, b, a)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + k * d)
            c = 1 + k / c
            h *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return h * math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a


def f_cdf(x: float, d1: float, d2: float) -> float:
    return _beta_share(d1 * x / (d1 * x + d2), d1 / 2, d2 / 2)


def _quantile(cdf, p: float) -> float:
    low, high = 0.0, 1.0
    while cdf(high) < p:
        low, high = high, high * 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if cdf(middle) < p else (low, middle)
    return (low + high) / 2


@lru_cache(maxsize=4096)
def consistency(share: float, d: int = _D) -> float:
    """What the covariance of the inner share of a normal sample is multiplied with."""
    q = _quantile(lambda x: chi2_cdf(x, d), share)
    return share / chi2_cdf(q, d + 2)


@lru_cache(maxsize=4096)
def cut(n: int, share: float = H, d: int = _D, tail: float = TAIL) -> float:
    """Squared distance that a normal document exceeds with probability ``tail`` in a group of n.

    The F approximation of Hardin and Rocke (2005): the estimate is treated as a Wishart matrix whose degrees of freedom
    follow from the variance of its entries.
    """
    q, c, a = _quantile(lambda x: chi2_cdf(x, d), share), consistency(share, d), 1 - share
    c2, c3 = -chi2_cdf(q, d + 2) / 2, -chi2_cdf(q, d + 4) / 2
    b1 = c * (c3 - 3 * c3) / share
    b2 = 0.5 + c / share * (c3 - q / d * (c2 + share / 2))
    v1 = share * b1**2 * (a * (c * q / d - 1) ** 2 - 1) - 2 * c3 * c**2 * (3 * (b1 - d * b2) ** 2 + (d + 2) * b2 * (2 * b1 - d * b2))
    v2 = n * (b1 * (b1 - d * b2) * share) ** 2 * c**2
    m = max(2 * v2 / (c**2 * v1) * math.exp(0.725 - 0.00663 * d - 0.0780 * math.log(n)), d + 1)
    return d * m / (m - d + 1) * _quantile(lambda x: f_cdf(x, d, m - d + 1), 1 - tail)


def _rounded(n: float) -> int:
    """Two leading digits: group sizes that differ less have the same cut."""
    step = 10 ** max(0, int(math.log10(max(n, 1))) - 1)
    return int(n // step * step)


def _regular(c: np.ndarray) -> np.ndarray:
    """A covariance whose variances are raised to the least ones (before the consistency factor)."""
    least = np.array([f for _, f in FEATURES.values()]) ** 2 / consistency(H)
    return c + np.diag(np.maximum(least - np.diag(c), 0) + 1e-6 * least)


def _matrix(row: pd.Series, name: str) -> np.ndarray:
    c = np.empty((_D, _D))
    for i, j in _PAIRS:
        c[i, j] = c[j, i] = row[f"{name}{i}_{j}"]
    return c


def _models(rows: list[tuple[str, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
    """(g, start, mean, inverse covariance, log determinant) from means and covariances."""
    out = {c: [] for c in _COLUMNS}
    for g, start, mean, c in rows:
        inverse = np.linalg.inv(c)
        out["g"].append(g), out["start"].append(start), out["logdet"].append(np.linalg.slogdet(c)[1])
        for i in range(_D):
            out[f"m{i}"].append(mean[i])
        for i, j in _PAIRS:
            out[f"p{i}_{j}"].append(inverse[i, j])
    return pd.DataFrame(out, columns=_COLUMNS)


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The three starts of each group from medians, MADs and sums over tangents and signs."""
    for f in frames:
        rows = []
        for _, r in f.iterrows():
            centre, spread = np.array([r[f"c{i}"] for i in range(_D)]), np.array([1.4826 * r[f"a{i}"] for i in range(_D)])
            tangents, signs = _matrix(r, "t") / r["n"], _matrix(r, "u") / r["n"]
            scale = np.sqrt(np.maximum(np.diag(tangents), 1e-12))
            for start, shape in enumerate((np.eye(_D), tangents / np.outer(scale, scale), signs * _D)):
                rows.append((r["g"], start, centre, _regular(shape * np.outer(spread, spread))))
        yield _models(rows)


def _invert(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse covariance of each group and start from its sums."""
    for f in frames:
        rows = []
        for _, r in f.iterrows():
            mean = np.array([r[x] for x in _X]) / r["n"]
            rows.append((r["g"], r["start"], mean, _regular(_matrix(r, "s") / r["n"] - np.outer(mean, mean))))
        yield _models(rows)


def _cuts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The greatest distance, under the unscaled inner estimate, that is kept in each group."""
    for f in frames:
        middle = _quantile(lambda x: chi2_cdf(x, _D), 0.5)
        factor = [max(consistency(H), m / middle) for m in f["median"]]
        yield pd.DataFrame({"g": f["g"], "factor": factor, "most": [cut(_rounded(n)) for n in f["n"]]})


_DISTANCE = " + ".join(f"{1 if i == j else 2} * p{i}_{j} * (x{i} - m{i}) * (x{j} - m{j})" for i, j in _PAIRS)
_COLUMNS = ["g", "start", "logdet", *[f"m{i}" for i in range(_D)], *[f"p{i}_{j}" for i, j in _PAIRS]]
_MODEL = "g string, start int, " + ", ".join(f"{c} double" for c in _COLUMNS[2:])


def estimate(points: DataFrame, n_groups: int, scratch: Scratch) -> DataFrame:
    """The MCD estimate (_MODEL, one start each) of every group of ``points`` (g, x0 … and medians c0 …)."""
    z = {f"z{i}": F.expr(f"(x{i} - c{i}) / greatest(1.4826 * a{i}, {floor}D)") for i, (_, floor) in enumerate(FEATURES.values())}
    spread = points.groupBy("g").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"c{i}")), 0.5, 1000).alias(f"a{i}") for i, x in enumerate(_X)])
    spread = scratch.keep(spread, "spread")
    scaled = points.join(maybe_broadcast(spread, n_groups), "g").withColumns(z).withColumn("long", F.expr("greatest(sqrt(" + " + ".join(f"z{i} * z{i}" for i in range(_D)) + "), 1e-9D)"))
    sums = [F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in _PAIRS] + [F.sum(F.expr(f"z{i} * z{j} / (long * long)")).alias(f"u{i}_{j}") for i, j in _PAIRS]
    begun = scaled.groupBy("g").agg(F.count("*").cast("double").alias("n"), *[F.first(f"c{i}").alias(f"c{i}") for i in range(_D)], *[F.first(f"a{i}").alias(f"a{i}") for i in range(_D)], *sums)
    model = scratch.keep(begun.mapInPandas(_starts, _MODEL), "model-0")
    points = points.select("g", *_X)
    for step in range(1, MOST_STEPS + 1):
        scored = points.join(maybe_broadcast(model, 3 * n_groups), "g").withColumn("d", F.expr(_DISTANCE))
        inner = maybe_broadcast(scored.groupBy("g", "start").agg(F.percentile_approx("d", H, 1000).alias("h")), 3 * n_groups)
        chosen = scored.join(inner, ["g", "start"]).where("d <= h")
        sums = chosen.groupBy("g", "start").agg(F.count("*").cast("double").alias("n"), *[F.sum(x).alias(x) for x in _X], *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in _PAIRS])
        made = sums.mapInPandas(_invert, _MODEL)
        if step == 2:
            made = made.groupBy("g").agg(F.min_by(F.struct(*_COLUMNS[1:]), F.struct("logdet", "start")).alias("m")).select("g", "m.*")
        made = scratch.keep(made, f"model-{step}")
        falls = made.join(model.select("g", "start", F.col("logdet").alias("was")), ["g", "start"]).where(F.col("was") - F.col("logdet") > SETTLED) if step > 2 else made
        settled = step > 2 and falls.limit(1).count() == 0
        scratch.drop(f"model-{step - 1}")
        model = made
        if settled:
            break
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept) of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "outliers")
    source = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("body"))
    stats = text_stats.with_stats(source, ["id", "lang", "source"], "body").withColumn("base_failed", F.expr(BASE_FAILED))
    stats = stats.withColumns({x: F.expr(e) for x, (e, _) in zip(_X, FEATURES.values())})
    stats = scratch.keep(stats.select("id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *_X), "stats")

    # A group's name is its language and source, or its language, or nothing, whichever has enough documents.
    passed = stats.where("not base_failed")
    sizes = scratch.keep(passed.groupBy("lang", "source").count(), "sizes")
    by_lang = sizes.groupBy(F.col("lang").alias("of")).agg(F.sum("count").alias("of_lang"))
    group = F.when(F.col("count") >= MIN_GROUP, F.to_json(F.array("lang", "source"))).when(F.col("of_lang") >= MIN_GROUP, F.to_json(F.array("lang"))).otherwise("[]")
    names = sizes.join(by_lang, F.col("lang").eqNullSafe(F.col("of"))).select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), group.alias("g"))
    names = scratch.keep(names, "names")
    n_groups = names.count()
    names = maybe_broadcast(names, n_groups)
    same = F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source"))
    # A document counts towards each estimate in use that covers it: of its language and source, its language, the table.
    used = maybe_broadcast(names.select("g").distinct(), n_groups)
    levels = names.select("g_lang", "g_source", F.explode(F.array(F.to_json(F.array("g_lang", "g_source")), F.to_json(F.array("g_lang")), F.lit("[]"))).alias("g"))
    levels = scratch.keep(levels.join(used, "g", "left_semi").select("g_lang", "g_source", "g"), "levels")
    grouped = passed.join(maybe_broadcast(levels, 3 * n_groups), same).drop("g_lang", "g_source")
    medians = grouped.groupBy("g").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"c{i}") for i, x in enumerate(_X)])
    medians = scratch.keep(medians, "medians")
    drawn = {x: F.expr(f"c{i} + ({x} - c{i}) * (n_words / (n_words + {PRIOR_WORDS}.0D))") for i, x in enumerate(_X)}
    points = scratch.keep(grouped.join(maybe_broadcast(medians, n_groups), "g").withColumns(drawn).select("id", "g", *_X, *[f"c{i}" for i in range(_D)]), "points")

    model = estimate(points, n_groups, scratch).drop("start", "logdet")
    # Consistency and cut of each group from its size and its median distance.
    seen = points.join(maybe_broadcast(model, n_groups), "g").groupBy("g").agg(F.count("*").cast("double").alias("n"), F.percentile_approx(F.expr(_DISTANCE), 0.5, 1000).alias("median"))
    cuts = scratch.keep(seen.mapInPandas(_cuts, "g string, factor double, most double"), "cuts")
    model = model.join(maybe_broadcast(cuts, n_groups), "g")
    # The id need not be unique, so the verdict is taken in one pass over the statistics.
    final = stats.join(names, same, "left").drop("g_lang", "g_source")
    final = final.join(maybe_broadcast(medians, n_groups), "g", "left").withColumns(drawn).join(maybe_broadcast(model, n_groups), "g", "left").withColumn("distance", F.expr(f"({_DISTANCE}) / factor"))
    out = final.withColumn("kept", F.expr("not base_failed and coalesce(distance <= most, true)"))
    return out.select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
