"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions.

1. Shallow boosted trees are fitted to statistics of labelled texts; every path from a root to a node is a conjunctive
   rule (share of symbols > 0.1 and share of repeated words <= 0.3).
2. A logistic regression with an L1 penalty over the rules' indicators (proximal gradient with momentum) leaves few of
   them. The penalty is the largest of a path whose loss on a fifth of the rows is within one per cent of the best.
3. The rules left become one SQL expression over the columns of ``text_stats``, evaluated in the scan's own stage.

At most ``FIT_ROWS`` labelled rows are learned from: those with the least hash of their id. Scoring covers every row.

Cases: a null or empty text has all statistics 0 and is scored like any other. Without labelled rows, or with one class
only, every score is the smoothed share of label 1 (0.5 without rows). A document with several labels counts with the
least. Null labels and null ids are not learned from. Only the id and text are read for a score.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import text_stats

FIT_ROWS = 8_000
TREES = 40
DEPTH = 3
LEAST_ROWS = 15
BINS = 32
PATH = 12
#: Statistic -> SQL over the columns of text_stats.
FEATURES = {
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "upper": "n_upper / greatest(n_letters, 1)",
    "digits": "n_digits / greatest(word_chars, 1)",
    "punctuation": "n_punct / greatest(word_chars, 1)",
    "bars": "n_bars / greatest(n_words, 1)",
    "bangs": "n_bangs / greatest(n_words, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "distinct": "n_distinct_words / greatest(n_words, 1)",
    "word_length": "word_chars / greatest(n_words, 1)",
    "short_words": "n_stops / greatest(n_words, 1)",
    "long_words": "n_long_words / greatest(n_words, 1)",
    "line_ends": "n_end_lines / greatest(n_lines, 1)",
    "words": "ln(1 + n_words)",
}
_NAMES = list(FEATURES)


@dataclass(frozen=True)
class Rule:
    """Conjunction of (statistic, above, threshold)."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, cut in self.terms:
            v = x[:, _NAMES.index(name)]
            out &= (v > cut) if above else (v <= cut)
        return out

    def sql(self) -> str:
        return " and ".join(f"f_{name} {'>' if above else '<='} {cut!r}D" for name, above, cut in self.terms)


@dataclass
class Ensemble:
    bias: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def column(self) -> Column:
        """The score over columns ``f_<statistic>``."""
        margin = " + ".join([f"{self.bias!r}D", *(f"(case when {r.sql()} then {w!r}D else 0D end)" for r, w in self.rules)])
        return F.expr(f"1D / (1D + exp(-({margin})))")

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = self.bias + sum((w * r.holds(x) for r, w in self.rules), np.zeros(len(x)))
        return 1 / (1 + np.exp(-margin))


def _grow(x: np.ndarray, bins: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, terms: tuple, depth: int, found: dict, value: np.ndarray, rate: float) -> None:
    """One regression tree on gradients; notes the rule of every node and adds the leaf values."""
    if terms:
        found.setdefault(Rule(terms), None)
    gain, best = 1e-6, None
    total_g, total_h = g[rows].sum(), h[rows].sum()
    if depth and len(rows) >= 2 * LEAST_ROWS:
        base = total_g**2 / (total_h + 1)
        for j, c in enumerate(cuts):
            if not len(c):
                continue
            k = len(c) + 1
            b = bins[rows, j]
            left_g, left_h = np.cumsum(np.bincount(b, g[rows], k))[:-1], np.cumsum(np.bincount(b, h[rows], k))[:-1]
            left_n = np.cumsum(np.bincount(b, minlength=k))[:-1]
            score = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - base
            score[(left_n < LEAST_ROWS) | (len(rows) - left_n < LEAST_ROWS)] = 0
            if score.max() > gain:
                gain, best = score.max(), (j, int(score.argmax()))
    if best is None:
        value[rows] += rate * total_g / (total_h + 1)
        return
    j, k = best
    low = bins[rows, j] <= k
    for part, above in ((rows[low], False), (rows[~low], True)):
        _grow(x, bins, cuts, g, h, part, (*terms, (_NAMES[j], above, float(cuts[j][k]))), depth - 1, found, value, rate)


def _lasso(z: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray, steps: int = 300) -> np.ndarray:
    """Weights (bias first, unpenalised) of the L1-penalised logistic loss, by accelerated proximal gradient."""
    n = len(y)
    a = np.concatenate([np.ones((n, 1)), z], 1)
    size = 4.0 / max(np.linalg.eigvalsh(a.T @ a / n)[-1], 1e-9)
    w, v, t = start.copy(), start.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ v, -30, 30)))
        step = v - size * (a.T @ (p - y) / n)
        new = np.sign(step) * np.maximum(np.abs(step) - size * penalty, 0)
        new[0] = step[0]
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        if np.abs(new - w).max() < 1e-6:
            return new
        w, t = new, t_new
    return w


def train(x: np.ndarray, y: np.ndarray) -> Ensemble:
    """Fits an ensemble to statistics (columns in the order of FEATURES) and labels 0 or 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    if len(y) < 4 * LEAST_ROWS or y.min() == y.max():
        return Ensemble(float(np.log(share / (1 - share))))
    cuts = []
    for j in range(x.shape[1]):
        q = np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]))
        # Between two values that occur, so that a threshold separates them in any arithmetic.
        u = np.unique(x[:, j])
        at = np.searchsorted(u, q)
        cuts.append(np.unique((u[at[at + 1 < len(u)]] + u[at[at + 1 < len(u)] + 1]) / 2))
    bins = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    margin = np.full(len(y), np.log(share / (1 - share)))
    found: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        _grow(x, bins, cuts, y - p, p * (1 - p), np.arange(len(y)), (), DEPTH, found, margin, 0.3)
    rules, z, seen = [], [], set()
    for r in found:
        v = r.holds(x)
        if 0 < v.sum() < len(v) and v.tobytes() not in seen:
            seen.add(v.tobytes())
            rules.append(r), z.append(v)
    if not rules:
        return Ensemble(float(np.log(share / (1 - share))))
    z = np.stack(z, 1).astype(float)
    check = np.arange(len(y)) % 5 == 4
    top = np.abs(z[~check].T @ (y[~check] - y[~check].mean())).max() / (~check).sum()
    w, losses = np.zeros(z.shape[1] + 1), []
    penalties = top * 10 ** np.linspace(0, -2.5, PATH)
    for penalty in penalties:
        w = _lasso(z[~check], y[~check], penalty, w)
        m = np.clip(w[0] + z[check] @ w[1:], -30, 30)
        losses.append(np.mean(np.log1p(np.exp(m)) - y[check] * m))
    chosen = penalties[next(i for i, loss in enumerate(losses) if loss <= 1.01 * min(losses))]
    w = _lasso(z, y, chosen, w, 600)
    return Ensemble(float(w[0]), [(r, float(v)) for r, v in zip(rules, w[1:]) if abs(v) > 1e-4])


def _features(docs: DataFrame, id_col: str, text_col: str, more: tuple[str, ...] = ()) -> DataFrame:
    stats = text_stats.with_stats(docs, [id_col, *more], text_col)
    return stats.withColumns({f"f_{n}": F.expr(e).cast("double") for n, e in FEATURES.items()})


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fit_rows: int = FIT_ROWS) -> Ensemble:
    """Learns from the labelled rows given, at most ``fit_rows`` of them."""
    marked = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("m_id")).agg(F.min(label_col).cast("int").alias("m_label"))
    chosen = marked.orderBy(F.xxhash64("m_id"), "m_id").limit(fit_rows)
    texts = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("d_text")).join(F.broadcast(chosen), F.col("d_id") == F.col("m_id"))
    got = _features(texts, "d_id", "d_text", ("m_label",)).select("d_id", "m_label", *[f"f_{n}" for n in _NAMES]).toPandas().sort_values("d_id", kind="stable")
    rng = np.random.default_rng(7).permutation(len(got))
    x = got[[f"f_{n}" for n in _NAMES]].to_numpy(float)[rng]
    return train(x, got["m_label"].to_numpy(float)[rng])


def score(docs: DataFrame, ensemble: Ensemble, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    return _features(source, "id", "body").select("id", ensemble.column().alias("score"))
