"""Parts of speech by an averaged perceptron over sequences of tokens.

Features of a token are its form and endings, those of its neighbours, and the tags given to the two tokens before it, each
hashed to 64 bits. A token gets the tag with the highest sum of feature weights; ties go to the tag that sorts first.

Fitting. The tagged sequences are dealt into ``shards`` by the hash of their tokens. In each round every shard goes once
through its sequences, starting from the weights that all shards agreed on, and raises and lowers weights where it was
wrong; the shards' weights are averaged by an aggregate (parameter mixing), and so is the sum of all weights that a shard
passed through, which is what tags in the end. At most ``MOST_SEQUENCES`` sequences are learned from, chosen by hash, so
that weights stay small enough to travel: a bounded sample, as a classifier may have. Everything else counts all rows.

Tagging runs over Arrow batches, all sequences of a batch at once, position by position; weights lie in sorted arrays.

Cases: a null sequence has null tags, an empty one none; a null token is read as the empty one. Sequences whose numbers of
tokens and tags differ, or with a null tag, are not learned from. A tagger that learned from nothing cannot be made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sequences that are learned from at most.
MOST_SEQUENCES = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: One salt for each feature: of the token and its neighbours, then of the tags before it.
_KINDS = "bias form ending2 ending3 ending1 start shape before before_ending two_before after after_ending two_after".split()
_TAGGED = "tag two_tags tag_form two_tags_form".split()


def _salt(name: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little"))


_SALTS, _TAG_SALTS = np.array([_salt(k) for k in _KINDS]), np.array([_salt(k) for k in _TAGGED])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(29))


def _shape(word: str) -> str:
    return ("A" if word[:1].isupper() else "a") + ("9" if any(c.isdigit() for c in word) else "") + ("-" if "-" in word else "")


class _Strings:
    """Hashes of strings, made once each."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, words: list[str]) -> np.ndarray:
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words):
            h = self.known.get(w)
            if h is None:
                if len(self.known) > 200_000:
                    self.known.clear()
                h = self.known[w] = int(_salt(w))
            out[i] = h
        return out


def fixed_features(tokens: list[str], strings: _Strings) -> np.ndarray:
    """(tokens, kinds): hashes of the features that do not depend on tags."""
    words = [w or "" for w in tokens]
    lower = [w.lower() for w in words]
    form, ending = strings.of(lower), strings.of([w[-3:] for w in lower])
    edge = strings.of(["<", ">"])
    pad = lambda h, k: np.concatenate([np.repeat(edge[:1], max(k, 0)), h, np.repeat(edge[1:], max(-k, 0))])[max(-k, 0) :][: len(h)]
    columns = [np.zeros(len(words), np.uint64), form, strings.of([w[-2:] for w in lower]), ending, strings.of([w[-1:] for w in lower]), strings.of([w[:1] for w in lower]), strings.of([_shape(w) for w in words])]
    columns += [pad(form, 1), pad(ending, 1), pad(form, 2), pad(form, -1), pad(ending, -1), pad(form, -2)]
    return _mixed(np.stack(columns, 1) + _SALTS)


def _tag_features(form: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """(rows, kinds): hashes of the features made of the last tag, the one before it, and the token's form."""
    a, b = _mixed(one.astype(np.uint64) + np.uint64(7)), _mixed(two.astype(np.uint64) + np.uint64(1 << 20))
    return _mixed(np.stack([a, a + _mixed(b), a ^ form, (a + _mixed(b)) ^ form], 1) + _TAG_SALTS)


class Tagger:
    """Weights (features, tags) under sorted feature hashes."""

    def __init__(self, tags: list[str], keys: np.ndarray, weights: np.ndarray):
        order = np.argsort(keys)
        self.tags, self.keys = tags, keys[order]
        # One more row for features without a weight.
        self.weights = np.concatenate([weights[order], np.zeros((1, len(tags)))]).astype(np.float32)

    def rows(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(hashes.shape, np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, len(self.keys))

    def tag(self, sequences: list[list[str] | None]) -> list[list[str] | None]:
        """Tags of many sequences at once."""
        strings, out = _Strings(), [None if s is None else [""] * len(s) for s in sequences]
        live = sorted((i for i, s in enumerate(sequences) if s), key=lambda i: -len(sequences[i]))
        if not live:
            return out
        sizes = np.array([len(sequences[i]) for i in live])
        fixed = [fixed_features(list(sequences[i]), strings) for i in live]
        starts = np.concatenate([[0], np.cumsum(sizes)])
        hashes = np.concatenate(fixed)
        scores = np.zeros((len(hashes), len(self.tags)), np.float32)
        for k in range(hashes.shape[1]):
            scores += self.weights[self.rows(hashes[:, k])]
        form = hashes[:, _KINDS.index("form")]
        found = np.zeros(len(hashes), np.int64)
        n = len(live)
        one = two = np.full(n, len(self.tags))
        for t in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -t, "left"))  # sequences longer than t come first
            at = starts[:n] + t
            own = scores[at] + self.weights[self.rows(_tag_features(form[at], one[:n], two[:n]))].sum(1)
            best = own.argmax(1)
            found[at] = best
            one, two = best, one[:n]
        for k, i in enumerate(live):
            out[i] = [self.tags[x] for x in found[starts[k] : starts[k + 1]]]
        return out


def _learn(batches: Iterator[pa.RecordBatch], tags: list[str], start: Tagger) -> Iterator[pa.RecordBatch]:
    """One round of a shard: (feature, tag, weight, passed) of what it ended with and what it passed through on the way."""
    number, width = {t: k for k, t in enumerate(tags)}, len(tags)
    weight: dict[int, np.ndarray] = {}
    passed: dict[int, np.ndarray] = {}
    since: dict[int, int] = {}
    step, strings = 0, _Strings()

    def get(key: int) -> np.ndarray:
        w = weight.get(key)
        if w is None:
            row = start.rows(np.array([key], np.uint64))[0]
            w = weight[key] = start.weights[row].astype(np.float64)
            passed[key], since[key] = np.zeros(width), 0
        return w

    for batch in batches:
        for tokens, gold in zip(batch.column("tokens").to_pylist(), batch.column("tags").to_pylist()):
            fixed, one, two = fixed_features(tokens, strings), width, width
            for t, want in enumerate(gold):
                form = fixed[t, _KINDS.index("form")]
                keys = [*fixed[t].tolist(), *_tag_features(form[None], np.array([one]), np.array([two]))[0].tolist()]
                guess, right = int(sum(get(k) for k in keys).argmax()), number[want]
                step += 1
                if guess != right:
                    for k in keys:
                        passed[k] += weight[k] * (step - since[k])
                        since[k] = step
                        weight[k][right] += 1
                        weight[k][guess] -= 1
                one, two = guess, one
    rows = []
    for k, w in weight.items():
        mean = (passed[k] + w * (step - since[k] + 1)) / (step + 1)
        rows += [(k, j, float(w[j]), float(mean[j])) for j in np.flatnonzero((w != 0) | (mean != 0)).tolist()]
    columns = list(zip(*rows)) or [(), (), (), ()]
    made = [np.array(columns[0], np.uint64).view(np.int64), np.array(columns[1], np.int32), np.array(columns[2], float), np.array(columns[3], float)]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in made], names=["feature", "tag", "weight", "passed"])


def _as_tagger(tags: list[str], rows: pa.Table, value: str) -> Tagger:
    keys, at = np.unique(rows.column("feature").to_numpy().view(np.uint64), return_inverse=True)
    weights = np.zeros((len(keys), len(tags)))
    weights[at, rows.column("tag").to_numpy()] = rows.column(value).to_numpy()
    return Tagger(tags, keys, weights)


def fit(tagged: DataFrame, tokens_col: str = "tokens", tags_col: str = "tags", rounds: int = 5, shards: int = 4) -> Tagger:
    """Learns from rows of (tokens, tags), arrays of one length."""
    spark = tagged.sparkSession
    rows = tagged.select(F.transform(tokens_col, lambda t: F.coalesce(t, F.lit(""))).alias("tokens"), F.col(tags_col).alias("tags"))
    rows = rows.where((F.size("tokens") == F.size("tags")) & (F.size("tokens") > 0) & ~F.exists("tags", lambda t: t.isNull()))
    hashed = rows.withColumn("h", F.xxhash64("tokens", "tags"))
    n = hashed.count()
    if not n:
        raise ValueError("no tagged sequences")
    # A share of them by hash, such that about MOST_SEQUENCES are left.
    parts = -(-n // MOST_SEQUENCES)
    own = hashed.where(F.pmod(F.col("h"), F.lit(parts)) == 0).repartition(shards, "h").sortWithinPartitions("h").drop("h").persist()
    tags = sorted(r.tag for r in own.select(F.explode("tags").alias("tag")).distinct().collect())
    state, total = Tagger(tags, np.zeros(0, np.uint64), np.zeros((0, len(tags)))), None
    for _ in range(rounds):
        at = spark.sparkContext.broadcast(state)
        learned = own.mapInArrow(lambda it, at=at: _learn(it, tags, at.value), "feature long, tag int, weight double, passed double")
        mixed = learned.groupBy("feature", "tag").agg((F.sum("weight") / shards).alias("weight"), (F.sum("passed") / shards).alias("passed")).toArrow()
        at.destroy()
        state = _as_tagger(tags, mixed, "weight")
        total = mixed.select(["feature", "tag", "passed"]) if total is None else pa.concat_tables([total, mixed.select(["feature", "tag", "passed"])])
    own.unpersist()
    summed = total.group_by(["feature", "tag"]).aggregate([("passed", "sum")])
    return _as_tagger(tags, summed.rename_columns(["feature", "tag", "passed"]), "passed")


def tags_of(tokens: Column | str, tagger: Tagger) -> Column:
    """Tags of an array of tokens."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def tagged(parts: pd.Series) -> pd.Series:
        return pd.Series(tagger.tag([None if t is None else list(t) for t in parts]), dtype=object)

    return tagged(tokens)
