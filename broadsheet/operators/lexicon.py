"""Lexicon sentiment. Lexicons are data (token, valence) supplied by the caller."""

from __future__ import annotations

import math
import re
import string
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.functions import text as tx
from broadsheet.scratch import maybe_broadcast


def per_word(docs: DataFrame, lexicon: DataFrame, id_col: str, text_col: str, tokens: Column, lexicon_rows: int) -> DataFrame:
    """(id, score): summed valence of the tokens over the number of white-space separated words, at least one."""
    low = lexicon.select(F.lower("token").alias("_t"), "valence")
    hits = docs.select(id_col, F.explode(tokens).alias("_t")).join(maybe_broadcast(low, lexicon_rows), "_t").groupBy(id_col).agg(F.sum("valence").alias("_s"))
    n = F.greatest(F.size(tx.words(text_col)), F.lit(1))
    return docs.select(id_col, n.alias("_n")).join(hits, id_col, "left").select(id_col, (F.coalesce("_s", F.lit(0.0)) / F.col("_n")).alias("score"))


# Fixed values of the published rule set (Hutto and Gilbert 2014); the lexicon itself is data of the caller.
UP, CAPITALS, DENIED = 0.293, 0.733, -0.74
NEGATIONS = frozenset(
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't "
    "neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite".split()
)
RAISING = frozenset(
    "absolutely amazingly awfully completely considerably decidedly deeply effing enormously entirely especially exceptionally extremely fabulously flipping flippin fricking frickin frigging friggin fully fucking "
    "greatly hella highly hugely incredibly intensely majorly more most particularly purely quite really remarkably so substantially thoroughly totally tremendously uber unbelievably unusually utterly very".split()
)
LOWERING = frozenset("almost barely hardly kinda kindof kind-of less little marginally occasionally partly scarcely slightly somewhat sorta sortof sort-of".split()) | {"just enough", "kind of", "sort of"}
IDIOMS = {"the shit": 3.0, "the bomb": 3.0, "bad ass": 1.5, "yeah right": -2.0, "cut the mustard": 2.0, "kiss of death": -1.5, "hand to mouth": -2.0}
MARKS = ["!?!?", "?!?!", "?!?", "!?!", "???", "!!!", "??", "!!", ".", "!", "?", ",", ";", ":", "-", "'", '"']
_MARKED = re.compile(f"[{re.escape(string.punctuation)}]")


def _bare(word: str) -> str:
    """A word without the mark before or after it; anything else with marks inside, an emoticon for one, stays whole."""
    for m in MARKS:
        for rest in (word.removeprefix(m) if word.startswith(m) else "", word.removesuffix(m) if word.endswith(m) else ""):
            if len(rest) > 1 and not _MARKED.search(rest):
                return rest
    return word


def _denies(word: str) -> bool:
    return word in NEGATIONS or "n't" in word


class _Sentence:
    """The words of a text with what the rules ask about them."""

    def __init__(self, text: str, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.words = [_bare(w) for w in text.split() if len(w) > 1]
        self.low = [w.lower() for w in self.words]
        upper = sum(w.isupper() for w in self.words)
        self.mixed = 0 < upper < len(self.words)

    def _degree(self, i: int, valence: float) -> float:
        """What a word of degree adds to the valence of a word after it."""
        word = self.low[i]
        step = UP if word in RAISING else -UP if word in LOWERING else 0.0
        if not step:
            return 0.0
        step = math.copysign(step, step if valence > 0 else -step)
        if self.mixed and self.words[i].isupper():
            step += CAPITALS if valence > 0 else -CAPITALS
        return step

    def _denied(self, i: int, back: int, valence: float) -> float:
        low = self.low
        if back > 1 and low[i - back] == "never" and any(w in ("so", "this") for w in low[i - back + 1 : i]):
            return valence * (1.5 if back == 2 else 1.25)
        return valence * DENIED if _denies(low[i - back]) else valence

    def _idiom(self, i: int, valence: float) -> float:
        low = self.low
        around = [low[i - 1 : i + 1], low[i - 2 : i + 1], low[i - 2 : i], low[i - 3 : i], low[i - 3 : i - 1]]
        ahead = [low[i : i + 2], low[i : i + 3]]
        before = next((IDIOMS[p] for p in map(" ".join, around) if p in IDIOMS), None)
        valence = valence if before is None else before
        for p in map(" ".join, ahead):
            valence = IDIOMS.get(p, valence)
        for p in (low[i - 3 : i - 1], low[i - 2 : i]):
            if " ".join(p) in LOWERING:
                valence -= UP
        return valence

    def valence(self, i: int) -> float:
        low, word = self.low, self.low[i]
        if word in RAISING or word in LOWERING or (word == "kind" and low[i + 1 : i + 2] == ["of"]):
            return 0.0
        value = self.lexicon.get(word)
        if value is None:
            return 0.0
        if self.mixed and self.words[i].isupper():
            value += math.copysign(CAPITALS, value)
        for back, weight in ((1, 1.0), (2, 0.95), (3, 0.9)):
            if i >= back and low[i - back] not in self.lexicon:
                value += weight * self._degree(i - back, value)
                value = self._denied(i, back, value)
                if back == 3:
                    value = self._idiom(i, value)
        if i and low[i - 1] == "least" and "least" not in self.lexicon and (i < 2 or low[i - 2] not in ("at", "very")):
            value *= DENIED
        return value


def polarity(text: str | None, lexicon: dict[str, float]) -> tuple[float, float, float, float]:
    """(neg, neu, pos, compound) by the published rule set: words of degree, negation within three words, "never so",
    "least", idioms, capitals, ``but``, exclamation and question marks; emoticons are words of the lexicon.

    Every value is weighed by its own place around ``but``, also where two are equal. A null or empty text scores 0.
    """
    text = text or ""
    sentence = _Sentence(text, lexicon)
    scores = [sentence.valence(i) for i in range(len(sentence.words))]
    if not scores:
        return (0.0, 0.0, 0.0, 0.0)
    if "but" in sentence.low:
        at = sentence.low.index("but")
        scores = [s * (0.5 if i < at else 1.5 if i > at else 1.0) for i, s in enumerate(scores)]
    asked = text.count("?")
    extra = min(text.count("!"), 4) * 0.292 + (0.0 if asked < 2 else asked * 0.18 if asked < 4 else 0.96)
    total = sum(scores)
    total += math.copysign(extra, total) if total else 0.0
    compound = max(-1.0, min(1.0, total / math.sqrt(total * total + 15)))
    pos, neg, neu = sum(s + 1 for s in scores if s > 0), sum(s - 1 for s in scores if s < 0), sum(1 for s in scores if not s)
    if pos > abs(neg):
        pos += extra
    elif pos < abs(neg):
        neg -= extra
    size = pos + abs(neg) + neu
    return (round(abs(neg) / size, 3), round(neu / size, 3), round(pos / size, 3), round(compound, 4))


def vader(lexicon: dict[str, float]):
    """Arrow UDF text -> struct(neg, neu, pos, compound); the lexicon travels with the function."""

    @F.pandas_udf("neg double, neu double, pos double, compound double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([polarity(t, lexicon) for t in texts], columns=["neg", "neu", "pos", "compound"])

    return score


def lacks_any(columns: list[str]) -> Column:
    """Whether one of the columns is null."""
    return F.array_contains(F.array(*[F.col(c).isNull() for c in columns]), True)


def rescore(store: DataFrame, scores: DataFrame, id_col: str, columns: list[str], everything: bool) -> DataFrame:
    """Writes scores back by id: to all rows, or only to rows that lack one of the columns."""
    new = scores.select(id_col, *[F.col(c).alias(f"_{c}") for c in columns])
    lacks = F.lit(True) if everything else lacks_any(columns)
    out = store.join(new, id_col, "left")
    return out.select(*[F.when(lacks, F.coalesce(f"_{c}", c)).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in store.columns])
