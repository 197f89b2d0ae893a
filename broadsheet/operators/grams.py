"""The most frequent one- to three-grams, exactly, without shuffling every gram.

A gram is not more frequent than the grams inside it. The n-th frequency among shorter grams is a floor for the n-th among all,
so the next pass counts only grams whose parts reach it. Ties with the floor are kept. Tokens must not hold white space.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.scratch import Scratch, maybe_broadcast

#: The columns of a gram; those beyond its last word are null.
WORDS = ["a", "b", "c"]


def windows(docs: DataFrame, keys: list[str], tokens: Column, size: int = len(WORDS)) -> DataFrame:
    """(keys, a, b, c): every token with those that follow it, ``size`` in all; null beyond the last token."""
    t = docs.select(*keys, tokens.alias("a"))
    if size == 1:
        return t.select(*keys, F.explode("a").alias("a"))
    after = [F.slice("a", k + 1, F.size("a")).alias(w) for k, w in enumerate(WORDS[1:size], 1)]
    return t.select(*keys, "a", *after).select(*keys, F.explode(F.arrays_zip(*WORDS[:size])).alias("w")).select(*keys, *[f"w.{w}" for w in WORDS[:size]])


def _counted(docs: DataFrame, tokens: Column, size: int, shorter: DataFrame | None) -> DataFrame:
    """(a, b, c, freq) of the grams of ``size`` words; of those with both parts among ``shorter``, if given."""
    own = WORDS[:size]
    rows = windows(docs, [], tokens, size).where(F.col(own[-1]).isNotNull())
    if shorter is not None:
        n = shorter.count()
        for part in (own[:-1], own[1:]):
            side = shorter.select(*[F.col(x).alias(y) for x, y in zip(own[:-1], part)])
            rows = rows.join(maybe_broadcast(side, n), part, "left_semi")
    counted = rows.groupBy(own).agg(F.count("*").alias("freq"))
    return counted.select(*[F.col(w) if w in own else F.lit(None).cast("string").alias(w) for w in WORDS], "freq")


def _nth(grams: DataFrame, n: int) -> int:
    """The n-th frequency; 0 if there are fewer grams."""
    found = grams.select("freq").orderBy(F.desc("freq")).limit(n).agg(F.count("*").alias("rows"), F.min("freq").alias("least")).first()
    return found.least if found.rows == n else 0


def _size() -> Column:
    return sum((F.col(w).isNotNull().cast("int") for w in WORDS[1:]), F.lit(1))


def marked(docs: DataFrame, keys: list[str], tokens: Column, grams: DataFrame, mark: str) -> DataFrame:
    """(keys, marks): at every token, the ``mark`` of the one-, two- and three-gram that begin there, null for those not in
    ``grams`` (a, b, c, mark), which are distinct."""
    of = {r.size: r["count"] for r in grams.groupBy(_size().alias("size")).count().collect()}
    rows = windows(docs, keys, tokens, max(of, default=1))
    for size, n in sorted(of.items()):
        side = grams.where(_size() == size).select(*WORDS[:size], F.col(mark).alias(f"_{size}"))
        rows = rows.join(maybe_broadcast(side, n), WORDS[:size], "left")
    return rows.select(*keys, F.array(*[F.col(f"_{size}") for size in sorted(of)]).alias("marks"))


def hits(docs: DataFrame, keys: list[str], tokens: Column, grams: DataFrame) -> DataFrame:
    """(keys, score): how many grams of a document, all occurrences, are among ``grams``; documents without any are left out."""
    found = marked(docs, keys, tokens, grams.withColumn("one", F.lit(1)), "one")
    n = F.size(F.array_compact("marks"))
    return found.where(n > 0).groupBy(*keys).agg(F.sum(n).alias("score"))


def _with_df(docs: DataFrame, id_col: str, tokens: Column, grams: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The grams with df, the number of ids whose documents hold them; a null id is none."""
    numbered = scratch.keep(grams.withColumn("k", F.monotonically_increasing_id()), name)
    marks = marked(docs.where(F.col(id_col).isNotNull()), [id_col], tokens, numbered, "k")
    held = marks.select(id_col, F.explode(F.array_compact("marks")).alias("k")).distinct()
    return numbered.join(held.groupBy("k").agg(F.count("*").alias("df")), "k").drop("k")


def top_grams(docs: DataFrame, tokens: Column, n: int, id_col: str | None = None, least_docs: int = 0, most_docs: float | None = None) -> DataFrame:
    """(a, b, c, term, freq) of the n most frequent grams, equal ones by term; with an id, only grams that ``least_docs`` to
    ``most_docs`` ids hold, and (df).

    With bounds the floor comes from the words within them among the 2n most frequent ones. Are there fewer than n, all grams
    that can reach ``least_docs`` are counted.
    """
    scratch = Scratch(docs.sparkSession, "grams")
    bounded = (F.col("df") >= least_docs) & (F.col("df") <= (F.lit(most_docs) if most_docs is not None else F.col("df"))) if id_col else None
    floor, levels = max(1, least_docs), []
    for size in range(1, len(WORDS) + 1):
        shorter = levels[-1].where(F.col("freq") >= floor) if levels else None
        levels.append(scratch.keep(_counted(docs, tokens, size, shorter).where(F.col("freq") >= floor), f"of-{size}"))
        if bounded is None:
            floor = max(floor, _nth(reduce(DataFrame.unionAll, levels), n))
        elif size == 1:
            usual = levels[0].orderBy(F.desc("freq")).limit(2 * n)
            floor = max(floor, _nth(_with_df(docs, id_col, tokens, usual, scratch, "usual").where(bounded), n))
    found = reduce(DataFrame.unionAll, levels).where(F.col("freq") >= floor)
    if bounded is not None:
        found = _with_df(docs, id_col, tokens, found, scratch, "found").where(bounded)
    return found.withColumn("term", F.concat_ws(" ", *WORDS)).orderBy(F.desc("freq"), "term").limit(n)
