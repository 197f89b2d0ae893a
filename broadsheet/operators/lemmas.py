"""Dictionary forms of words: endings are detached, and a form counts if the caller's index of lemmas holds it.

The index (``lemma``) and the exceptions (``form``, ``lemma``) are tables of any size. Forms are sought once for each
distinct token, by joins; sequences of tokens get theirs back by position.

Of an exception, its lemmas and the token itself are tried; of another token, the token and what is left when one ending is
detached. The shortest that the index holds wins, the first in order of the alphabet among equals. If there is none, endings
are detached again from what was left, up to ``ROUNDS`` times. A token without any form in the index stays as it is.

Cases: null tokens stay null, an empty list stays empty, a null list stays null. Tokens are taken as they are: upper case
is another token. Rows of the index or of the exceptions that repeat count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.scratch import Scratch

#: Endings of nouns and what takes their place (fixed values, published with the dictionary that made them usual).
NOUN_ENDINGS = (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y"))
ROUNDS = 3


def detached(form: str, endings: tuple[tuple[str, str], ...] = NOUN_ENDINGS):
    """What is left of a column when each ending that it has is detached, as an array."""
    c = F.col(form)
    tried = [F.when(c.endswith(old), F.concat(F.expr(f"left(`{form}`, char_length(`{form}`) - {len(old)})"), F.lit(new))) for old, new in endings]
    return F.array_distinct(F.array_compact(F.array(*tried)))


def lemma_table(tokens: DataFrame, index: DataFrame, exceptions: DataFrame | None = None, endings: tuple[tuple[str, str], ...] = NOUN_ENDINGS) -> DataFrame:
    """(token, lemma) of every distinct token of ``tokens`` (token)."""
    scratch = Scratch(tokens.sparkSession, "lemmas")
    known = scratch.keep(index.select("lemma").where("lemma is not null").distinct(), "index")
    words = scratch.keep(tokens.select("token").where("token is not null").distinct(), "words")
    shortest = F.min(F.struct(F.length("form").alias("n"), F.col("form").alias("lemma"))).alias("best")
    tried = words.select("token", F.col("token").alias("form"), F.lit(False).alias("excepted"))
    if exceptions is not None:
        named = exceptions.select(F.col("form").alias("token"), F.col("lemma").alias("form")).where("token is not null and form is not null").distinct()
        own = words.join(named, "token")
        tried = tried.join(own.select("token").distinct().withColumn("own", F.lit(True)), "token", "left").select("token", "form", F.coalesce("own", F.lit(False)).alias("excepted"))
        tried = tried.unionByName(own.withColumn("excepted", F.lit(True)))
    left, found = tried, None
    for n in range(ROUNDS):
        more = left.where("not excepted").select("token", F.explode(detached("form", endings)).alias("form"), "excepted")
        # In the first round the token itself counts, and what exceptions say; later only what was detached.
        left = scratch.keep((left.unionByName(more) if n == 0 else more).distinct(), f"tried-{n}")
        hit = scratch.keep(left.join(known, left.form == known.lemma, "left_semi").groupBy("token").agg(shortest).select("token", "best.lemma"), f"found-{n}")
        found = hit if found is None else found.unionByName(hit)
        left = left.join(hit, "token", "left_anti")
        if n + 1 < ROUNDS and not left.where("not excepted").limit(1).count():
            break
    return words.join(found, "token", "left").select("token", F.coalesce("lemma", "token").alias("lemma"))


def lemmatized(docs: DataFrame, id_col: str, tokens_col: str, lemmas: DataFrame) -> DataFrame:
    """(id, tokens) with each token's lemma in its place; ids should be distinct."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens"))
    placed = rows.select("id", F.posexplode("tokens").alias("at", "token")).join(lemmas, "token", "left")
    back = placed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("lemma", "token").alias("lemma")))).alias("m"))
    out = rows.join(back, "id", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.size("tokens") == 0, F.col("tokens")).otherwise(F.col("m.lemma")).alias(tokens_col))
