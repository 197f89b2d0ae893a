"""Filter interaction audit by Walsh-Hadamard sums.

A document fails some of k filters; the set of those is its mask, one of 2**k cells. Every order of the filters, and every
filter's Shapley share, is a sum over cells, so one pass that fills the cells serves all k! orders:

1. Masks. Conditions on the text are Spark expressions; "identical to an earlier document" compares each document's id with
   the least id of its digest. Ids, part, mask and digest are written once; texts are read once and never shuffled.
2. Signed parity sums. For each subset S of the filters: the sum of (-1)**|S & mask|, for each part over all documents and
   over those with a label. 2**k numbers a part, summed in the tasks before the shuffle.
3. Inversion. A cell is the signed sum of the parity sums divided by 2**k: whole numbers, exact.
4. Orders. ``kept`` is the sum of the cells outside all filters up to this step, and so on. A document that fails m filters
   is removed by each of them in k! / m of the orders, which gives ``shapley`` in closed form.

Cases: a null text is an empty one, a null part the empty string. A null id is identical to no earlier one, and is no earlier
one. Rows that repeat an id are rows of their own: each is counted, none is earlier than the other. Labels of one id on
several rows: the greatest counts; a null label, or none, is neither good nor toxic. An empty table gives an empty result.
Only the id, the text, the part and the labels are read, whatever else there is.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.shared import Scratch, long_id, maybe_broadcast

#: The letter of the filter that looks for identical texts with a smaller id.
REPEATED = "E"


def failures(text: Column) -> dict[str, Column]:
    """Failure conditions on a text: few words, few distinct words, many capitals, symbols."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    n = F.size(words)
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * n,
        "C": 100 * capitals > 3 * F.length(text).cast("long"),
        "D": text.rlike(r"[#$%&*|]"),
    }


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, mask, good, toxic) of every row; bit i of the mask is the i-th filter of A to E."""
    scratch = Scratch(docs.sparkSession, "masks")
    text = F.coalesce(F.col("body"), F.lit(""))
    conditions = failures(text)
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(conditions.values())), start=F.lit(0))
    source = docs.select(long_id(docs, id_col).alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text_col}`").cast("string").alias("body"))
    rows = scratch.keep(source.select("id", "part", bits.alias("mask"), F.unhex(F.sha2(text, 256)).alias("digest")), "rows")
    # Only digests that several rows have; a table of its own, so that the join may split the rows of a hot one.
    first = scratch.keep(rows.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first"), "first")
    marked = scratch.keep(labels.groupBy(long_id(labels, "doc_id").alias("id")).agg((F.max("quality") == 1).alias("good"), (F.max("toxic") == 1).alias("toxic")), "labels")
    later = F.when(F.col("id") > F.col("first"), F.lit(1 << len(conditions))).otherwise(0)
    joined = rows.join(maybe_broadcast(first, first.count()), "digest", "left").join(maybe_broadcast(marked, marked.count()), "id", "left")
    return joined.select("part", F.col("mask").bitwiseOR(later).alias("mask"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def _sign(a: str, b: str) -> str:
    return f"(1 - 2 * (bit_count({a} & {b}) % 2))"


def parity_sums(masked: DataFrame, k: int) -> DataFrame:
    """(part, w_all, w_good, w_toxic): arrays of the 2**k signed parity sums."""
    sums = [F.sum(F.expr(_sign("mask", str(s)))).alias(f"w{s}") for s in range(1 << k)]
    by_label = masked.groupBy("part", "good", "toxic").agg(*sums)
    gathered = {"all": F.lit(True), "good": F.col("good"), "toxic": F.col("toxic")}
    return by_label.groupBy("part").agg(
        *[F.array(*[F.sum(F.when(c, F.col(f"w{s}")).otherwise(0)) for s in range(1 << k)]).alias(f"w_{name}") for name, c in gathered.items()]
    )


def cells(sums: DataFrame, k: int) -> DataFrame:
    """(part, all, good, toxic): arrays of the 2**k numbers of documents with exactly that mask."""
    n = 1 << k
    inverse = lambda w: F.expr(f"transform(sequence(0, {n - 1}), m -> aggregate(sequence(0, {n - 1}), 0L, (total, s) -> total + {w}[s] * {_sign('s', 'm')}) div {n})")
    return sums.select("part", *[inverse(f"w_{name}").alias(name) for name in ("all", "good", "toxic")])


def orders(filled: DataFrame, letters: str) -> DataFrame:
    """One row for each part, order of ``letters`` and step."""
    k = len(letters)
    every = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = filled.select("*", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(k))).alias("step"))
    bit = "shiftleft(1, instr('{0}', substr(filter_order, {1}, 1)) - 1)"
    steps = steps.withColumn("own", F.expr(bit.format(letters, "step")))
    before = f"aggregate(sequence(1, step), 0, (seen, i) -> seen | {bit.format(letters, 'i')}) & ~own"
    steps = steps.withColumn("before", F.expr(before))
    factorial = 1
    for i in range(2, k + 1):
        factorial *= i

    def total(counts: str, condition: str, weight: str = "1") -> Column:
        return F.expr(f"aggregate(filter(sequence(0, {(1 << k) - 1}), m -> {condition}), 0L, (total, m) -> total + `{counts}`[m] * {weight})")

    removed = "(m & own) <> 0 and (m & before) = 0"
    return steps.select(
        "part",
        "filter_order",
        "step",
        total("all", "(m & (before | own)) = 0").alias("kept"),
        total("all", removed).alias("removed"),
        total("all", "(m & own) <> 0 and (m & before) <> 0").alias("redundant"),
        total("all", "m = own").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        total("all", "(m & own) <> 0", f"({factorial}L div bit_count(m))").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """Counts of every order and step of the filters A to E, for each part; labels (doc_id, quality, toxic)."""
    letters = "ABCD" + REPEATED
    return orders(cells(parity_sums(masks(docs, labels, id_col, text_col, part_col), len(letters)), len(letters)), letters)
