"""Chat formatting by quotation linking: who answers whom, from what the messages quote.

Leading ``>`` marks give each line its quote level (nested marks, with or without spaces). Lines of one level that follow
each other are a passage, cut at blank lines. Own (level 0) and quoted passages and lines are normalised (lower case,
white space to one space, marks removed) and hashed. A quoted passage is joined, within its conversation, to the first
message that holds it as its own text; a message answers the earlier message from which it quotes most characters at its
lowest matched level (ties: the later one). Quotes below ``LEAST_CHARS`` characters are weak evidence: they count only
where no longer quote of the message is matched, and a message that consists of the quote goes before one that holds it
among others. Messages that quote nothing known start a thread.

The result has one row per message without quotes and without the lines that introduce them, and the order in which the
conversation reads: threads by the turn of their first message, and in a thread by turn, so that an answer always follows
what it answers. A conversation may hold a third of all messages: links come from equi-joins on (conversation, hash) with
one row per key on one side, thread heads from pointer jumping, and positions from a range sort with counts per partition,
so no conversation is gathered in one task.

Cases: null text is an empty message. Null conversation ids or turns are kept: such messages have no links, and null sorts
first. Equal (conversation, turn) rows share their links and are ordered by role, then text. Messages can only answer
smaller turns, so there are no cycles. An empty table gives an empty result. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm.shared import Scratch, chunks, long_id, maybe_broadcast, small_batches

#: Passages and lines shorter than this many characters are weak evidence.
LEAST_CHARS = 12
MOST_ROUNDS = 60
_MARKS = re.compile(r"^\s*((?:>\s?)+)")
_INTRODUCTION = re.compile(r"^\s*(?:on\b.{0,200}\bwrote|le\b.{0,200}\ba écrit|am\b.{0,200}\bschrieb.{0,80}|el\b.{0,200}\bescribió|.{1,80}\b(?:wrote|said|writes))\s*:\s*$|^\s*-{2,}\s*(?:original message|forwarded message)\s*-{2,}\s*$", re.I)


def _key(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _normal(text: str) -> str:
    return " ".join(text.lower().split())


def parse(text: str | None) -> tuple[str, list[str], list[tuple[int, str]]]:
    """Own text; own passages and lines; quoted passages and lines with their levels. Normalised but for the own text."""
    rows: list[tuple[int, str]] = []
    for line in (text or "").split("\n"):
        m = _MARKS.match(line)
        rows.append((m.group(1).count(">"), line[m.end() :]) if m else (0, line))
    own_lines: list[str] = []
    own: list[str] = []
    quoted: list[tuple[int, str]] = []

    def close(level: int, part: list[str]) -> None:
        for t in dict.fromkeys([_normal(" ".join(part)), *map(_normal, part)]):
            if t:
                if level:
                    quoted.append((level, t))
                else:
                    own.append(t)

    level, part = 0, []
    for k, (n, line) in enumerate(rows):
        if n == 0 and _INTRODUCTION.match(line) and next((m for m, x in rows[k + 1 :] if x.strip() or m), 0):
            continue
        if n != level or not line.strip():
            close(level, part)
            level, part = n, []
        if line.strip():
            part.append(line)
        if n == 0:
            own_lines.append(line)
    close(level, part)
    return "\n".join(own_lines).strip(), own, quoted


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, 3):
        got = [parse(t.as_py()) for t in part.column(3)]
        keys = [[{"level": 0, "key": _key(t), "size": len(t), "whole": t == whole} for t in own] + [{"level": n, "key": _key(t), "size": len(t), "whole": False} for n, t in quoted] for whole, own, quoted in ((_normal(g[0]), g[1], g[2]) for g in got)]
        yield pa.RecordBatch.from_arrays(
            [part.column(0), part.column(1), part.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([len(g[2]) for g in got], pa.int64()), pa.array(keys, _KEYS)],
            names=["conv_id", "turn", "role", "text", "n_quotes", "keys"],
        )


_KEYS = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.int64()), ("size", pa.int64()), ("whole", pa.bool_())]))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Row numbers within the partition."""
    n = 0
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(range(n, n + batch.num_rows), pa.int64())], names=[*batch.schema.names, "nth"])
        n += batch.num_rows


def link(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n_quotes, reply_to, thread, position) of every message; position counts from 1."""
    spark = messages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "quotations")
    source = messages.select(long_id(messages, conv_col).alias("conv_id"), long_id(messages, turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    parsed = scratch.keep(source.mapInArrow(_parsed, "conv_id long, turn long, role string, text string, n_quotes long, keys array<struct<level:int,key:long,size:long,whole:boolean>>"), "parsed")
    keys = parsed.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("keys").alias("k")).select("conv_id", "turn", "k.*")
    quotes = keys.where("level > 0").select("conv_id", "turn", "level", "key", "size")
    # Only keys that someone quotes are looked for among the own passages; the first holder is the original.
    wanted = quotes.select("conv_id", "key").distinct()
    first = keys.where("level = 0").groupBy("conv_id", "key").agg(F.min("turn").alias("holder"), F.min(F.when(F.col("whole"), F.col("turn"))).alias("message")).join(wanted, ["conv_id", "key"], "left_semi")
    # Written first: above an aggregate with the same keys, the join could not split the rows of a hot passage.
    first = scratch.keep(first, "first")
    strong, whole = F.col("size") >= LEAST_CHARS, (F.col("size") < LEAST_CHARS) & F.coalesce(F.col("message") < F.col("turn"), F.lit(False))
    matched = quotes.join(maybe_broadcast(first, first.count()), ["conv_id", "key"]).withColumns({"strong": strong, "whole": whole, "original": F.when(whole, F.col("message")).otherwise(F.col("holder"))}).where("original < turn")
    votes = matched.groupBy("conv_id", "turn", "original", "strong").agg(F.max("whole").alias("whole"), F.min("level").alias("level"), F.sum("size").alias("size"))
    parents = votes.groupBy("conv_id", "turn").agg(F.max_by("original", F.struct("strong", "whole", -F.col("level"), "size", "original")).alias("reply_to"))
    parents = scratch.keep(parents, "parents")

    # Thread heads: each round doubles the distance that a pointer spans.
    heads, old = parents.select("conv_id", "turn", F.col("reply_to").alias("head")), None
    for n in range(MOST_ROUNDS):
        above = heads.select("conv_id", F.col("turn").alias("head"), F.col("head").alias("next"))
        kept = scratch.keep(heads.join(above, ["conv_id", "head"], "left").select("conv_id", "turn", F.coalesce("next", "head").alias("head"), F.col("next").isNotNull().alias("moved")), f"heads-{n}")
        moved = kept.where("moved").limit(1).count()
        if old:
            scratch.drop(old)
        heads, old = kept.select("conv_id", "turn", "head"), f"heads-{n}"
        if not moved:
            break
    else:
        raise RuntimeError(f"threads did not settle in {MOST_ROUNDS} rounds")

    links = parents.join(heads, ["conv_id", "turn"])
    placed = parsed.drop("keys").join(links, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("head", "turn")).drop("head")
    order = ["conv_id", "thread", "turn", "role", "text"]
    dealt = placed.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    fields = [(c, dict(dealt.dtypes)[c]) for c in dealt.columns]
    numbered = scratch.keep(dealt.mapInArrow(_numbered, ", ".join(f"{c} {t}" for c, t in fields) + ", nth long"), "numbered")
    # One count per partition reaches the driver.
    offset, offsets = 0, []
    for r in numbered.groupBy("part").count().orderBy("part").collect():
        offsets.append((r.part, offset))
        offset += r["count"]
    ahead = F.broadcast(spark.createDataFrame(offsets, "part int, ahead long"))
    ranked = numbered.join(ahead, "part").withColumn("rank", F.col("nth") + F.col("ahead"))
    # Written first, so that the rows of a hot conversation can be split in the join.
    starts = scratch.keep(ranked.groupBy(F.col("conv_id").alias("c")).agg(F.min("rank").alias("start")), "starts")
    out = ranked.join(maybe_broadcast(starts, starts.count()), F.col("conv_id").eqNullSafe(F.col("c")))
    return out.select("conv_id", "turn", "role", "text", "n_quotes", "reply_to", "thread", (F.col("rank") - F.col("start") + 1).alias("position"))
