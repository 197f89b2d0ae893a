"""Near duplicates by circulant MinHash: signatures of two permutations, banding, exact check on full sets.

1. The first permutation sends a shingle to a place on a ring of 2**32 places, the second one orders the ring. Coordinate
   k of a signature is the least value that the second permutation, shifted by k places, gives to a place of the set: two
   permutations make all ``COORDINATES``. Each ``ROWS`` of them are a band. Texts are read once for this; sets that are
   equal are one class from here on, named by (size, two 64-bit sums).
2. Classes that share a band meet at the least id among them, its center, once for all bands that lead there. Only their
   sets travel. Around a center a signature tree and a check of the full sets find the links that connect something new;
   a large group falls into blocks of ``BLOCK`` sets, and the center is in every block.
3. Around a center with several blocks, sets that have not been connected with it meet all the others, block by block:
   n connected and m unconnected sets cost n * m / BLOCK copies, so a group of near copies of any size costs one each.

A link can be lost only if the two sets agree in no band. At a similarity of 0.8 that has a chance of 1e-11
(``chance_of_missing``), less above it; it is of the order of the hash collisions that set comparison allows for anyway
(sets are compared on 48 of 64 bits of their hashes). Nothing else drops a pair.

Cases: a document without words or text has an empty set and links with nothing; a single word is one shingle; ties at
exactly 80 % link (integer arithmetic). Rows that repeat an id are one document with several sets: each row shows the size
of its own set, and all carry one component. A null id is kept, unlinked, with a null component; ids that are not whole
numbers are an error. An empty table gives an empty result. Only the id and the text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import jaccard
from broadsheet.llm.shared import Scratch, chunks, long_id, maybe_broadcast, release, small_batches, tidy
from broadsheet.llm.words import U64, Words, mix
from broadsheet.operators.components import components

SHINGLE = 2
NUM, DEN = 4, 5
ROWS, BANDS = 5, 64
COORDINATES = ROWS * BANDS
#: Places handled in one vectorised step.
STEP = 512
_FIRST = U64(0x6A09E667F3BCC908)


def chance_of_missing(similarity: float) -> float:
    """That two sets of this similarity agree in no band."""
    return (1 - similarity**ROWS) ** BANDS


def first_permutation(s: np.ndarray) -> np.ndarray:
    """The places of a set of hashes on the ring."""
    return (mix(s ^ _FIRST) >> U64(32)).astype(np.uint32)


def second_permutation(places: np.ndarray) -> np.ndarray:
    """A fixed order of the ring: a bijection on 32 bits."""
    x = places ^ (places >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signature(s: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """Least values of a set that is not empty under the second permutation and its circular shifts."""
    shifts = np.arange(coordinates, dtype=np.uint32)[:, None]
    places = first_permutation(s)
    least = np.full(coordinates, 2**32 - 1, np.uint32)
    for a in range(0, len(places), STEP):
        np.minimum(least, second_permutation(places[None, a : a + STEP] + shifts).min(1), out=least)
    return least


def band_keys(s: np.ndarray) -> np.ndarray:
    """One key for each band of the signature; bands do not share keys."""
    bands = signature(s).astype(U64).reshape(BANDS, ROWS)
    keys = np.arange(1, BANDS + 1, dtype=U64)
    for k in range(ROWS):
        keys = mix(keys + bands[:, k] + U64(k + 1))
    return keys.view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, n, c1, c2, keys); a set that the batch has had already is not signed again."""
    for batch in chunks(batches):
        sets = Words(batch.column(1), lower=True).shingle_sets(SHINGLE)
        names = [jaccard.set_class(s) for s in sets]
        known: dict[tuple[int, int], np.ndarray] = {}
        for s, name in zip(sets, names):
            if len(s) and name not in known:
                known[name] = band_keys(s)
        keys = [known[name] if len(s) else None for s, name in zip(sets, names)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([c[k] for c in names], pa.int64()) for k in (0, 1)), pa.array(keys, pa.list_(pa.int64()))],
            names=["id", "n", "c1", "c2", "keys"],
        )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches):
        sets = Words(batch.column(1), lower=True).shingle_sets(SHINGLE)
        # An empty set comes here only as a further row of an id that has another one.
        filled = pa.array([len(s) > 0 for s in sets], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(filled), pa.array([jaccard._ship(s) for s in sets if len(s)], pa.binary())], names=["id", "hashes"])


def centers(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(center, id): the classes that share a band with ``center``, the least id of that band; the center itself included."""
    keyed = scratch.keep(classes.select(F.col("rep").alias("id"), F.explode("keys").alias("key")), "bands")
    least = keyed.groupBy("key").agg(F.min("id").alias("center"), F.count("*").alias("n")).where("n > 1")
    # A table of its own, so that the join may split the rows of a band that very many sets share.
    least = scratch.keep(least.select("key", "center"), "centers")
    met = scratch.keep(keyed.join(maybe_broadcast(least, least.count()), "key").select("center", "id").distinct(), "met")
    scratch.drop("bands", "centers")
    return met


def _links(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """New links (a, b) in each group of ``dealt``; ``sets`` has (id, label, hashes)."""
    groups = dealt.join(sets, "id").groupBy(*[c for c in dealt.columns if c != "id"])
    return groups.applyInArrow(tidy(lambda t: jaccard._block_links(t, NUM, DEN)), "a long, b long")


def _across(blocks: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Groups (center, kind, one, two, id) in which what is not connected with a center of several blocks meets the rest.

    Kind 0: a block of connected sets and one of unconnected ones; kind 1: two blocks of unconnected ones.
    """
    host = labels.select(F.col("id").alias("center"), F.col("label").alias("host"))
    rows = blocks.where("parts > 1").select("center", "id").join(labels, "id", "left").join(host, "center", "left")
    rows = scratch.keep(rows.select("center", "id", (F.coalesce("label", "id") != F.coalesce("host", "center")).alias("apart")), "large")
    half = jaccard.BLOCK / 2
    sizes = rows.groupBy("center").agg(F.ceil(F.count_if(~F.col("apart")) / half).cast("int").alias("p"), F.ceil(F.count_if("apart") / half).cast("int").alias("q")).where("q > 0")
    sizes = scratch.keep(sizes, "large-sizes")
    n = sizes.count()
    if not n:
        return None
    rows = rows.join(maybe_broadcast(sizes, n), "center")
    block, every = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int"), lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    near, far = rows.where("not apart"), rows.where("apart")
    met = near.select("center", F.lit(0).alias("kind"), block("p").alias("one"), every("q").alias("two"), "id")
    met = met.union(far.select("center", F.lit(0), every("p"), block("q"), "id"))
    own = far.select("center", block("q").alias("one"), every("q").alias("two"), "id")
    return met.union(own.select("center", F.lit(1), F.least("one", "two"), F.greatest("one", "two"), "id"))


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; component_id is the least id reachable by links, itself included,
    and of each group of linked documents the one with that id is kept."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, "minhash")
    source = docs.select(long_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("body"))
    signed = scratch.keep(source.mapInArrow(_signed, "id long, n long, c1 long, c2 long, keys array<long>"), "signed")
    filled = signed.where("n > 0 and id is not null")
    # Equal sets have equal keys.
    classes = scratch.keep(filled.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"), F.first("keys").alias("keys")), "classes")
    met = centers(classes, scratch)
    live = scratch.keep(met.select("id").distinct(), "live")
    sets = scratch.keep(source.join(maybe_broadcast(live, live.count()), "id", "left_semi").mapInArrow(_sets, "id long, hashes binary"), "sets")
    release(spark)

    blocks = scratch.keep(jaccard._blocks(met, ["center"], jaccard.BLOCK, scratch, "center-blocks"), "blocks")
    of = F.when(F.col("id") == F.col("center"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")))
    first = scratch.keep(_links(blocks.select("center", F.explode(of).alias("block"), "id"), sets.withColumn("label", F.col("id"))).distinct(), "links")
    labels = components(first, scratch, "first")
    across = _across(blocks, labels, scratch)
    if across is not None:
        named = sets.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"), "hashes")
        first = first.union(scratch.keep(_links(across, named), "more"))
    release(spark)

    # A document that stands for several classes, because rows repeat its id, joins them.
    twice = scratch.keep(signed.where("id is not null").groupBy("id").count().where("count > 1").select("id"), "twice")
    n_twice = twice.count()
    if n_twice:
        first = first.union(filled.join(maybe_broadcast(twice, n_twice), "id", "left_semi").join(classes, ["c1", "c2", "n"]).select("id", "rep"))
    if across is not None or n_twice:
        labels = components(first, scratch, "final")
    reps = classes.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("c1", "c2", "n", F.coalesce("label", "rep").alias("component_id"))
    # Written first: a join right above the aggregate could not split the rows of a class with very many copies.
    reps = scratch.keep(reps, "reps")
    joined = signed.select("id", "n", "c1", "c2").join(reps, ["c1", "c2", "n"], "left")
    if n_twice:
        own = scratch.keep(labels.join(maybe_broadcast(twice, n_twice), "id", "left_semi").select("id", F.col("label").alias("own")), "named-twice")
        joined = joined.join(maybe_broadcast(own, n_twice), "id", "left").withColumn("component_id", F.coalesce("own", "component_id"))
    scratch.drop("classes", "met", "live", "sets", "blocks", "center-blocks", "large", "large-sizes", "links", "more")
    out = joined.select("id", F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
