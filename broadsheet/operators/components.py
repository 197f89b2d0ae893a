"""Connected components by minimum labels with pointer jumping; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.scratch import Scratch

#: Rounds after which an unfinished run is an error rather than a wrong answer.
MOST_ROUNDS = 60


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, label) of every end of ``edges`` (a, b): label is the smallest id that can be reached.

    Each round takes the least label among a vertex and its neighbours and then the label of that label, so a path of n
    vertices needs about log n rounds. Minima are combined before the shuffle, which keeps a vertex with very many edges
    cheap; the join of its edges with its one label is split by adaptive execution.
    """
    # One pass over the edges, which may come from costly tasks.
    turned = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")
    both = scratch.keep(edges.where("a <> b").select(turned).select("e.a", "e.b"), f"{name}-edges")
    labels = scratch.keep(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), f"{name}-0")
    old = f"{name}-0"
    for n in range(1, MOST_ROUNDS + 1):
        near = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        better = labels.join(near, "id").select("id", "label", F.least("label", "near").alias("next"))
        above = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        moved = better.join(above, "next", "left").select("id", F.least("next", F.coalesce("above", "next")).alias("label"), F.col("label").alias("was"))
        kept = scratch.keep(moved, f"{name}-{n}")
        changed = kept.where("label <> was").limit(1).count()
        scratch.drop(old)
        old, labels = f"{name}-{n}", kept.select("id", "label")
        if not changed:
            return labels
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
