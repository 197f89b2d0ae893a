"""Matrix models: principal components by explained variance, topic models with a grid, non-negative factors, and density
clusters. Documents stay distributed; what reaches the driver is bounded by the vocabulary and the number of components."""

from __future__ import annotations

from collections.abc import Iterator
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import inheritable_thread_target
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from broadsheet.scratch import Scratch

#: Points that one group of density clusters may have so that its distances are compared in one task; those of a larger group
#: are compared in blocks of BLOCK_POINTS, of which every two meet in a task.
MOST_POINTS = 5_000
BLOCK_POINTS = 1_024
_TINY = 1e-9


def components_for(df: DataFrame, id_col: str, vector_col: str, variance: float = 0.95) -> DataFrame:
    """(id, components): standardised vectors on as many principal components as explain the wanted share of variance."""
    v = df.select(id_col, array_to_vector(F.col(vector_col).cast("array<double>")).alias("_v"))
    scaled = StandardScaler(inputCol="_v", outputCol="_s", withMean=True).fit(v).transform(v)
    size = len(v.first()["_v"])
    model = PCA(k=size, inputCol="_s", outputCol="_p").fit(scaled)
    share = np.cumsum(model.explainedVariance.toArray())
    k = int(np.searchsorted(share, variance - 1e-12) + 1)
    return model.transform(scaled).select(id_col, F.slice(vector_to_array("_p"), 1, min(k, size)).alias("components"))


def lda_grid(
    counts: DataFrame, features_col: str, sizes: list[int], decays: list[float], iterations: int = 10, seed: int = 7, folds: int = 5, parallel: int = 4, id_col: str = "id"
) -> DataFrame:
    """(k, decay, perplexity, spread) of a topic model for each pair of settings, the best first: mean and standard deviation,
    over the folds, of the log perplexity of a fold's rows under a model of all others.

    Rows are dealt by the hash of their id, so folds do not depend on partitions; a null id is one id. Models of settings and
    folds are independent jobs, ``parallel`` at a time. A fold without rows, or with all of them, judges nothing; where no fold
    can (one row, or equal ids), all rows are learned from and judged. Without rows there are no settings to compare.
    """
    spark = counts.sparkSession
    fold = F.pmod(F.xxhash64(F.col(id_col)), F.lit(folds)).cast("int")
    dealt = counts.select(fold.alias("fold"), features_col).persist()
    try:
        rows_of = {r.fold: r["count"] for r in dealt.groupBy("fold").count().collect()}
        judged: list[int | None] = sorted(rows_of) if len(rows_of) > 1 else [None] * bool(rows_of)
        tasks = [(k, decay, f) for k in sizes for decay in decays for f in judged]

        def one(task: tuple[int, float, int | None]) -> float:
            k, decay, f = task
            train, test = (dealt, dealt) if f is None else (dealt.where(F.col("fold") != f), dealt.where(F.col("fold") == f))
            lda = LDA(k=k, maxIter=iterations, seed=seed, optimizer="online", learningDecay=decay, featuresCol=features_col)
            return float(lda.fit(train).logPerplexity(test))

        with ThreadPool(parallel) as pool:
            found = pool.map(inheritable_thread_target(spark)(one), tasks)
    finally:
        dealt.unpersist()
    by: dict[tuple[int, float], list[float]] = {}
    for (k, decay, _), x in zip(tasks, found):
        by.setdefault((k, decay), []).append(x)
    rows = [(k, decay, float(np.mean(x)), float(np.std(x))) for (k, decay), x in by.items()]
    return spark.createDataFrame(sorted(rows, key=lambda r: (r[2], r[0], r[1])), "k int, decay double, perplexity double, spread double")


def sparse_parts(vector_col: str) -> list[Column]:
    """The columns ``at`` and ``values`` of a vector: positions and values other than 0."""
    v = vector_to_array(vector_col)
    at = F.filter(F.transform(v, lambda x, i: F.when(x != 0, i)), lambda i: i.isNotNull())
    return [at.alias("at"), F.filter(v, lambda x: x != 0).alias("values")]


def _loads(v: np.ndarray, h: np.ndarray, steps: int) -> np.ndarray:
    """Non-negative loads of rows on fixed factors, by multiplicative steps from equal loads."""
    return _stepped(v @ h.T, v.mean(), h, steps)


def _stepped(top: np.ndarray, mean: float, h: np.ndarray, steps: int) -> np.ndarray:
    """The same from the rows' products with the factors and their mean."""
    w, square = np.full(top.shape, max(mean, _TINY)), h @ h.T
    for _ in range(steps):
        w *= top / (w @ square + _TINY)
    return w


def _sparse_loads(row: np.ndarray, at: np.ndarray, values: np.ndarray, n: int, h: np.ndarray, steps: int) -> np.ndarray:
    """The same for n rows given by their values other than 0 and where these stand."""
    top = np.stack([np.bincount(row, values * part[at], n) for part in h], 1)
    return _stepped(top, values.sum() / (n * h.shape[1]), h, steps)


def nmf(counts: DataFrame, terms: int, k: int, iterations: int = 20, steps: int = 20, seed: int = 7) -> np.ndarray:
    """Factors (k x terms) of a non-negative matrix whose rows are (at array<int>, values array<double>).

    The rows are written once, so that no round makes them anew. Each round finds the loads of every row where it lies, and sums of loads times rows and loads times loads are combined
    before they reach the driver: k x terms numbers, whatever the number of rows.
    """
    rows = Scratch(counts.sparkSession, "nmf").keep(counts.select(F.col("at").cast("array<int>"), F.col("values").cast("array<double>")), "rows")
    rng = np.random.default_rng(seed)
    h = rng.random((k, terms)) + 0.1
    for _ in range(iterations):

        def sums(batches: Iterator[pa.RecordBatch], h: np.ndarray = h) -> Iterator[pa.RecordBatch]:
            top, square = np.zeros((k, terms)), np.zeros((k, k))
            for b in (b for b in batches if b.num_rows):
                row = np.repeat(np.arange(b.num_rows), b.column(0).value_lengths().to_numpy(zero_copy_only=False))
                at, values = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns)
                w = _sparse_loads(row, at, values, b.num_rows, h, steps)
                top += np.stack([np.bincount(at, values * load[row], terms) for load in w.T])
                square += w.T @ w
            both = np.concatenate([top, square], 1)
            i, j = (x.ravel().astype(np.int32) for x in np.indices(both.shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(both.ravel())], ["i", "j", "x"])

        got = rows.mapInArrow(sums, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
        both = np.zeros((k, terms + k))
        both[got["i"], got["j"]] = got["x"]
        h = h * both[:, :terms] / (both[:, terms:] @ h + _TINY)
    return h


def density_clusters(x: np.ndarray, least: int, neighbours: int | None = None) -> np.ndarray:
    """Hierarchical density clusters (HDBSCAN by excess of mass); -1 for noise, clusters in the order of their first point."""
    n, neighbours = len(x), neighbours or least
    if n < least or n < 2:
        return np.full(n, -1)
    distance = np.sqrt(np.maximum(((x[:, None, :] - x[None, :, :]) ** 2).sum(2), 0)) if n <= 300 else _distances(x, x)
    core = np.sort(distance, 1)[:, min(neighbours, n) - 1]
    return density_labels(n, _spanning(distance, core), least)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))


def _spanning(distance: np.ndarray, core: np.ndarray) -> list[tuple[float, int, int]]:
    """Minimum spanning tree of the mutual reachability, grown from point 0."""
    n = len(core)
    reach = np.maximum(np.maximum(core[:, None], core[None, :]), distance)
    inside, best, link, edges = np.zeros(n, bool), reach[0].copy(), np.zeros(n, int), []
    inside[0] = True
    for _ in range(n - 1):
        j = int(np.where(inside, np.inf, best).argmin())
        edges.append((best[j], int(link[j]), j))
        inside[j] = True
        closer = reach[j] < best
        best[closer], link[closer] = reach[j][closer], j
    return edges


def density_labels(n: int, edges: list[tuple[float, int, int]], least: int) -> np.ndarray:
    """Clusters of n points from edges (length, point, point) that hold a minimum spanning tree."""
    labels = np.full(n, -1)
    # Single linkage: node n + m joins two nodes at the m-th shortest edge of the tree.
    up, kids, heights, sizes = list(range(2 * n - 1)), {}, {}, [1] * n + [0] * (n - 1)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    node = n - 1
    for d, a, b in sorted(edges):
        a, b = find(a), find(b)
        if a == b:
            continue
        node += 1
        kids[node], heights[node], sizes[node] = (a, b), d, sizes[a] + sizes[b]
        up[a] = up[b] = node

    def points(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            i = stack.pop()
            if i < n:
                out.append(i)
            else:
                stack += kids[i]
        return out

    # Condensed tree: a cluster lives on as long as it does not split into two that are large enough.
    clusters: list[dict] = []
    stack = [(2 * n - 2, 0.0, None)]
    while stack:
        node, born, parent = stack.pop()
        own = {"points": points(node), "born": born, "stable": 0.0, "kids": [], "chosen": False}
        number = len(clusters)
        clusters.append(own)
        if parent is not None:
            clusters[parent]["kids"].append(number)
        while node >= n:
            rate = 1 / max(heights[node], _TINY)
            a, b = kids[node]
            if sizes[a] >= least and sizes[b] >= least:
                own["stable"] += (rate - born) * sizes[node]
                stack += [(b, rate, number), (a, rate, number)]
                break
            for side in (a, b):
                if sizes[side] < least:
                    own["stable"] += (rate - born) * sizes[side]
            node = a if sizes[a] >= least else b if sizes[b] >= least else -1
    for number in range(len(clusters) - 1, -1, -1):
        own = clusters[number]
        below = sum(clusters[k]["total"] for k in own["kids"])
        # The root is all points: no cluster.
        own["chosen"] = number > 0 and own["stable"] >= below
        own["total"] = own["stable"] if own["chosen"] else below
    picked, stack = [], [0]
    while stack:
        own = clusters[stack.pop()]
        if own["chosen"]:
            picked.append(own["points"])
        else:
            stack += own["kids"]
    for c, members in enumerate(sorted(picked, key=min)):
        labels[members] = c
    return labels


def clustered(df: DataFrame, id_col: str, vector_col: str, by: str, least: int = 5) -> DataFrame:
    """(by, id, cluster): density clusters of each group. A group of up to MOST_POINTS rows is compared in one task, a larger one
    in blocks; its points are never sampled."""
    kinds = dict(df.dtypes)
    schema = f"`{by}` {kinds[by]}, `{id_col}` {kinds[id_col]}, cluster int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(id_col, kind="stable")
        found = density_clusters(np.stack(frame[vector_col].to_numpy()).astype(float), least)
        return pd.DataFrame({by: frame[by], id_col: frame[id_col], "cluster": found.astype(np.int32)})

    rows = df.select(by, id_col, vector_col)
    sizes = rows.groupBy(F.struct(by).alias("g")).agg(F.count("*").alias("n")).where(F.col("n") > MOST_POINTS)
    # Each large group holds more than MOST_POINTS rows, so there are few of them.
    large = Scratch(df.sparkSession, "density").keep(sizes, "large")
    if not large.limit(1).count():
        return rows.groupBy(by).applyInPandas(run, schema)
    small = rows.join(large, F.struct(by) == large.g, "left_anti").groupBy(by).applyInPandas(run, schema)
    return small.unionByName(_clustered_in_blocks(rows.join(large, F.struct(by) == large.g), id_col, vector_col, by, least))


def _clustered_in_blocks(rows: DataFrame, id_col: str, vector_col: str, by: str, least: int) -> DataFrame:
    """The same for groups ``g`` of ``n`` points, with memory for two blocks.

    Every two blocks meet twice: for the nearest neighbours, from which the core distances come, and for a spanning tree of
    their points. Each edge lies in some pair of blocks, and one that is the longest of a circle there is in no tree of the
    whole, so these trees together hold one of the group. A group's edges, points times blocks at most, are linked in one task.
    """
    scratch = Scratch(rows.sparkSession, "density-blocks")
    order = F.row_number().over(W.partitionBy("g").orderBy(id_col)) - 1
    points = scratch.keep(rows.select("g", F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), "n", order.alias("at")), "points")
    g = points.schema["g"].dataType.simpleString()
    n_blocks = F.ceil(F.col("n") / BLOCK_POINTS).cast("int")

    def met(p: DataFrame) -> DataFrame:
        own = p.withColumn("block", (F.col("at") % n_blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n_blocks - 1)))
        dealt = own.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other"))
        groups = points.agg(F.sum(n_blocks / F.col("n") * (n_blocks + 1) / 2)).first()[0] or 1
        return dealt.drop("other").repartition(min(2_000, max(1, int(groups))), "g", "one", "two").groupBy("g", "one", "two")

    def nearest(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        parts = [frame[frame["block"] == b] for b in {key[1], key[2]}]
        x = [np.stack(p["v"].to_numpy()) for p in parts]
        far = _distances(x[0], x[-1])
        both = [(parts[0], far)] + ([(parts[1], far.T)] if len(parts) > 1 else [])
        return pd.concat([pd.DataFrame({"at": p["at"], "near": list(np.sort(d, 1)[:, :least])}) for p, d in both]).assign(g=[key[0]] * sum(map(len, parts)))[["g", "at", "near"]]

    near = met(points).applyInPandas(nearest, f"g {g}, at int, near array<double>")
    core = near.groupBy("g", "at").agg(F.sort_array(F.flatten(F.collect_list("near"))).alias("near")).select("g", "at", F.get("near", F.lit(least - 1)).alias("core"))
    reached = scratch.keep(points.drop("id").join(core, ["g", "at"]), "reached")

    def tree(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x, at = np.stack(frame["v"].to_numpy()), frame["at"].to_numpy()
        d, i, j = (np.array(c) for c in zip(*_spanning(_distances(x, x), frame["core"].to_numpy()))) if len(x) > 1 else (np.zeros(0), np.zeros(0, int), np.zeros(0, int))
        return pd.DataFrame({"g": [key[0]] * len(d), "d": d, "i": at[i], "j": at[j], "n": frame["n"].iloc[0]})

    edges = scratch.keep(met(reached).applyInPandas(tree, f"g {g}, d double, i int, j int, n long"), "edges")

    def linked(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        n = int(frame["n"].iloc[0])
        found = density_labels(n, list(zip(frame["d"].tolist(), frame["i"].tolist(), frame["j"].tolist())), least)
        return pd.DataFrame({"g": [key[0]] * n, "at": np.arange(n, dtype=np.int32), "cluster": found.astype(np.int32)})

    labels = edges.groupBy("g").applyInPandas(linked, f"g {g}, at int, cluster int")
    return points.join(labels, ["g", "at"]).select(F.col(f"g.`{by}`").alias(by), F.col("id").alias(id_col), "cluster")
