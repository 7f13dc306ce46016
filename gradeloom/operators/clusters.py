"""Hierarchical density clusters: single linkage, condensed tree, stability, excess-of-mass selection."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from gradeloom.operators.graphs import spanning_edges
from gradeloom.runtime import ship, stored


def linkage(edges: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, height) of the n - 1 merges, in order of weight; node i < n is a point, node n + k is merge k."""
    top, up = np.arange(2 * n - 1), np.arange(2 * n - 1)

    def find(i: int) -> int:
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    left, right = np.empty(n - 1, int), np.empty(n - 1, int)
    for k, (_, a, b) in enumerate(edges):
        left[k], right[k] = (top[find(int(x))] for x in (a, b))
        up[left[k]] = up[right[k]] = n + k
    return left, right, edges[:, 0]


def excess_of_mass(edges: np.ndarray, n: int, least: int) -> tuple[np.ndarray, dict[int, float]]:
    """Cluster node of each point (-1: noise) and the stability of each selected node.

    Going down the tree, a split with two sides or more of at least `least` points makes each of them a cluster; the small
    sides leave their cluster at the height of the split. Merges of equal height are one split of many sides, so the order
    of equal edges does not count. A cluster's stability is the sum, over the points that leave it so, of
    the density gained since its birth. A cluster is taken where it is as stable as
    the best selection below it. The root is never taken.
    """
    nothing = np.full(n, -1), {}
    if n < 2 * least:
        return nothing
    left, right, height = linkage(edges, n)
    root = 2 * n - 2
    size = np.ones(2 * n - 1, int)
    for k in range(n - 1):
        size[n + k] = size[left[k]] + size[right[k]]
    born, parent, gone = {root: height[-1]}, {}, {root: []}
    owner, order = {root: root}, [root]
    for node in range(root, n - 1, -1):  # a node's parent is always a later merge
        if node not in owner:
            continue
        k, own = node - n, owner[node]
        sides, todo = [], [int(left[k]), int(right[k])]
        while todo:  # merges of one height are one merge
            s = todo.pop()
            if s >= n and height[s - n] == height[k]:
                todo += [int(left[s - n]), int(right[s - n])]
            else:
                sides.append(s)
        big = [s for s in sides if size[s] >= least]
        for s in sides:
            if len(big) > 1 and s in big:
                owner[s], born[s], parent[s], gone[s] = s, height[k], own, []
                order.append(s)
            elif s in big:
                owner[s] = own
            else:
                gone[own].append((size[s], height[k]))
    # a single point can own a cluster only where one point is enough
    for c in order:
        if c < n:
            gone[c].append((1, 0.0))

    def stability(c: int) -> float:
        if born[c] <= 0:
            return 0.0
        since = 1 / born[c]
        return sum(m * max(0.0, (1 / h if h > 0 else 4 * since) - since) for m, h in gone[c])

    value = {c: stability(c) for c in order}
    best, taken, below = dict(value), set(), {c: [] for c in order}
    for c in reversed(order):
        if below[c] and (inner := sum(best[x] for x in below[c])) > value[c]:
            best[c] = inner
        else:
            todo = list(below[c])
            while todo:
                x = todo.pop()
                taken.discard(x)
                todo += below[x]
            taken.add(c)
        if c in parent:
            below[parent[c]].append(c)
    taken.discard(root)
    label = np.full(2 * n - 1, -1)
    for node in range(root, n - 1, -1):
        for s in (left[node - n], right[node - n]):
            label[s] = s if s in taken else label[node]
    return label[:n], {c: value[c] for c in taken}


def condensed_group(edges: pd.DataFrame, least: int = 3) -> pd.DataFrame:
    """Clusters of one group's vectors from its spanning tree (a, b, w), named by their smallest id; noise has no row."""
    edges = edges.sort_values(["w", "a", "b"])
    ids = np.unique(edges[["a", "b"]].to_numpy())
    tree = np.column_stack([edges["w"], np.searchsorted(ids, edges["a"]), np.searchsorted(ids, edges["b"])])
    label, stable = excess_of_mass(tree, len(ids), least)
    at = np.flatnonzero(label >= 0)
    first = pd.Series(ids[at]).groupby(label[at]).transform("min").to_numpy()
    return pd.DataFrame({"vec_id": ids[at], "cluster": first, "stability": [round(float(stable[c]), 4) for c in label[at]]})


def medoids(members: DataFrame) -> DataFrame:
    """vec_id of the member of each cluster with the least total distance to its others; members has cluster, vec_id and embedding."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    long = F.greatest(F.lit(1e-12), F.sqrt(F.aggregate(x, F.lit(0.0), lambda z, v: z + v * v)))
    units = members.select("cluster", "vec_id", F.transform(x, lambda v: v / long).alias("unit"))
    total = units.groupBy("cluster").agg(vector_to_array(Summarizer.sum(array_to_vector("unit"))).alias("all_"))
    # the most similar to all is the least distant
    near = F.round(F.aggregate(F.zip_with("unit", "all_", lambda v, w: v * w), F.lit(0.0), lambda z, v: z + v), 9)
    best = units.join(total.hint("merge"), "cluster").groupBy("cluster").agg(F.max(F.struct(near.alias("near"), (-F.col("vec_id")).alias("id"))).alias("best"))
    return best.select((-F.col("best.id")).alias("vec_id"))


def condensed_clusters(vectors: DataFrame, group: str = "label", least: int = 3) -> DataFrame:
    """vec_id, cluster, stability, medoid. Distances are compared in blocks; a task holds one group's tree, which has an edge a vector.

    Rows without a vector or key are left out, keys are unique; a null group is a group.
    """
    ship(vectors.sparkSession)
    rows = vectors.filter("vec_id is not null and embedding is not null").select("vec_id", "embedding", F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("grp"))
    tree = spanning_edges(rows, group="grp", least=2)
    parts = stored(tree.groupBy("grp").applyInPandas(lambda edges: condensed_group(edges, least), "vec_id bigint, cluster bigint, stability double"), "condensed")
    best = medoids(rows.join(parts.hint("merge"), "vec_id")).withColumn("medoid", F.lit(True))
    all_ = rows.select("vec_id").join(parts.hint("merge"), "vec_id", "left").join(best.hint("merge"), "vec_id", "left")
    return all_.select("vec_id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), F.coalesce("stability", F.lit(0.0)).alias("stability"), F.coalesce("medoid", F.lit(False)).alias("medoid"))


def _embeddings(spark, sf_dir: str) -> DataFrame:
    return condensed_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding"))


def queries() -> dict:
    return {
        "c3_single_linkage": _embeddings,
        "c4_condensed_clusters": _embeddings,
        "c5_medoids": lambda spark, d: _embeddings(spark, d).filter("medoid").select("cluster", "vec_id", "stability"),
    }
