"""Condensed clusters from blocks of vectors against the same over all distances."""

import numpy as np

from gradeloom.operators import clusters as C
from gradeloom.operators import graphs
from gradeloom.operators.grouped import spanning_tree


def brute(ids, x):
    """vec_id: (cluster, stability, medoid) of one group with all its distances."""
    tree = spanning_tree(x, 2)
    tree[:, 0] = np.round(tree[:, 0], 12)
    label, stable = C.excess_of_mass(tree[np.argsort(tree[:, 0], kind="stable")], len(ids), 3)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {i: (-1, 0.0, False) for i in ids}
    for c, s in stable.items():
        at = np.flatnonzero(label == c)
        best = at[np.argmax(np.round(unit[at] @ unit[at].sum(0), 9))]
        out |= {ids[i]: (ids[at].min(), round(float(s), 4), i == best) for i in at}
    return out


def test_condensed_clusters_come_from_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "spanning_edges", lambda *a, **k: graphs.spanning_edges(*a, **k, block=7))
    rng = np.random.default_rng(3)
    groups = {1: np.concatenate([c + rng.normal(0, 0.05, (9, 4)) for c in np.eye(4)[:3]]), None: np.concatenate([c + rng.normal(0, 0.1, (8, 4)) for c in np.eye(4)[:2]]), 2: rng.normal(size=(1, 4))}
    rows, want, at = [], {}, 0
    for label, x in groups.items():
        ids = np.arange(at, at := at + len(x))
        rows += [(int(i), label, v.tolist()) for i, v in zip(ids, x)]
        want |= brute(ids, x)
    rows += [(500, 1, None)]
    vectors = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.cluster, r.stability, r.medoid) for r in C.condensed_clusters(vectors).collect()}
    assert got == want and sum(r[2] for r in want.values()) == 7
    assert C.condensed_clusters(vectors.limit(0)).count() == 0


def test_the_order_of_equal_edges_does_not_count():
    edges = np.array([(0.1, 0, 1), (0.1, 1, 2), (0.1, 2, 3), (0.5, 4, 5), (0.9, 3, 4), (0.9, 5, 6)])
    swapped = edges[[0, 1, 2, 3, 5, 4]]
    for e in (edges, swapped):
        label, stable = C.excess_of_mass(e, 7, 3)
        assert (label == -1).all() and not stable


def test_a_split_of_many_sides_makes_clusters_of_the_large_ones_alone():
    edges = np.array([(0.1, 0, 1), (0.1, 1, 2), (0.2, 3, 4), (0.2, 4, 5), (0.5, 2, 3), (0.5, 5, 6), (0.9, 6, 7)])
    label, stable = C.excess_of_mass(edges, 8, 3)
    assert label[0] == label[1] == label[2] >= 8 and label[3] == label[4] == label[5] >= 8 and label[0] != label[3]
    assert label[6] == label[7] == -1 and set(stable) == {label[0], label[3]}
