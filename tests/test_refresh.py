"""Condensed clusters, propagation, ridge fit, the refresh and the mastery stream."""

import numpy as np
import pandas as pd
import pytest

from gradeloom.operators import clusters as C
from gradeloom.operators import refresh as R
from gradeloom.operators.grouped import spanning_tree
from gradeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_three_groups_and_noise():
    rng = np.random.default_rng(1)
    x = np.concatenate([c + rng.normal(0, 0.02, (9, 3)) for c in np.eye(3)])
    label, stable = C.excess_of_mass(spanning_tree(x, 2), len(x), 5)
    parts = [set(label[i : i + 9]) - {-1} for i in (0, 9, 18)]
    assert all(len(p) == 1 for p in parts) and len(set.union(*parts)) == 3
    assert set(stable) == set.union(*parts)


def test_too_few_points_are_noise():
    assert (C.excess_of_mass(spanning_tree(np.eye(4), 2), 4, 3)[0] == -1).all()


def test_linkage_heights_ascend():
    x = np.random.default_rng(0).normal(size=(20, 3))
    left, right, height = C.linkage(spanning_tree(x, 2), 20)
    assert (np.diff(height) >= 0).all() and sorted([*left, *right]) == list(range(38))


def test_order_of_prerequisites(spark):
    edges = spark.createDataFrame([("a", "c"), ("a", "b"), ("b", "d"), ("d", "e"), ("e", "f"), ("c", "a")], "concept string, prereq string")
    assert [x for x in R.prerequisite_order(edges) if x[0] == "a"] == [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("a", "e", 4)]


def test_propagation_against_a_loop(spark):
    obs = spark.createDataFrame([(1, "a", 0.0, 1.0), (1, "a", 0.2, 0.5), (1, "b", 0.0, 1.0), (2, "a", 0.0, 1.0)], "student_id long, concept_key string, score double, confidence double")
    states = spark.createDataFrame([(1, "a", 0.2, 2), (1, "b", 0.5, 1), (2, "a", 0.2, 1)], "student_id long, concept_key string, m double, n long")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "concept string, prereq string")
    got = {(r.student_id, r.concept_key): r for r in R.propagated(states, obs, edges).collect()}
    strength = (1.0 + 0.8 * 0.5) / 2
    assert got[1, "b"].estimate == pytest.approx(0.5 - strength * 0.45 / 2)
    assert got[1, "c"].estimate == pytest.approx(0.25 - strength * 0.45**2) and got[1, "c"].inferred
    assert got[2, "a"].estimate == 0.2 and (2, "b") not in got


def test_ridge_against_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 2))
    rows = spark.createDataFrame(pd.DataFrame({"p": x[:, 0], "q": x[:, 1], "target": x @ [0.3, 0.5]}))
    prior = {"bias": 0.1, "p": 0.4, "q": 0.2}
    a = np.column_stack([np.ones(30), x])
    want = np.linalg.solve(a.T @ a + np.eye(3), a.T @ (x @ [0.3, 0.5]) + np.array([0.1, 0.4, 0.2]))
    assert np.allclose(R.ridge_fit(rows, prior=prior).weight, want)
    assert list(R.ridge_fit(rows.limit(5), prior=prior).weight) == [0.1, 0.4, 0.2]


@pytest.mark.parametrize("name", ["k9_recomputed_mastery", "z1_refresh", "l2_confidence_model", "snk11_model_json", "snk9_attainment_csv", "c4_condensed_clusters", "src5_archives", "src9_generated_inputs"])
def test_runs(spark, name):
    assert catalog.queries()[name](spark, DATA).count() > 0


def test_stream_equals_batch(spark):
    batch = {(r.student_id, r.concept_key): (r.estimate, r.n) for r in catalog.queries()["k3_trace_students"](spark, DATA).collect()}
    stream = {(r.student_id, r.concept_key): (r.estimate, r.n) for r in catalog.queries()["t1_streamed_mastery"](spark, DATA).collect()}
    assert batch.keys() == stream.keys()
    assert all(stream[k] == pytest.approx(batch[k], abs=2e-6) for k in batch)
