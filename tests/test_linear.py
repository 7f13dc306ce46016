"""Elimination in columns and the estimator against numpy."""

import glob

import numpy as np
from pyspark.sql import functions as F

from gradeloom.operators import linear as L
from gradeloom.operators import refresh as R
from gradeloom.runtime import run_folder, shared_root


def test_systems_are_solved_with_pivots(spark):
    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 12):
        systems = [rng.normal(size=(n, n)) for _ in range(6)] + [np.eye(n)[::-1], np.zeros((n, n))]
        rows = [(i, [[*map(float, r), float(i + j)] for j, r in enumerate(a)]) for i, a in enumerate(systems)] + [(99, None)]
        got = {r.i: r.x for r in spark.createDataFrame(rows, "i int, m array<array<double>>").select("i", L.solved(F.col("m"), n).alias("x")).collect()}
        assert got[7] is None and got[99] is None
        for i, a in enumerate(systems[:7]):
            assert np.allclose(got[i], np.linalg.solve(a, [float(i + j) for j in range(n)])), (n, i)


def test_the_estimator_fits_saves_loads_and_transforms(spark):
    rng = np.random.default_rng(2)
    x = rng.random((30, 2))
    rows = spark.createDataFrame([(float(a), float(b), float(0.3 * a + 0.5 * b)) for a, b in x] + [(0.5, None, None)], "p double, q double, target double")
    prior = {"bias": 0.1, "p": 0.4, "q": 0.2}
    model = L.AgreementRegression(prior=prior).fit(rows)
    weights = model.getOrDefault("weights")
    assert np.allclose(weights, R.ridge_fit(rows, prior=prior).weight) and model.getOrDefault("examples") == 30
    path = run_folder(spark, "model-test")
    model.save(path)
    again = L.AgreementModel.load(path)
    assert again.getOrDefault("weights") == weights and again.getOrDefault("features") == ["bias", "p", "q"]
    got = again.transform(rows).filter("target is null").first().confidence
    assert abs(got - 1 / (1 + np.exp(-4 * (weights[0] + weights[1] * 0.5 - 0.5)))) < 1e-12
    assert L.AgreementRegression(prior=prior).fit(rows.limit(5)).getOrDefault("weights") == [0.1, 0.4, 0.2]
    estimator = L.AgreementRegression(prior=prior, ridge=2.0)
    estimator.save(path + "-estimator")
    assert L.AgreementRegression.load(path + "-estimator").getOrDefault("ridge") == 2.0


def test_the_features_of_all_items_are_made_once(spark):
    """The fit and the mean read one stored table of them."""
    before = set(glob.glob(f"{shared_root(spark)}/gradeloom/item-features-*"))
    got = L.x6_confidence_model(spark, "/root/testdata/sf0.001").collect()
    made = set(glob.glob(f"{shared_root(spark)}/gradeloom/item-features-*")) - before
    assert len(got) == len(L.PRIOR_WEIGHTS) and len(made) == 1
