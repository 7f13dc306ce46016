"""Grouped operators: directions and small exact cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gradeloom.operators import grouped


def rows(scores):
    out = [(s, "c", x, 0.9, "test", pd.Timestamp("2026-01-05") + pd.Timedelta(days=i), 10 * s + i) for s, seq in enumerate(scores) for i, x in enumerate(seq)]
    return pd.DataFrame(out, columns=["student_id", "concept_key", "score", "confidence", "source", "observed_at", "obs_id"])


def test_few_students_keep_the_defaults():
    got = grouped.fit_concept(rows([[1.0, 0.0]] * 3)).iloc[0]
    assert (got.slip, got.guess, got.prior, got.learn) == (0.10, 0.20, 0.25, 0.18)


def test_failing_students_guess_less_than_passing_ones():
    assert grouped.fit_concept(rows([[0.0] * 6] * 6)).guess[0] < grouped.fit_concept(rows([[1.0] * 6] * 6)).guess[0]


def test_two_directions_are_two_clusters():
    rng = np.random.default_rng(0)
    v = np.concatenate([np.array([1, 0, 0]) + rng.normal(0, 0.01, (8, 3)), np.array([0, 1, 0]) + rng.normal(0, 0.01, (8, 3))])
    got = grouped.cluster_group(pd.DataFrame({"vec_id": range(16), "label": 0, "embedding": list(v)}))
    assert got.cluster[:8].nunique() == 1 and got.cluster[8:].nunique() == 1 and got.cluster[0] != got.cluster[15]


def test_code_facts():
    assert grouped.code_facts("def f(n):\n  for i in x:\n    for j in y: f(j)\n") == {"parsed": True, "functions": 1, "loop_depth": 2, "branches": 0, "recursive": True}
    assert not grouped.code_facts("def f(:")["parsed"]


def test_fit_by_sums_is_the_fit_of_each_concept_in_one_task(spark):
    rng = np.random.default_rng(3)
    rows = pd.DataFrame({
        "student_id": rng.integers(0, 30, 900), "concept_key": rng.choice(["a", "b", "c"], 900), "score": rng.uniform(-0.1, 1.2, 900), "confidence": rng.uniform(0, 1.3, 900),
        "source": rng.choice([*grouped.SOURCES, "other"], 900), "observed_at": pd.Timestamp("2026-01-05") + pd.to_timedelta(rng.integers(0, 500, 900), "h"), "obs_id": range(900),
    })
    rows["score"] = np.where(rows["concept_key"] == "a", rng.random(900) < 0.97, np.where(rows["concept_key"] == "b", rng.random(900) < 0.8, rows["score"])).astype(float)
    rows = pd.concat([rows, rows.head(3).assign(concept_key="few", student_id=[1, 2, 3])])
    got = grouped.fit_parameters(spark.createDataFrame(rows)).toPandas().set_index("concept_key").sort_index()
    want = pd.concat([grouped.fit_concept(g) for _, g in rows.groupby("concept_key")]).set_index("concept_key").sort_index()
    assert list(got.n) == list(want.n) and (got.loc["few", "slip"], got.loc["few", "guess"]) == (grouped.SLIP, grouped.GUESS)
    assert np.allclose(got[["slip", "guess"]], want[["slip", "guess"]], atol=2e-6) and got.slip.nunique() > 2


def test_no_concepts_log_is_brought_into_one_task(spark):
    """The fit's rounds read the sequences where they lie, also where nothing is broadcast for its size."""
    from gradeloom.operators import refresh

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        obs = grouped._OBS(spark, "/root/testdata/sf0.001")
        plan = refresh.traced(obs, obs.groupBy("concept_key").agg(F.avg("score").alias("slip"), F.avg("score").alias("guess")))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
