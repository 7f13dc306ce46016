"""The course refresh as one job graph, the ridge fit, and writing attainment and models."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.operators.clusters import condensed_clusters
from gradeloom.operators.grouped import CAP, GUESS, LEARN, OTHER, PRIOR, SLIP, SOURCES, fit_parameters
from gradeloom.plans.evidence import query
from gradeloom.runtime import run_folder, stored

_OBS = query("SELECT student_id, concept_key, score, confidence, source, observed_at, obs_id FROM obs")
_PREREQ = query("SELECT concept, prereq FROM prereq")
#: Factor per step of propagation, least adjustment, floor of an estimate, furthest prerequisite.
FACTOR, LEAST_ADJUSTMENT, FLOOR, FURTHEST = 0.45, 0.01, 0.02, 3


def traced(observations: DataFrame, fitted: DataFrame) -> DataFrame:
    """student_id, concept_key, m, n: each student's observations folded in order with their concept's fitted slip and guess.

    fitted has one row per concept. An array holds one student's observations of one concept.
    """
    rate = lambda i: F.create_map(*[F.lit(x) for k, v in SOURCES.items() for x in (k, v[i])])
    spread = 2 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), "confidence"))
    slip, guess = (F.least(F.lit(CAP), F.col(c) * F.coalesce(rate(i)[F.col("source")], F.lit(OTHER[i])) * spread) for i, c in enumerate(("slip", "guess")))
    steps = observations.join(F.broadcast(fitted.select("concept_key", "slip", "guess")), "concept_key").select("student_id", "concept_key", F.struct("observed_at", "obs_id", "score", slip.alias("s"), guess.alias("g")).alias("x"))

    def step(m, x):
        right = m * (1 - x.s) / (m * (1 - x.s) + (1 - m) * x.g)
        wrong = m * x.s / (m * x.s + (1 - m) * (1 - x.g))
        after = x.score * right + (1 - x.score) * wrong
        return after + (1 - after) * LEARN

    seq = steps.groupBy("student_id", "concept_key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return seq.select("student_id", "concept_key", F.aggregate("xs", F.lit(PRIOR), step).alias("m"), F.size("xs").cast("long").alias("n"))


def prerequisite_order(edges: DataFrame) -> list[tuple[str, str, int]]:
    """(concept, prerequisite, ordinal from 1): breadth first, nearest first, by name within a level. edges is the course graph."""
    below: dict[str, list[str]] = {}
    for concept, prereq in sorted((r[0], r[1]) for r in edges.collect()):
        below.setdefault(concept, []).append(prereq)
    out = []
    for concept in below:
        seen, wave, found = {concept}, below[concept], []
        for _ in range(FURTHEST):
            wave = [x for x in dict.fromkeys(wave) if x not in seen]
            seen |= set(wave)
            found += wave
            wave = [y for x in wave for y in below.get(x, [])]
        out += [(concept, x, i) for i, x in enumerate(found, 1)]
    return out


def propagated(states: DataFrame, observations: DataFrame, edges: DataFrame) -> DataFrame:
    """states, and the prerequisites they imply, after repeated failures (two or more scores under a half) lowered them.

    A floor under a falling estimate gives the same end in any order of the failures, so the adjustments add up; the same
    holds for the uncertainty and its ceiling.
    """
    spark = states.sparkSession
    order = spark.createDataFrame(prerequisite_order(edges), "concept_key string, prereq string, ord int")
    fails = observations.filter("score < 0.5").groupBy("student_id", "concept_key").agg(F.avg((1 - F.col("score")) * F.col("confidence")).alias("strength"), F.count(F.lit(1)).alias("k")).filter("k >= 2")
    own = states.select("student_id", F.col("concept_key").alias("prereq"), "n")
    decay = F.pow(F.lit(FACTOR), F.col("ord"))
    moves = fails.join(order, "concept_key").join(own, ["student_id", "prereq"], "left")
    moves = moves.select("student_id", F.col("prereq").alias("concept_key"), (F.col("strength") * decay / (1 + F.coalesce("n", F.lit(0)))).alias("adj"), decay.alias("decay")).filter(F.col("adj") >= LEAST_ADJUSTMENT)
    total = moves.groupBy("student_id", "concept_key").agg(F.sum("adj").alias("adj"), F.sum("decay").alias("decay"))
    u = 0.65 / F.sqrt(1.0 + F.col("n")) + 0.35 * (1 - 2 * F.abs(F.col("m") - 0.5))
    start = states.withColumn("u", F.least(F.lit(1.0), u))
    joined = start.join(total, ["student_id", "concept_key"], "full")
    m, u = F.coalesce("m", F.lit(PRIOR)), F.coalesce("u", F.lit(1.0))
    return joined.select(
        "student_id", "concept_key",
        F.when(F.col("adj").isNull(), m).otherwise(F.greatest(F.lit(FLOOR), m - F.col("adj"))).alias("estimate"),
        F.least(F.lit(1.0), u + 0.10 * F.coalesce("decay", F.lit(0.0))).alias("uncertainty"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("m").isNull().alias("inferred"),
    )


def recomputed_mastery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fit, trace and propagate."""
    obs = _OBS(spark, sf_dir)
    return propagated(stored(traced(obs, fit_parameters(obs)), "traced"), obs, _PREREQ(spark, sf_dir))


def refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """step, made: the rows that each step of the refresh made. Mastery is written once and read by the steps after it."""
    mastery = stored(recomputed_mastery(spark, sf_dir), "mastery")
    items = query("SELECT item_key, assignment_id, avg(score) AS d FROM item GROUP BY item_key, assignment_id")(spark, sf_dir)
    clusters = condensed_clusters(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding")).filter("cluster >= 0").select("cluster").distinct()
    mean = mastery.groupBy("student_id").agg(F.avg("estimate").alias("mean"))
    risk = mean.withColumn("flagged", 1 / (1 + F.exp(-6 * ((1 - F.col("mean")) * 0.30 - 0.32))) >= 0.55)
    steps = [("mastery", mastery), ("items", items), ("clusters", clusters), ("risk", risk), ("flagged", risk.filter("flagged"))]
    counts = [df.agg(F.count(F.lit(1)).alias("made")).select(F.lit(name).alias("step"), "made") for name, df in steps]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3]).unionByName(counts[4])


# Prior weights of the confidence model's features.
PRIOR_WEIGHTS = {"bias": 0.10, "signal_agreement": 0.42, "evidence_completeness": 0.20, "boundary_distance": 0.12, "test_pass_rate": 0.06, "test_coverage": 0.14, "repair_distance_norm": -0.18, "similarity_max": -0.22, "entailment_contradiction_rate": -0.26, "stage_error": -0.35, "static_check_rate": 0.05, "has_executable_oracle": 0.10}
LEAST_EXAMPLES = 8


def solved(xx: np.ndarray, xy: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray | None:
    """Weights of the ridge system shrunk towards the prior; None where it is singular."""
    try:
        return np.linalg.solve(xx + ridge * np.eye(len(prior)), xy + ridge * prior)
    except np.linalg.LinAlgError:
        return None


def ridge_fit(examples: DataFrame, target: str = "target", prior: dict[str, float] = PRIOR_WEIGHTS, ridge: float = 1.0) -> pd.DataFrame:
    """feature, weight, n. The sums of products are one aggregation; the solve is as wide as the features.

    Features and target are held to 0..1, null features are 0; rows without a target do not count. Fewer than
    LEAST_EXAMPLES rows leave the prior.
    """
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    names = list(prior)
    cols = [F.lit(1.0) if n == "bias" else unit(F.coalesce(F.col(n), F.lit(0.0))) for n in names]
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    y = unit(F.col(target))
    row = examples.filter(F.col(target).isNotNull()).agg(F.count(F.lit(1)), *[F.sum(cols[i] * cols[j]) for i, j in pairs], *[F.sum(c * y) for c in cols]).first()
    start = np.array([prior[n] for n in names])
    weights = start
    if row[0] >= LEAST_EXAMPLES:
        xx = np.zeros((len(names), len(names)))
        for (i, j), v in zip(pairs, row[1:], strict=False):
            xx[i, j] = xx[j, i] = v
        got = solved(xx, np.array(row[1 + len(pairs) :]), start, ridge)
        weights = start if got is None else got
    return pd.DataFrame({"feature": names, "weight": weights, "n": row[0]})


def confidence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model fitted on every item's signals; its target is the agreement of item and run."""
    rows = query(
        "SELECT 1e0 - abs(i.score - m.total) AS target, i.score AS signal_agreement, i.weight / 50e0 AS evidence_completeness, abs(m.total - 0.4e0) AS boundary_distance, CASE WHEN i.score >= 0.999e0 THEN 1e0 ELSE 0e0 END AS test_pass_rate, CASE WHEN i.flag = 'N' THEN 1e0 ELSE 0e0 END AS test_coverage, CASE WHEN i.flag = 'R' THEN 0.2e0 ELSE 0e0 END AS repair_distance_norm, 0e0 AS similarity_max, 0e0 AS entailment_contradiction_rate, 0e0 AS stage_error, i.score AS static_check_rate, 1e0 AS has_executable_oracle FROM item i JOIN mark m ON m.run_id = i.run_id"
    )(spark, sf_dir)
    model = ridge_fit(rows)
    return spark.createDataFrame([(str(f), round(float(w), 6), int(n)) for f, w, n in model.itertuples(index=False)], "feature string, weight double, n bigint")


def saved_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence model written as JSON to the shared folder and read back."""
    path = run_folder(spark, "model")
    model = confidence_model(spark, sf_dir)
    model.coalesce(1).write.json(path)
    return spark.read.schema(model.schema).json(path)


def exported_attainment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attainment per outcome, written as quoted CSV with a header and read back."""
    path = run_folder(spark, "attainment")
    rows = query(ATTAINMENT)(spark, sf_dir)
    rows.write.csv(path, header=True, quoteAll=True, escape='"')
    return spark.read.schema(rows.schema).csv(path, header=True, escape='"')


ATTAINMENT = "SELECT c.outcome, round(avg(m.m), 6) AS mean, CAST(count_if(m.m >= 0.6e0) AS BIGINT) AS attaining, count(*) AS cohort FROM mastery m JOIN concepts c ON c.concept = m.concept_key GROUP BY c.outcome"


def queries() -> dict:
    return {
        "k9_recomputed_mastery": recomputed_mastery,
        "z1_refresh": refreshed,
        "l2_confidence_model": confidence_model,
        "snk11_model_json": saved_model,
        "snk9_attainment_csv": exported_attainment,
    }
