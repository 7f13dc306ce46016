"""Operators that SQL can't express: model fitting, density clustering, source structure and streams."""

from __future__ import annotations

import ast

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.plans.evidence import query
from gradeloom.runtime import ship, stored

#: Slip and guess multipliers by evidence source; clamps of the fitted parameters.
SOURCES = {"test": (0.85, 0.80), "repair": (1.00, 0.95), "static": (0.95, 1.05), "structural": (1.35, 1.45), "report": (1.50, 1.60), "manual": (0.60, 0.60)}
OTHER = (1.2, 1.2)
PRIOR, LEARN, SLIP, GUESS, ROUNDS, LEAST_SEQUENCES, CAP = 0.25, 0.18, 0.10, 0.20, 40, 4, 0.45


def fit_concept(rows: pd.DataFrame) -> pd.DataFrame:
    """Slip and guess of one concept by expectation-maximisation over its students' ordered observations.

    Students are stepped together: at step t all that have a t-th observation. The prior and the learning rate do not
    move, as each is its own fixed point.
    """
    rows = rows.sort_values(["student_id", "observed_at", "obs_id"], kind="stable")
    step = rows.groupby("student_id").cumcount().to_numpy()
    who = pd.factorize(rows["student_id"])[0]
    slip, guess = SLIP, GUESS
    if len(rows) and who.max() + 1 >= LEAST_SEQUENCES:
        right = rows["score"].clip(0, 1).to_numpy()
        spread = 2 - rows["confidence"].clip(0, 1).to_numpy()
        s_by, g_by = np.array([SOURCES.get(x, OTHER) for x in rows["source"]]).T
        waves = [np.flatnonzero(step == t) for t in range(step.max() + 1)]
        for _ in range(ROUNDS):
            s, g = np.minimum(CAP, slip * s_by * spread), np.minimum(CAP, guess * g_by * spread)
            known, duty = np.full(who.max() + 1, PRIOR), np.empty(len(rows))
            for at in waves:
                m = known[who[at]]
                p = np.clip(m * (1 - s[at]) + (1 - m) * g[at], 1e-6, 1 - 1e-6)
                duty[at] = np.clip(right[at] * m * (1 - s[at]) / p + (1 - right[at]) * m * s[at] / (1 - p), 0, 1)
                known[who[at]] = duty[at] + (1 - duty[at]) * LEARN
            slip = float(np.clip((duty * (1 - right)).sum() / duty.sum(), 0.001, 0.40)) if duty.sum() > 1e-9 else slip
            rest = 1 - duty
            guess = float(np.clip((rest * right).sum() / rest.sum(), 0.001, 0.40)) if rest.sum() > 1e-9 else guess
    return pd.DataFrame({"concept_key": [rows["concept_key"].iloc[0]], "prior": [PRIOR], "learn": [LEARN], "slip": [round(slip, 6)], "guess": [round(guess, 6)], "n": [len(rows)]})


#: Rounds of the fit between two writes of the parameters.
WRITTEN = 8


def sequences(observations: DataFrame) -> DataFrame:
    """concept_key, student_id and xs: each student's observations of a concept in order, as r (score), s and g (the factors of slip and guess)."""
    rate = lambda i: F.create_map(*[F.lit(x) for k, v in SOURCES.items() for x in (k, v[i])])
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    spread = 2 - unit("confidence")
    s, g = (F.coalesce(rate(i)[F.col("source")], F.lit(OTHER[i])) * spread for i in (0, 1))
    x = F.struct("observed_at", "obs_id", unit("score").alias("r"), s.alias("s"), g.alias("g"))
    return observations.groupBy("concept_key", "student_id").agg(F.array_sort(F.collect_list(x)).alias("xs"))


#: One student's expected counts under slip and guess: m follows the mastery; duty is the share known, miss its wrong
#: answers, rest the share not known, luck its right answers. A transform over one element names a value.
_EXPECTED = f"""aggregate(xs, named_struct('m', {PRIOR}D, 'duty', 0D, 'miss', 0D, 'rest', 0D, 'luck', 0D), (z, x) ->
  transform(transform(transform(array(named_struct('s', least({CAP}D, slip * x.s), 'g', least({CAP}D, guess * x.g))),
    y -> named_struct('s', y.s, 'p', greatest(1e-6D, least(1 - 1e-6D, z.m * (1 - y.s) + (1 - z.m) * y.g)))),
    y -> greatest(0D, least(1D, x.r * z.m * (1 - y.s) / y.p + (1 - x.r) * z.m * y.s / (1 - y.p)))),
    d -> named_struct('m', d + (1 - d) * {LEARN}D, 'duty', z.duty + d, 'miss', z.miss + d * (1 - x.r), 'rest', z.rest + (1 - d), 'luck', z.luck + (1 - d) * x.r))[0])"""


def fit_parameters(observations: DataFrame) -> DataFrame:
    """One row of fitted parameters per concept, by expectation-maximisation.

    The expectation is a fold over each student's ordered observations, the maximisation one sum per concept; a task holds
    one student's observations of one concept. Every WRITTEN rounds the parameters are written,
    and where the last round moved none, no later one would. Concepts of fewer than
    LEAST_SEQUENCES students keep the start. The parameters, a row a concept, are sent to all tasks: a join by concept would
    bring a concept's whole log into one. The prior and the learning rate do not move, as each is its own fixed point.
    """
    seq = stored(sequences(observations), "sequences")
    fit = seq.groupBy("concept_key").agg(F.count(F.lit(1)).alias("students"), F.sum(F.size("xs")).cast("long").alias("n")).withColumns({"slip": F.lit(SLIP), "guess": F.lit(GUESS)})
    fit = stored(fit, "fitted")
    clip = lambda c: F.greatest(F.lit(0.001), F.least(F.lit(0.40), c))
    for i in range(1, ROUNDS + 1):
        counts = seq.join(F.broadcast(fit.filter(F.col("students") >= LEAST_SEQUENCES)), "concept_key").select("concept_key", "students", "n", "slip", "guess", F.expr(_EXPECTED).alias("e"))
        sums = counts.groupBy("concept_key", "students", "n", "slip", "guess").agg(*[F.sum(f"e.{c}").alias(c) for c in ("duty", "miss", "rest", "luck")])
        slip = F.when(F.col("duty") > 1e-9, clip(F.col("miss") / F.col("duty"))).otherwise(F.col("slip"))
        guess = F.when(F.col("rest") > 1e-9, clip(F.col("luck") / F.col("rest"))).otherwise(F.col("guess"))
        fit = sums.select("concept_key", "students", "n", slip.alias("slip"), guess.alias("guess"), ((slip != F.col("slip")) | (guess != F.col("guess"))).alias("moved"))
        if i % WRITTEN == 0:
            fit = stored(fit, "fitted")
            if fit.filter("moved").isEmpty():
                break
    start = seq.groupBy("concept_key").agg(F.sum(F.size("xs")).cast("long").alias("n"))
    moved = fit.select("concept_key", F.col("slip").alias("s"), F.col("guess").alias("g"))
    return start.join(moved, "concept_key", "left").select("concept_key", F.lit(PRIOR).alias("prior"), F.lit(LEARN).alias("learn"), F.round(F.coalesce("s", F.lit(SLIP)), 6).alias("slip"), F.round(F.coalesce("g", F.lit(GUESS)), 6).alias("guess"), "n")


def spanning_tree(vectors: np.ndarray, least: int) -> np.ndarray:
    """Edges (weight, a, b) of the minimum spanning tree over mutual reachability by cosine distance."""
    unit = vectors / np.maximum(1e-12, np.linalg.norm(vectors, axis=1))[:, None]
    d = np.clip(1 - unit @ unit.T, 0, None)
    np.fill_diagonal(d, 0)
    core = np.sort(d, axis=1)[:, min(len(d) - 1, least)] if len(d) > 1 else np.zeros(len(d))
    reach = np.maximum(d, np.maximum(core[:, None], core[None, :]))
    best, parent, free, edges = reach[0].copy(), np.zeros(len(d), int), np.ones(len(d), bool), []
    free[0] = False
    while free.any():
        u = int(np.flatnonzero(free)[np.argmin(best[free])])
        edges.append((best[u], parent[u], u))
        free[u] = False
        closer = free & (reach[u] < best)
        best[closer], parent[closer] = reach[u][closer], u
    return np.array(sorted(edges)).reshape(-1, 3)


def cluster_group(rows: pd.DataFrame, least: int = 3) -> pd.DataFrame:
    """Density clusters of one assignment's vectors: edges longer than the mean by two deviations are cut, small parts are noise."""
    rows = rows.sort_values("vec_id")
    edges = spanning_tree(np.stack(rows["embedding"].to_numpy()).astype(float), least - 1)
    part = np.arange(len(rows))
    limit = edges[:, 0].mean() + 2 * edges[:, 0].std() if len(edges) else 0.0
    for w, a, b in edges:
        if w <= limit:
            part[part == part[int(b)]] = part[int(a)]
    size = np.bincount(part, minlength=len(rows))
    ids = rows["vec_id"].to_numpy()
    return pd.DataFrame({"vec_id": ids, "cluster": np.where(size[part] >= least, [ids[part == p].min() for p in part], -1), "size": size[part]})


def cluster_vectors(vectors: DataFrame) -> DataFrame:
    ship(vectors.sparkSession)
    return vectors.groupBy("label").applyInPandas(lambda rows: cluster_group(rows), "vec_id bigint, cluster bigint, size bigint")


def code_facts(source: str) -> dict:
    """Functions, loop depth, branches and recursion of a Python source; parsed is False where it has a syntax error."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return {"parsed": False, "functions": 0, "loop_depth": 0, "branches": 0, "recursive": False}

    def depth(node, now=0):
        now += isinstance(node, (ast.For, ast.While, ast.AsyncFor))
        return max([now, *(depth(c, now) for c in ast.iter_child_nodes(node))])

    defs = [n for n in ast.walk(tree) if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef))]
    calls_self = any(isinstance(c, ast.Call) and isinstance(c.func, ast.Name) and c.func.id == d.name for d in defs for c in ast.walk(d))
    return {"parsed": True, "functions": len(defs), "loop_depth": depth(tree), "branches": sum(isinstance(n, (ast.If, ast.IfExp)) for n in ast.walk(tree)), "recursive": calls_self}


def code_graph(sources: DataFrame, text: str = "source") -> DataFrame:
    """sources with the facts of their code."""
    ship(sources.sparkSession)

    @F.pandas_udf("parsed boolean, functions int, loop_depth int, branches int, recursive boolean")
    def facts(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([code_facts(x or "") for x in s], columns=["parsed", "functions", "loop_depth", "branches", "recursive"])

    return sources.withColumn("facts", facts(text)).select(*sources.columns, "facts.*")


_OBS = query("SELECT student_id, concept_key, score, confidence, source, observed_at, obs_id FROM obs")
#: Fixed sample of sources for the code graph: correct, recursive, unbuildable, empty.
_SOURCES = ["def f(n):\n    for i in range(n):\n        if i:\n            pass\n", "def f(n):\n    return 1 if n < 2 else n * f(n - 1)\n", "def f(:\n", ""]


def queries() -> dict:
    return {
        "k6_fit_parameters": lambda spark, d: fit_parameters(_OBS(spark, d)),
        "e1_code_graph": lambda spark, d: code_graph(spark.createDataFrame(list(enumerate(_SOURCES)), "id int, source string")),
    }
