"""Ranks without a window over all rows: counts by value, range-partitioned, and prefix sums in two levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gradeloom.operators.grouped import GUESS, PRIOR, SLIP
from gradeloom.operators.refresh import traced
from gradeloom.plans.evidence import query
from gradeloom.runtime import stored


def counted(rows: DataFrame, value: Column, by: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """by, value, n, the `sums`, and `before`: how many rows of the group have a smaller value.

    Rows are added up by value before they are shuffled; ranges of values are tasks, the sums of the ranges (as many as
    there are tasks for a group) are added up first, then each range's own. Null values are left out.
    """
    sums = sums or {}
    each = rows.select(*by, value.alias("value"), *[c.alias(n) for n, c in sums.items()]).filter("value is not null")
    values = each.groupBy(*by, "value").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    ranged = stored(values.repartitionByRange(*[F.col(c) for c in by], F.col("value")).withColumn("part", F.spark_partition_id()), "ranks")
    parts = ranged.groupBy(*by, "part").agg(F.sum("n").alias("all"))
    upto = (Window.unboundedPreceding, -1)
    ahead = parts.select(*by, "part", F.coalesce(F.sum("all").over(Window.partitionBy(*by).orderBy("part").rowsBetween(*upto)), F.lit(0)).alias("ahead"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy(*by, "part").orderBy("value").rowsBetween(*upto)), F.lit(0))
    placed = ranged.withColumn("own", own)
    return beside(placed, ahead, [*by, "part"]).select(*by, "value", "n", *sums, (F.col("own") + F.col("ahead")).cast("long").alias("before"))


def beside(rows: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """rows with the other columns of `more`, which has one row a group; null groups meet null groups."""
    named = more.select(*[F.col(c).alias(f"{c}_of") if c in by else F.col(c) for c in more.columns])
    return rows.join(named, [F.col(c).eqNullSafe(F.col(f"{c}_of")) for c in by]).drop(*[f"{c}_of" for c in by])


def auc(rows: DataFrame, score: Column, positive: Column, by: list[str]) -> DataFrame:
    """by, auc, positives, negatives: the chance that a positive row scores above a negative one, ties counting half; null without both."""
    ranks = counted(rows, score, by, {"pos": F.when(positive, 1).otherwise(0)})
    total = ranks.groupBy(*by).agg(F.sum("pos").alias("p"), F.sum("n").alias("n"), F.sum(F.col("pos") * (F.col("before") + (F.col("n") + 1) / 2.0)).alias("ranks"))
    p, q = F.col("p"), F.col("n") - F.col("p")
    return total.select(*by, F.when((p > 0) & (q > 0), (F.col("ranks") - p * (p + 1) / 2.0) / (p * 1.0 * q)).alias("auc"), p.cast("long").alias("positives"), q.cast("long").alias("negatives"))


def nearest_rank(rows: DataFrame, value: Column, by: list[str], shares: dict[str, float]) -> DataFrame:
    """by and for each share the value at place floor(share n), counted from 0, of the group's values in order."""
    if not by:
        return nearest_rank(rows.withColumn("all_rows", F.lit(0)), value, ["all_rows"], shares).drop("all_rows")
    ranks = counted(rows, value, by)
    size = ranks.groupBy(*by).agg(F.sum("n").alias("all"))
    both = beside(ranks, size, by)
    at = {name: F.floor(F.col("all") * share) for name, share in shares.items()}
    return both.groupBy(*by).agg(*[F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col("n")), F.col("value"))).alias(name) for name, k in at.items()])


_VERDICT = query("SELECT run_id, assignment_id, state, total FROM verdict")
_OBS = query("SELECT student_id, concept_key, score, confidence, source, observed_at, obs_id FROM obs")
#: The held-out last assignment begins here; from this score on an observation counts as passed.
HELD_OUT, PASSED = "TIMESTAMP '2024-01-22 00:00:00'", 0.5


def a7_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """95th percentile and median of each assignment's totals."""
    found = nearest_rank(_VERDICT(spark, sf_dir), F.col("total"), ["assignment_id"], {"p95": 0.95, "median": 0.5})
    return found.select("assignment_id", F.round("p95", 6).alias("p95"), F.round("median", 6).alias("median"))


def k7_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well totals tell released runs from others, by assignment."""
    return auc(_VERDICT(spark, sf_dir), F.col("total"), F.col("state") == "released", ["assignment_id"]).select("assignment_id", F.round("auc", 6).alias("auc"))


def j16_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well totals tell released runs from others, over all."""
    return auc(_VERDICT(spark, sf_dir), F.col("total"), F.col("state") == "released", []).select(F.round("auc", 6).alias("auc"))


def predictive_validity(observations: DataFrame, since: str, threshold: float = PASSED) -> DataFrame:
    """auc, positives, negatives: traced mastery before `since` against each later observation of the concept."""
    early = observations.filter(f"observed_at < {since}")
    start = early.select("concept_key").distinct().withColumns({"slip": F.lit(SLIP), "guess": F.lit(GUESS)})
    states = traced(early, start).select("student_id", "concept_key", "m")
    later = observations.filter(f"observed_at >= {since}").join(states, ["student_id", "concept_key"])
    return auc(later, F.round("m", 9), F.col("score") >= threshold, [])


def k8_holdout_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of mastery, traced without the last assignment, against that assignment's observations."""
    return predictive_validity(_OBS(spark, sf_dir), HELD_OUT).select(F.round("auc", 4).alias("auc"), "positives", "negatives")


def queries() -> dict:
    return {f.__name__: f for f in (a7_nearest_rank, k7_auc, j16_auc, k8_holdout_validity)}


def oracle_sql(steps: str, adjusted: str) -> dict[str, str]:
    """The hold-out by a walk along each sequence and by counting pairs; `adjusted` and `steps` are the fold's tables."""
    early = adjusted.replace("FROM obs o JOIN", f"FROM (SELECT * FROM obs WHERE observed_at < {HELD_OUT}) o JOIN")
    return {
        "k8_holdout_validity": f"""WITH {early}, {steps},
pair AS (SELECT round(m, 9) AS m, o.score >= {PASSED}e0 AS y FROM obs o JOIN traced t ON t.student_id = o.student_id AND t.concept_key = o.concept_key WHERE o.observed_at >= {HELD_OUT}),
side AS (SELECT m, count_if(y) AS p, count_if(NOT y) AS q FROM pair GROUP BY m)
SELECT round(sum(CASE WHEN x.m > z.m THEN x.p * z.q WHEN x.m = z.m THEN x.p * z.q / 2e0 ELSE 0e0 END) / (sum(x.p * z.q) * 1e0), 4) AS auc, (SELECT CAST(sum(p) AS BIGINT) FROM side) AS positives, (SELECT CAST(sum(q) AS BIGINT) FROM side) AS negatives FROM side x CROSS JOIN side z"""
    }
