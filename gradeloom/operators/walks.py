"""Walks down the prerequisite graph, per student: root gaps, recommendations, interventions, depth of gaps and the risk that reads it.

A walk names no concept twice, so it takes as many steps as there are concepts at most: a student's concepts are one row,
and a fold or a fixed number of steps goes down in place of a recursive query, whose rows Spark limits. What is asked of
the walks is the text of the SQL form, from where its recursion ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from gradeloom.plans import authoring, domain
from gradeloom.plans.evidence import query
from gradeloom.runtime import stored

#: Mastery from which a concept is no gap.
MASTERED = 0.7
_KNOWN = query("WITH " + domain._GAPS.split(",\nedge AS")[0] + " SELECT * FROM known")
_WEAK = query("WITH levels AS (SELECT student_id, count(*) AS tracked FROM mastery GROUP BY student_id)," + domain._RISK.split("\n")[4].rstrip(",") + " SELECT student_id, concept, tracked FROM weak")
_PREREQ = query("SELECT concept, prereq FROM prereq")


def _graph(edges: DataFrame) -> DataFrame:
    """One row: the course graph's edges as an array, and how many concepts they name."""
    return edges.agg(F.collect_list(F.struct("concept", "prereq")).alias("edges"), (F.count(F.lit(1)) + 1).cast("int").alias("most"))


def goals(known: DataFrame, edges: DataFrame) -> DataFrame:
    """student_id, start_, target, depth: from each gap down its weakest prerequisite that is a gap, of equal ones the first by name, as far as it goes.

    known has student_id, concept and m, one row each; edges has concept and prereq.
    """
    gaps = known.filter(F.col("m") < MASTERED).groupBy("student_id").agg(F.collect_list(F.struct("concept", "m")).alias("gaps"))
    one = gaps.crossJoin(F.broadcast(_graph(edges)))
    below = one.withColumn("ways", F.expr("array_sort(flatten(transform(gaps, g -> transform(filter(edges, e -> e.prereq = g.concept), e -> named_struct('concept', e.concept, 'm', g.m, 'prereq', e.prereq)))))"))
    starts = below.select("student_id", "ways", "most", F.explode("gaps.concept").alias("start_"))
    path = "aggregate(sequence(1, most), array(start_), (p, i) -> concat(p, filter(transform(slice(filter(ways, w -> w.concept = element_at(p, -1)), 1, 1), w -> w.prereq), c -> NOT array_contains(p, c))))"
    return starts.withColumn("path", F.expr(path)).select("student_id", "start_", F.element_at("path", -1).alias("target"), (F.size("path") - 1).alias("depth"))


def depths(gaps: DataFrame, edges: DataFrame) -> DataFrame:
    """student_id and depth: the concepts of the longest walk over gaps from any that is a start, no concept twice.

    gaps has student_id, concept and start, one row each. Each step lengthens all walks of a student by every way.
    """
    one = gaps.groupBy("student_id").agg(F.collect_list("concept").alias("gaps"), F.collect_list(F.when(F.col("start"), F.col("concept"))).alias("starts")).filter(F.size("starts") > 0).crossJoin(F.broadcast(_graph(edges)))
    ways = one.withColumn("edges", F.expr("filter(edges, e -> array_contains(gaps, e.prereq))"))
    further = "flatten(transform(z.walks, p -> transform(filter(edges, e -> e.concept = element_at(p, -1) AND NOT array_contains(p, e.prereq)), e -> concat(p, array(e.prereq)))))"
    fold = f"aggregate(sequence(1, most), named_struct('walks', transform(starts, c -> array(c)), 'depth', 0), (z, i) -> named_struct('walks', {further}, 'depth', if(size(z.walks) > 0, i, z.depth)), z -> z.depth)"
    return ways.select("student_id", F.expr(fold).alias("depth"))


def _goals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = stored(_KNOWN(spark, sf_dir), "known")
    return known, goals(known, _PREREQ(spark, sf_dir))


def g1_root_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap at the end of the walk from every gap, and its depth."""
    return _goals(spark, sf_dir)[1].select("student_id", "start_", "target", F.col("depth").cast("long").alias("depth"))


def recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gap that a walk ends at, with its priority by the deepest walk, of equal ones the first start by name."""
    known, goal = _goals(spark, sf_dir)
    return spark.sql("WITH " + domain._RECO[len(domain._GAPS) + 2 :].replace("goal g", "{goal} g").replace("known k", "{known} k") + " SELECT * FROM reco", goal=goal, known=known)


def g2_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do about every gap that a walk ends at."""
    return spark.sql(domain.SQL["g2_recommend"].removeprefix(f"WITH {domain._RECO} ").replace("FROM reco", "FROM {reco}"), reco=recommended(spark, sf_dir))


def g7_interventions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every student's first recommendation, weighed by the mean of the student's mastery."""
    mean = query("SELECT student_id, avg(m) AS mean FROM mastery GROUP BY student_id")(spark, sf_dir)
    best = recommended(spark, sf_dir).groupBy("student_id").agg(F.max("priority").alias("p"))
    return best.join(mean, "student_id").select("student_id", F.round(F.col("p") * (1.3 - F.col("mean")), 6).alias("priority"))


def g8_gap_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest walk over every student's gaps."""
    gaps = _KNOWN(spark, sf_dir).filter(F.col("m") < MASTERED).select("student_id", "concept", F.lit(True).alias("start"))
    return depths(gaps, _PREREQ(spark, sf_dir)).select("student_id", F.col("depth").cast("long").alias("depth"))


def _risk(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A risk query, whose gaps are those walks."""
    gaps = stored(depths(_WEAK(spark, sf_dir).withColumnRenamed("tracked", "start"), _PREREQ(spark, sf_dir)), "gaps")
    gaps.createOrReplaceTempView("walked_gaps")
    lines = [x for x in domain._RISK.split("\n") if not x.startswith(("weak AS", "deep(", "gaps AS"))]
    text = (domain.SQL | authoring.SQL)[name].replace(domain._RISK, "\n".join(lines).replace("LEFT JOIN gaps g", "LEFT JOIN walked_gaps g"))
    return query(text)(spark, sf_dir)


def r1_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every student's risk, with its factors and route."""
    return _risk(spark, sf_dir, "r1_risk")


def r2_course_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The risk of every customer; those without evidence have the prior's."""
    return _risk(spark, sf_dir, "r2_course_risk")


def r3_risk_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many students' risks break a rule."""
    return _risk(spark, sf_dir, "r3_risk_invariant")


def queries() -> dict:
    return {f.__name__: f for f in (g1_root_gap, g2_recommend, g7_interventions, g8_gap_depth, r1_risk, r2_course_risk, r3_risk_invariant)}
