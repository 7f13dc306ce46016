"""From evidence to a verdict: signals of an item, their score, agreement and confidence, the gate's conditions, the review queue and what is observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators.refresh import PRIOR_WEIGHTS
from gradeloom.plans.evidence import query

# How much each source is worth, thresholds of the gate, weight of each reason in the review queue.
RELIABILITY = {"test": 1.00, "static": 0.85, "static_advisory": 0.45, "structural": 0.55, "repair": 0.70, "report": 0.35, "manual": 1.00}
NOTHING = 0.30
RELEASE, SIMILAR, BOUNDARY, EPSILON, PENALTY, SHARE, AGREED, CONTESTED = 0.55, 0.62, 0.40, 0.02, 0.20, 0.15, 0.5, 0.8
REASON_WEIGHT = {"integrity_flag": 1.0, "report_contradiction": 0.9, "signal_conflict": 0.85, "stage_error": 0.8, "grade_boundary": 0.6, "repair_material": 0.5, "low_confidence": 0.45, "appeal": 1.0}
OTHER_REASON = 0.3
#: Sources that answer what a rubric item declared under another name.
SAME_AS = {"repair": "test", "static_advisory": "static"}


def _signal(source: Column, score: Column, corroborating: bool = True) -> Column:
    rate = F.create_map(*[F.lit(x) for kv in RELIABILITY.items() for x in kv])
    return F.struct(source.alias("source"), score.cast("double").alias("score"), rate[source].alias("reliability"), F.lit(corroborating).alias("corroborating"))


def weighted(signals: str | Column) -> Column:
    """The signals' scores weighted by reliability; 0 without any."""
    s = F.col(signals) if isinstance(signals, str) else signals
    total = F.aggregate(s, F.lit(0.0), lambda z, x: z + x.reliability)
    return F.when(total > 0, F.aggregate(s, F.lit(0.0), lambda z, x: z + x.score * x.reliability) / total).otherwise(0.0)


def assembled(items: DataFrame) -> DataFrame:
    """items with `signals`, an array of source, score, reliability and corroborating.

    items has has_tests, withheld, oracle_exists, tests_ran, passed_share, on_repaired, static_passed (null: no check),
    advisory, structural, declared (an array of checks), covered and coverage (null: no report). Tests that ran speak by
    the weight that passed, as `repair` where the source was repaired; tests that could not run though an oracle exists
    are a failed test, unless they were withheld. Structure speaks only where it raises the item, and only for items whose
    evidence is behaviour. An item without any signal gets one of zero, worth little.
    """
    none = F.lit(None)
    test = F.when(F.col("tests_ran"), _signal(F.when(F.col("on_repaired"), "repair").otherwise("test"), F.col("passed_share"))).when(F.col("has_tests") & ~F.col("withheld") & F.col("oracle_exists"), _signal(F.lit("test"), F.lit(0.0))).otherwise(none)
    static = F.when(F.col("static_passed").isNotNull(), _signal(F.when(F.col("advisory"), "static_advisory").otherwise("static"), F.col("static_passed").cast("int"))).otherwise(none)
    report = F.when(F.array_contains("declared", "report") & F.col("coverage").isNotNull(), _signal(F.lit("report"), F.when(F.col("covered"), 1.0).otherwise(F.col("coverage")))).otherwise(none)
    known = items.withColumn("known_", F.array_compact(F.array(test, static)))
    behaviour = F.array_contains("declared", "structural") | F.col("has_tests")
    shape = F.when(behaviour & (F.col("structural") > weighted("known_")), _signal(F.lit("structural"), F.col("structural"), False)).otherwise(none)
    some = known.withColumn("signals", F.concat("known_", F.array_compact(F.array(shape, report)))).drop("known_")
    zero = F.array(F.struct(F.lit("structural").alias("source"), F.lit(0.0).alias("score"), F.lit(NOTHING).alias("reliability"), F.lit(True).alias("corroborating")))
    return some.withColumn("signals", F.when(F.size("signals") == 0, zero).otherwise(F.col("signals")))


def agreement(signals: str) -> Column:
    """1 less twice the mean deviation of the signals that may vote (all, if none may); of a single one, by its reliability."""
    voting = F.filter(signals, lambda s: s.corroborating)
    voting = F.when(F.size(voting) > 0, voting).otherwise(F.col(signals))
    total = F.aggregate(voting, F.lit(0.0), lambda z, x: z + x.reliability)
    middle = F.aggregate(voting, F.lit(0.0), lambda z, x: z + x.score * x.reliability) / total
    off = F.aggregate(voting, F.lit(0.0), lambda z, x: z + F.abs(x.score - middle) * x.reliability) / total
    return F.when(F.size(voting) == 0, 0.0).when(F.size(voting) == 1, 0.35 + 0.5 * F.element_at(voting, 1).reliability).otherwise(F.greatest(F.lit(0.0), 1 - 2 * off))


def confidence(features: dict[str, Column], weights: dict[str, float] = PRIOR_WEIGHTS) -> Column:
    """The chance that a review would keep the score: features held to 0..1, missing ones 0, squashed gently."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c.cast("double"), F.lit(0.0))))
    total = F.lit(weights.get("bias", 0.0))
    for name, c in features.items():
        total = total + weights.get(name, 0.0) * unit(c)
    return 1 / (1 + F.exp(-4 * (total - 0.5)))


def _four(c: Column) -> Column:
    """Four places; what is half way but for the last bits goes up, so that it doesn't hang on the order of a sum."""
    return F.round(c + 1e-9, 4)


def item_features(items: DataFrame) -> DataFrame:
    """items with raw_ (the score), completeness and the confidence model's features as columns of their own names."""
    same = F.create_map(*[F.lit(x) for kv in SAME_AS.items() for x in kv])
    made = F.array_distinct(F.transform("signals", lambda s: F.coalesce(same[s.source], s.source)))
    declared = F.array_distinct("declared")
    full = F.when(F.size(declared) > 0, F.size(F.array_intersect(made, declared)) / F.size(declared)).otherwise((F.size(made) > 0).cast("double"))
    one = items.withColumns({"raw_": weighted("signals"), "signal_agreement": agreement("signals"), "completeness": full})
    return one.withColumns({
        "evidence_completeness": F.col("completeness"), "boundary_distance": F.least(F.lit(1.0), F.abs(F.col("raw_") - BOUNDARY) / (EPSILON * 5)), "test_coverage": F.array_contains(made, "test").cast("double"),
        "repair_distance_norm": F.least(F.lit(1.0), F.col("repair_distance") / 5.0), "entailment_contradiction_rate": F.col("contradiction_rate"), "stage_error": F.coalesce(F.col("stage_error"), F.lit(False)), "has_executable_oracle": F.col("oracle_exists"),
    })


def judged(items: DataFrame) -> DataFrame:
    """items with score, agreement, completeness and confidence; besides `signals` and `declared` the features' own columns."""
    known = item_features(items)
    features = {n: F.col(n) for n in PRIOR_WEIGHTS if n != "bias"}
    return known.withColumns({"score": _four(F.col("raw_")), "agreement": _four(F.col("signal_agreement")), "confidence": _four(confidence(features))}).drop("raw_", *(c for c in features if c not in items.columns))


def decided(items: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, state, total, confidence, integrity_flag, reasons and priority of each run.

    items has run_id, item_key, weight, score, agreement and confidence; runs has run_id, similarity_max, contradictions,
    syntax_penalty and stage_error, null facts count as none. `reasons` holds every condition met, in order of name, each
    with the value that met it and the limit. A run without items has a total and a confidence of 0. The priority is what a
    human minute is worth: the gravest reason, the weight in doubt and the confidence that is missing.
    """
    # a run's items in order of their keys: thresholds hang on the last bits of a sum, which must not hang on partitions
    part = items.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("item_key", *[F.col(c).cast("double").alias(c) for c in ("weight", "score", "agreement", "confidence")]))).alias("of_"))
    added = lambda term: F.aggregate("of_", F.lit(0.0), lambda z, x: z + F.coalesce(term(x), F.lit(0.0)))
    # weights add up to one at least where they are nothing
    part = part.withColumn("w", added(lambda x: x.weight)).withColumn("w", F.when(F.col("w") == 0, 1.0).otherwise(F.col("w")))
    share = lambda x: x.weight / F.col("w")
    facts = part.select(
        "run_id", added(lambda x: x.score * share(x)).alias("raw"), added(lambda x: x.confidence * share(x)).alias("confidence"),
        F.array_min(F.transform(F.filter("of_", lambda x: (share(x) >= SHARE) & (x.agreement < AGREED)), lambda x: x.agreement)).alias("conflict"),
        added(lambda x: F.when(x.confidence < CONTESTED, share(x) * (1 - x.confidence)).otherwise(0.0)).alias("contested"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    run = runs.join(facts, "run_id", "left").withColumn("confidence", zero("confidence")).withColumn("total", F.greatest(F.lit(0.0), zero("raw") * (1 - zero("syntax_penalty"))))
    rule = lambda name, met, value, limit: F.when(met, F.struct(F.lit(name).alias("reason"), value.cast("double").alias("value"), F.lit(limit).cast("double").alias("limit")))
    reasons = F.array_compact(F.array(
        rule("grade_boundary", F.abs(F.col("total") - BOUNDARY) <= EPSILON, F.col("total"), BOUNDARY),
        rule("integrity_flag", zero("similarity_max") >= SIMILAR, zero("similarity_max"), SIMILAR),
        rule("low_confidence", F.col("confidence") < RELEASE, F.col("confidence"), RELEASE),
        rule("repair_material", zero("syntax_penalty") >= PENALTY, zero("syntax_penalty"), PENALTY),
        rule("report_contradiction", zero("contradictions") > 0, zero("contradictions"), 0),
        rule("signal_conflict", F.col("conflict").isNotNull(), F.col("conflict"), AGREED),
        rule("stage_error", F.coalesce(F.col("stage_error"), F.lit(False)), F.lit(1), 0),
    ))
    grave = F.create_map(*[F.lit(x) for kv in REASON_WEIGHT.items() for x in kv])
    severity = F.aggregate("reasons", F.lit(0.0), lambda z, r: F.greatest(z, F.coalesce(grave[r.reason], F.lit(OTHER_REASON))))
    out = run.withColumn("reasons", reasons).withColumn("severity", severity)
    return out.select(
        "run_id", F.when(F.size("reasons") > 0, "escalated").otherwise("released").alias("state"), "total", "confidence", (zero("similarity_max") >= SIMILAR).alias("integrity_flag"), "reasons",
        _four(F.col("severity") * (0.5 + zero("contested")) * (0.5 + F.greatest(F.lit(0.0), 1 - F.col("confidence")))).alias("priority"),
    )


def observed(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """run_id, item_key, concept, score, confidence and source of what released and overridden runs show.

    The source is the item's most reliable one, of equal ones the first. items has `concepts`, an array.
    """
    most = F.array_max(F.transform("signals", lambda x: x.reliability))
    best = F.coalesce(F.element_at(F.filter("signals", lambda x: x.reliability == most), 1).source, F.lit("none"))
    shown = items.join(decisions.filter(F.col("state").isin("released", "overridden")).select("run_id"), "run_id")
    return shown.select("run_id", "item_key", F.explode("concepts").alias("concept"), "score", "confidence", best.alias("source"))


#: Facts of an item and its run as read from the tables: a returned line was repaired, an accepted one could not run, every
#: second item has a static check and every fourth an advisory one, every third is also declared for the report.
ITEM_FACTS = """SELECT row_number() OVER (PARTITION BY run_id, item_key ORDER BY weight, score, flag, submitted_at, i.concept) AS nth, run_id, item_key, i.concept, weight, TRUE AS has_tests, item_key % 7 = 0 AS withheld, TRUE AS oracle_exists, NOT (flag = 'A' AND item_key % 2 = 0) AS tests_ran, score AS passed_share, flag = 'R' AS on_repaired,
  CASE WHEN item_key % 2 = 0 THEN weight >= 25e0 END AS static_passed, item_key % 4 = 0 AS advisory, 0.1e0 * (weight - 10e0 * floor(weight / 10e0)) AS structural, item_key % 3 = 0 AS to_report, weight >= 40e0 AS covered, CASE WHEN item_key % 6 <> 3 THEN weight / 50e0 END AS coverage FROM item i"""
RUN_FACTS = """SELECT r.run_id, (r.price - 100e0 * floor(r.price / 100e0)) / 130e0 AS similarity_max, CASE WHEN r.run_id % 9 = 0 THEN 2 ELSE 0 END AS contradictions, least(0.25e0, 0.05e0 * k.repaired) AS syntax_penalty, k.repaired AS repair_distance, r.run_id % 31 = 5 AS stage_error,
  k.rate AS test_pass_rate, CASE WHEN r.run_id % 9 = 0 THEN 0.4e0 ELSE 0e0 END AS contradiction_rate FROM run r JOIN (SELECT run_id, count_if(flag = 'R') AS repaired, avg(CASE WHEN score >= 0.999e0 THEN 1e0 ELSE 0e0 END) AS rate FROM item GROUP BY run_id) AS k ON k.run_id = r.run_id"""


def item_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the tables with signals and the facts of their runs."""
    declared = F.when(F.col("to_report"), F.array(F.lit("test"), F.lit("report"))).otherwise(F.array(F.lit("test"), F.lit("static")))
    items = assembled(query(ITEM_FACTS)(spark, sf_dir).withColumn("declared", declared).withColumn("concepts", F.array("concept")))
    runs = query(RUN_FACTS)(spark, sf_dir).select("run_id", "similarity_max", "repair_distance", "stage_error", "test_pass_rate", "contradiction_rate")
    return items.join(runs, "run_id").withColumn("static_check_rate", F.col("static_passed").cast("int"))


def item_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of the tables with signals, score, agreement and confidence."""
    return judged(item_facts(spark, sf_dir))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(item_verdicts(spark, sf_dir), query(RUN_FACTS)(spark, sf_dir))


def e10_signal_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item's signals as text, its score, agreement, completeness and confidence."""
    told = F.array_join(F.transform("signals", lambda s: F.concat(s.source, F.lit("="), F.round(s.score + 1e-9, 2).cast("string"))), " ")
    return item_verdicts(spark, sf_dir).select("run_id", "item_key", "weight", told.alias("signals"), "score", "agreement", F.round("completeness", 4).alias("completeness"), "confidence")


def e11_gate_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run's state with all reasons in order and their values."""
    told = F.array_join(F.transform("reasons", lambda r: F.concat(r.reason, F.lit(":"), F.round(r.value + 1e-9, 3).cast("string"))), " ")
    return decisions(spark, sf_dir).select("run_id", "state", _four(F.col("total")).alias("total"), _four(F.col("confidence")).alias("confidence"), "integrity_flag", told.alias("reasons"))


def e12_emit_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of released runs, one for each concept of an item."""
    return observed(item_verdicts(spark, sf_dir), decisions(spark, sf_dir)).select("run_id", "item_key", "concept", "score", "confidence", "source")


def ma9_review_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escalated runs with what a human minute on them is worth."""
    return decisions(spark, sf_dir).filter("state = 'escalated'").select("run_id", "priority")


def queries() -> dict:
    return {f.__name__: f for f in (e10_signal_assembly, e11_gate_routing, e12_emit_observations, ma9_review_priority)}


#: The same rules over one row a signal.
_SIGNALS = f"""fact AS ({ITEM_FACTS}), runfact AS ({RUN_FACTS}),
worth(source, r) AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v}e0)" for k, v in RELIABILITY.items())}) AS t(source, r)),
first_ AS (SELECT run_id, item_key, weight, nth, 1 AS o, CASE WHEN tests_ran AND on_repaired THEN 'repair' ELSE 'test' END AS source, CASE WHEN tests_ran THEN passed_share ELSE 0e0 END AS score FROM fact WHERE tests_ran OR NOT withheld
  UNION ALL SELECT run_id, item_key, weight, nth, 2, CASE WHEN advisory THEN 'static_advisory' ELSE 'static' END, CASE WHEN static_passed THEN 1e0 ELSE 0e0 END FROM fact WHERE static_passed IS NOT NULL),
so_far AS (SELECT f.run_id, f.item_key, f.weight, f.nth, f.structural, coalesce(sum(x.score * w.r) / sum(w.r), 0e0) AS s FROM fact f LEFT JOIN (first_ x JOIN worth w ON w.source = x.source) ON x.run_id = f.run_id AND x.item_key = f.item_key AND x.nth = f.nth GROUP BY f.run_id, f.item_key, f.weight, f.nth, f.structural),
sig0 AS (SELECT x.run_id, x.item_key, x.weight, x.nth, x.o, x.source, x.score, w.r, TRUE AS votes FROM (SELECT * FROM first_ UNION ALL SELECT run_id, item_key, weight, nth, 4, 'report', CASE WHEN covered THEN 1e0 ELSE coverage END FROM fact WHERE to_report AND coverage IS NOT NULL) AS x JOIN worth w ON w.source = x.source
  UNION ALL SELECT run_id, item_key, weight, nth, 3, 'structural', structural, {RELIABILITY["structural"]}e0, FALSE FROM so_far WHERE structural > s),
sig AS MATERIALIZED (SELECT * FROM sig0 UNION ALL SELECT run_id, item_key, weight, nth, 1, 'structural', 0e0, {NOTHING}e0, TRUE FROM fact f WHERE NOT EXISTS (SELECT 1 FROM sig0 s WHERE s.run_id = f.run_id AND s.item_key = f.item_key AND s.nth = f.nth)),
voter AS (SELECT * FROM (SELECT *, bool_or(votes) OVER (PARTITION BY run_id, item_key, weight, nth) AS any_ FROM sig) AS t WHERE votes OR NOT any_),
mean_ AS (SELECT run_id, item_key, weight, nth, sum(score * r) / sum(r) AS m, sum(r) AS rr, count(*) AS k, max(r) AS one FROM voter GROUP BY run_id, item_key, weight, nth),
agree AS (SELECT m.run_id, m.item_key, m.weight, m.nth, CASE WHEN max(m.k) = 1 THEN 0.35e0 + 0.5e0 * max(m.one) ELSE greatest(0e0, 1e0 - 2e0 * sum(abs(v.score - m.m) * v.r) / max(m.rr)) END AS a FROM voter v JOIN mean_ m ON m.run_id = v.run_id AND m.item_key = v.item_key AND m.nth = v.nth GROUP BY m.run_id, m.item_key, m.weight, m.nth),
scored AS (SELECT run_id, item_key, weight, nth, sum(score * r) / sum(r) AS s, bool_or(source IN ('test', 'repair')) AS t, bool_or(source IN ('static', 'static_advisory')) AS st, bool_or(source = 'report') AS rp, arg_min(source, (-r, o)) AS top, string_agg(source || '=' || CAST(round(score + 1e-9, 2) AS VARCHAR), ' ' ORDER BY o) AS told FROM sig GROUP BY run_id, item_key, weight, nth),
full_ AS (SELECT s.*, f.concept, f.static_passed, a.a, (CASE WHEN t THEN 1 ELSE 0 END + CASE WHEN f.to_report THEN CASE WHEN rp THEN 1 ELSE 0 END ELSE CASE WHEN st THEN 1 ELSE 0 END END) / 2e0 AS c FROM scored s JOIN agree a ON a.run_id = s.run_id AND a.item_key = s.item_key AND a.nth = s.nth JOIN fact f ON f.run_id = s.run_id AND f.item_key = s.item_key AND f.nth = s.nth),
verdicts AS MATERIALIZED (SELECT f.run_id, f.item_key, f.weight, f.nth, f.concept, f.told, f.top, round(f.s + 1e-9, 4) AS score, round(f.a + 1e-9, 4) AS agreement, f.c AS completeness, round(1e-9 + 1e0 / (1e0 + exp(-4e0 * ({PRIOR_WEIGHTS["bias"]}e0 + {PRIOR_WEIGHTS["signal_agreement"]}e0 * f.a + {PRIOR_WEIGHTS["evidence_completeness"]}e0 * f.c + {PRIOR_WEIGHTS["boundary_distance"]}e0 * least(1e0, abs(f.s - {BOUNDARY}e0) / 0.1e0)
  + {PRIOR_WEIGHTS["test_pass_rate"]}e0 * r.test_pass_rate + {PRIOR_WEIGHTS["test_coverage"]}e0 * CASE WHEN f.t THEN 1 ELSE 0 END + {PRIOR_WEIGHTS["repair_distance_norm"]}e0 * least(1e0, r.repair_distance / 5e0) + {PRIOR_WEIGHTS["similarity_max"]}e0 * least(1e0, r.similarity_max) + {PRIOR_WEIGHTS["entailment_contradiction_rate"]}e0 * r.contradiction_rate
  + {PRIOR_WEIGHTS["stage_error"]}e0 * CASE WHEN r.stage_error THEN 1 ELSE 0 END + {PRIOR_WEIGHTS["static_check_rate"]}e0 * CASE WHEN f.static_passed THEN 1 ELSE 0 END + {PRIOR_WEIGHTS["has_executable_oracle"]}e0 - 0.5e0))), 4) AS confidence FROM full_ f JOIN runfact r ON r.run_id = f.run_id),
weighed AS (SELECT v.*, v.weight / sum(v.weight) OVER (PARTITION BY v.run_id) AS share FROM verdicts v),
run_ AS (SELECT r.run_id, r.similarity_max AS sim, r.contradictions AS con, r.syntax_penalty AS pen, r.stage_error AS err, sum(w.confidence * w.share) AS conf, greatest(0e0, sum(w.score * w.share) * (1e0 - max(r.syntax_penalty))) AS total, min(CASE WHEN w.share >= {SHARE}e0 AND w.agreement < {AGREED}e0 THEN w.agreement END) AS clash, sum(CASE WHEN w.confidence < {CONTESTED}e0 THEN w.share * (1e0 - w.confidence) ELSE 0e0 END) AS doubt
  FROM runfact r JOIN weighed w ON w.run_id = r.run_id GROUP BY r.run_id, r.similarity_max, r.contradictions, r.syntax_penalty, r.stage_error),
met AS (SELECT run_id, 'grade_boundary' AS reason, total AS v, {REASON_WEIGHT["grade_boundary"]}e0 AS g FROM run_ WHERE abs(total - {BOUNDARY}e0) <= {EPSILON}e0 UNION ALL SELECT run_id, 'integrity_flag', sim, {REASON_WEIGHT["integrity_flag"]}e0 FROM run_ WHERE sim >= {SIMILAR}e0
  UNION ALL SELECT run_id, 'low_confidence', conf, {REASON_WEIGHT["low_confidence"]}e0 FROM run_ WHERE conf < {RELEASE}e0 UNION ALL SELECT run_id, 'repair_material', pen, {REASON_WEIGHT["repair_material"]}e0 FROM run_ WHERE pen >= {PENALTY}e0
  UNION ALL SELECT run_id, 'report_contradiction', con, {REASON_WEIGHT["report_contradiction"]}e0 FROM run_ WHERE con > 0 UNION ALL SELECT run_id, 'signal_conflict', clash, {REASON_WEIGHT["signal_conflict"]}e0 FROM run_ WHERE clash IS NOT NULL
  UNION ALL SELECT run_id, 'stage_error', 1e0, {REASON_WEIGHT["stage_error"]}e0 FROM run_ WHERE err),
gate AS MATERIALIZED (SELECT run_.*, coalesce(m.n, 0) AS n, coalesce(m.told, '') AS reasons, coalesce(m.g, 0e0) AS g FROM run_ LEFT JOIN (SELECT run_id, count(*) AS n, max(g) AS g, string_agg(reason || ':' || CAST(round(CAST(v AS DOUBLE) + 1e-9, 3) AS VARCHAR), ' ' ORDER BY reason) AS told FROM met GROUP BY run_id) AS m ON m.run_id = run_.run_id)"""


def oracle_sql() -> dict[str, str]:
    return {
        "e10_signal_assembly": f"WITH {_SIGNALS} SELECT run_id, item_key, weight, told AS signals, score, agreement, round(completeness, 4) AS completeness, confidence FROM verdicts",
        "e11_gate_routing": f"WITH {_SIGNALS} SELECT run_id, CASE WHEN n > 0 THEN 'escalated' ELSE 'released' END AS state, round(total + 1e-9, 4) AS total, round(conf + 1e-9, 4) AS confidence, sim >= {SIMILAR}e0 AS integrity_flag, reasons FROM gate",
        "e12_emit_observations": f"WITH {_SIGNALS} SELECT v.run_id, v.item_key, v.concept, v.score, v.confidence, v.top AS source FROM verdicts v JOIN gate g ON g.run_id = v.run_id WHERE g.n = 0",
        "ma9_review_priority": f"WITH {_SIGNALS} SELECT run_id, round(1e-9 + g * (0.5e0 + doubt) * (0.5e0 + greatest(0e0, 1e0 - conf)), 4) AS priority FROM gate WHERE n > 0",
    }
