"""Signals, agreement, confidence and the gate on literal rows with known answers."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import gate
from gradeloom.operators.refresh import PRIOR_WEIGHTS

ITEM = {"run_id": 1, "item_key": "rb_01", "weight": 10.0, "has_tests": True, "withheld": False, "oracle_exists": True, "tests_ran": True, "passed_share": 1.0, "on_repaired": False, "static_passed": None, "advisory": False, "structural": 0.0, "declared": ["test"], "covered": False, "coverage": None, "concepts": ["c_x"]}
FACTS = "similarity_max double, contradictions int, syntax_penalty double, stage_error boolean"
KINDS = "run_id int, item_key string, weight double, has_tests boolean, withheld boolean, oracle_exists boolean, tests_ran boolean, passed_share double, on_repaired boolean, static_passed boolean, advisory boolean, structural double, declared array<string>, covered boolean, coverage double, concepts array<string>"
CONTEXT = {"test_pass_rate": 1.0, "repair_distance": 0, "similarity_max": 0.0, "contradiction_rate": 0.0, "stage_error": False, "static_check_rate": 1.0}


def items(spark, *changes, **context):
    rows = spark.createDataFrame([tuple((ITEM | c)[k] for k in ITEM) for c in changes], KINDS)
    return gate.judged(gate.assembled(rows).withColumns({k: F.lit(v) for k, v in (CONTEXT | context).items()}))


def decision(spark, judged, similarity=0.0, contradictions=0, penalty=0.0, error=False):
    return gate.decided(judged, spark.createDataFrame([(1, similarity, contradictions, penalty, error)], f"run_id int, {FACTS}")).first()


def test_agreeing_signals_score_higher_than_conflicting_ones(spark):
    yes, no = items(spark, {"static_passed": True}).first(), items(spark, {"static_passed": False}).first()
    assert yes.agreement == 1.0 > 0.5 > no.agreement and no.score == pytest.approx(1 / 1.85, abs=1e-4)
    strong, weak = items(spark, {}).first(), items(spark, {"has_tests": False, "tests_ran": False, "declared": ["report"], "coverage": 1.0, "covered": True}).first()
    assert (strong.agreement, weak.agreement) == (0.85, 0.525)


def test_which_signals_speak(spark):
    told = {
        "repair": {"on_repaired": True, "passed_share": 0.5}, "unbuildable": {"tests_ran": False}, "withheld": {"tests_ran": False, "withheld": True}, "no oracle": {"tests_ran": False, "oracle_exists": False},
        "shape lifts": {"passed_share": 0.0, "structural": 0.6}, "shape never lowers": {"passed_share": 0.9, "structural": 0.6}, "shape is no guard": {"has_tests": False, "tests_ran": False, "static_passed": False, "structural": 0.9, "declared": ["static"]},
        "asked for shape": {"has_tests": False, "tests_ran": False, "structural": 0.4, "declared": ["structural"]}, "advisory": {"static_passed": True, "advisory": True}, "part covered": {"declared": ["test", "report"], "coverage": 0.25}, "report not asked": {"coverage": 1.0, "covered": True},
    }
    got = {r.item_key: [(s.source, s.score) for s in r.signals] for r in items(spark, *[c | {"item_key": k} for k, c in told.items()]).collect()}
    assert got == {
        "repair": [("repair", 0.5)], "unbuildable": [("test", 0.0)], "withheld": [("structural", 0.0)], "no oracle": [("structural", 0.0)], "shape lifts": [("test", 0.0), ("structural", 0.6)], "shape never lowers": [("test", 0.9)],
        "shape is no guard": [("static", 0.0)], "asked for shape": [("structural", 0.4)], "advisory": [("test", 1.0), ("static_advisory", 1.0)], "part covered": [("test", 1.0), ("report", 0.25)], "report not asked": [("test", 1.0)],
    }


def test_confidence_is_the_squashed_sum(spark):
    row = items(spark, {"static_passed": True, "declared": ["test", "static"], "passed_share": 1.0}).first()
    on = ("bias", "signal_agreement", "evidence_completeness", "boundary_distance", "test_pass_rate", "test_coverage", "static_check_rate", "has_executable_oracle")
    assert row.confidence == pytest.approx(1 / (1 + math.exp(-4 * (sum(PRIOR_WEIGHTS[k] for k in on) - 0.5))), abs=1e-4) and row.completeness == 1.0


def test_gate_releases_when_everything_agrees(spark):
    d = decision(spark, items(spark, {"static_passed": True, "declared": ["test", "static"]}))
    assert (d.state, d.reasons, d.integrity_flag, d.priority) == ("released", [], False, 0.0)


def test_gate_escalates_on_a_report_contradiction_without_penalising(spark):
    d = decision(spark, items(spark, {}), contradictions=2)
    assert d.state == "escalated" and [(r.reason, r.value) for r in d.reasons] == [("report_contradiction", 2.0)] and d.total == pytest.approx(1.0)


@pytest.mark.parametrize("share,reasons", [(0.41, ["grade_boundary"]), (0.5, []), (0.42, ["grade_boundary"]), (0.425, [])])
def test_gate_escalates_near_a_grade_boundary(spark, share, reasons):
    d = decision(spark, items(spark, {"passed_share": share}, test_pass_rate=share, static_check_rate=0.0))
    assert [r.reason for r in d.reasons] == reasons


def test_all_reasons_are_kept_with_their_values(spark):
    judged = items(spark, {"static_passed": False, "weight": 8.0}, {"item_key": "b", "passed_share": 0.0, "weight": 2.0}, similarity_max=0.9, stage_error=True, contradiction_rate=1.0)
    d = decision(spark, judged, similarity=0.62, contradictions=1, penalty=0.2, error=True)
    names = [r.reason for r in d.reasons]
    assert names == sorted(names) and {"integrity_flag", "low_confidence", "repair_material", "report_contradiction", "signal_conflict", "stage_error"} <= set(names)
    assert {r.reason: r.value for r in d.reasons}["integrity_flag"] == 0.62 and d.integrity_flag and d.priority > 0.5
    bounded = decision(spark, items(spark, {"on_repaired": True}), penalty=0.05)
    assert 0.9 < bounded.total < 1.0
    none = gate.decided(judged.limit(0), spark.createDataFrame([(1, None, None, None, None)], f"run_id int, {FACTS}")).first()
    assert (none.total, none.confidence, [r.reason for r in none.reasons]) == (0.0, 0.0, ["low_confidence"])


def test_only_released_and_overridden_runs_are_observed(spark):
    judged = items(spark, {"static_passed": True, "concepts": ["a", "b"]}, {"run_id": 2}, {"run_id": 3, "on_repaired": True, "static_passed": True})
    states = spark.createDataFrame([(1, "released"), (2, "escalated"), (3, "overridden")], "run_id int, state string")
    assert sorted((r.run_id, r.concept, r.source) for r in gate.observed(judged, states).collect()) == [(1, "a", "test"), (1, "b", "test"), (3, "c_x", "static")]


def test_a_verdict_does_not_hang_on_the_order_of_rows(spark):
    """Shares of three items whose sum, added in one order or another, lies on either side of the boundary's edge."""
    of = [(1, "a", 1.0, 0.3, 1.0, 0.9), (1, "b", 1.0, 0.4, 1.0, 0.9), (1, "c", 1.0, 0.44, 1.0, 0.9), (1, "d", 3.0, 0.38, 1.0, 0.9), (1, "e", 7.0, 0.38, 1.0, 0.9)]
    facts = spark.createDataFrame([(1, 0.0, 0, 0.0, False)], f"run_id int, {FACTS}")
    got = {tuple(gate.decided(spark.createDataFrame(list(p), "run_id int, item_key string, weight double, score double, agreement double, confidence double").coalesce(1), facts).select("state", "total", "confidence").first()) for p in itertools.islice(itertools.permutations(of), 0, 120, 17)}
    assert len(got) == 1, got
