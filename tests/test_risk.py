"""The risk factors and their invariant, and the hourly stream, on rows made for them."""

import duckdb
import pytest

from gradeloom.plans import catalog
from gradeloom.plans.domain import _RISK, _RISK_ROWS
from gradeloom.streaming import mastery

DATA = "/root/testdata/sf0.001"


def test_risk_of_a_student_adds_its_factors(spark):
    """Features in, risk out: the factors above their thresholds add up, the list is ranked, the route supports."""
    tail = _RISK[_RISK.index("factors AS") :]
    rows = "(1, 0.2e0, -0.05e0, 3, 0.5e0, 0.3e0, 0.5e0, 2), (2, 0.9e0, 0.1e0, 0, 0e0, 0e0, 0e0, 0), (3, 0.0e0, -0.3e0, 1, 0.1e0, 0.1e0, 0.45e0, 0)"
    sql = f"WITH features AS (SELECT * FROM (VALUES {rows}) AS f(student_id, mean, slope, depth, late, dropped, decay, missed)), {tail} {_RISK_ROWS} ORDER BY student_id"
    got = [tuple(r) for r in spark.sql(sql).select("student_id", "risk", "flagged", "route", "factors").collect()]
    raw = 0.8 * 0.30 + 0.3 * 0.22 + 0.75 * 0.16 + 0.5 * 0.09 + 0.3 * 0.09 + 0.5 * 0.08 + 2 / 3 * 0.06
    assert got[0][1] == pytest.approx(1 / (1 + 2.718281828459045 ** (-6 * (raw - 0.32))), abs=1e-6)
    assert got[0][2:4] == (True, "tutoring") and got[0][4].startswith("Low mastery across the course; Deep prerequisite gap; Declining") and got[0][4].count(";") == 6
    assert got[1][2:] == (False, "advising", "Low mastery across the course")
    assert got[2][2:4] == (True, "instructor_check_in")
    assert [tuple(r) for r in duckdb.sql(sql).project("student_id, risk, flagged, route, factors").fetchall()] == got


def test_every_flag_has_factors_and_a_support_route(spark):
    row = catalog.queries()["r3_risk_invariant"](spark, DATA).first()
    assert row.students > 0 and row.flagged_without_factors == row.off_route == row.off_scale == 0


def test_the_stream_counts_every_submission_of_the_hour_before(spark):
    got = sorted(map(tuple, mastery.t3_rate_windows(spark, DATA).select("event_id", "n", "rejected").collect()))
    assert got == sorted(map(tuple, catalog.queries()["w7_rate_limit"](spark, DATA).select("event_id", "n", "rejected").collect()))
