"""Queries of the catalog against their DuckDB form on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from gradeloom.plans import authoring, catalog

DATA = "/root/testdata/sf0.001"
PICKED = ["src2_observation_log", "t1_streamed_mastery", "t2_streamed_once", "t3_rate_windows", "t5_reconciled_mastery", "snk1_mastery_upsert", "snk2_item_stats_upsert", "snk3_label_carry", "snk6_cascade_delete", "snk7_audit_append", "snk8_marks_pivot", "pf9_mastery_state", "j8_roster_left_latest", "a7_nearest_rank", "a9_weighted_kappa", "a15_point_biserial", "a22_programme_outcome", "w7_rate_limit", "w6_trajectories", "o2_contested", "u8_rubric_diff", "k3_trace_students", "k4_propagate_once", "k7_auc", "g1_root_gap", "g2_recommend", "g8_gap_depth", "r1_risk", "e11_gate_routing", "i1_winnow", "i3_pair_similarity", "ma4_cosine", "d1_late_seconds", *authoring.SQL]


def plain(rows):
    one = lambda v: "" if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.5g}" if isinstance(v, float) else str(v)
    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", PICKED)
def test_same_as_oracle(spark, duck, name):
    got = catalog.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(catalog.oracle_sql()[name]).fetchall()
    names = [d[0] for d in duck.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert plain(got.select(*columns).collect()) == plain([tuple(r[i] for i in order) for r in want])


def test_every_query_has_a_name_of_the_survey():
    assert all(n.split("_")[0][0].isalpha() for n in catalog.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
