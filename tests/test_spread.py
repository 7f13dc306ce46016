"""The join of items in as many tasks as their number asks for, with the same rows."""

import pytest

from gradeloom.plans import catalog, evidence

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["a11_agreement", "j25_training_set", "j2_released_runs"])
def test_more_items_take_more_tasks(spark, monkeypatch, name):
    few = catalog.queries()[name](spark, DATA)
    monkeypatch.setattr(evidence, "LINES_A_TASK", 100)
    many = catalog.queries()[name](spark, DATA)
    assert "REPARTITION_BY_NUM, [plan_id" in (plan := many._jdf.queryExecution().executedPlan().toString()) and "REPARTITION_BY_NUM" not in few._jdf.queryExecution().executedPlan().toString(), plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


@pytest.mark.parametrize("name", ["j25_training_set", "a11_agreement"])
def test_orders_are_not_sent_to_all_tasks(spark, monkeypatch, name):
    few = catalog.queries()[name](spark, DATA)
    monkeypatch.setattr(evidence, "LINES_A_TASK", 4000)  # two tasks, which the session's partitions hold
    many = catalog.queries()[name](spark, DATA)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [l_orderkey" not in plan and "BroadcastHashJoin [run_id" not in plan and "SortMergeJoin [l_orderkey" in plan, plan
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))


def test_items_are_not_dealt_by_their_few_assignments(spark, monkeypatch):
    monkeypatch.setattr(evidence, "LINES_A_TASK", 100)
    plan = catalog.queries()["a30_common_failures"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [assignment_id" in plan and "SortMergeJoin [assignment_id" not in plan, plan
