"""The domain views."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gradeloom.plans import evidence
from gradeloom.plans.evidence import TABLES, query

DATA = "/root/testdata/sf0.001"


def test_mastery_is_summed_in_the_order_of_the_log(spark, tmp_path):
    values = [[29.27, 61.13, 7.91, 99.83, 0.37, 83.71, 45.59][(i * k) % 7] + i / 100 for k in range(1, 41) for i in range(23)]
    rows = [(i, datetime(2024, 1, 1) + timedelta(seconds=i), i // 23, "view", v, '{"k": 1}') for i, v in enumerate(values)] + [(10_000, datetime(2024, 1, 2), 99, "view", None, '{"k": 1}')]
    events = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string")
    events.orderBy("value").repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    for t in TABLES:
        if t != "events":
            os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    got = {r.student_id: r.m for r in query("SELECT student_id, m FROM mastery")(spark, str(tmp_path)).collect()}
    want = {}
    for i, v in enumerate(values):
        want[i // 23] = want.get(i // 23, 0.0) + min(1.0, v / 100)
    assert got == {k: s / 23 for k, s in want.items()} | {99: 1.0}  # least(1, null) is 1


@pytest.mark.parametrize("files", [1, 7])
def test_marks_are_summed_in_the_order_of_the_lines(spark, monkeypatch, tmp_path, files):
    """Whatever the tasks are: one file is read in splits, several in order of their names."""
    lines = [(1 + i * 7 % 3, 0.01 * (i * 37 % 9) + 0.001 * (i % 7), 1.0 + i * 13 % 50 + 0.1 * (i % 3)) for i in range(20_000)]
    made = spark.createDataFrame(spark.sparkContext.parallelize(lines, files), "l_orderkey bigint, l_discount double, l_quantity double")
    known = spark.read.parquet(f"{DATA}/lineitem.parquet").limit(1).drop(*made.columns)
    made.crossJoin(F.broadcast(known)).write.option("parquet.block.size", 20_000).parquet(f"{tmp_path}/lineitem.parquet")
    for t in TABLES:
        if t != "lineitem":
            os.symlink(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    monkeypatch.setattr(evidence, "LINES_A_TASK", 3000)
    want: dict = {}
    for k, d, w in lines:
        a, b = want.get(k, (0.0, 0.0))
        want[k] = a + max(0.0, 1.0 - d * 10.0) * w, b + w
    least = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    try:
        assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() > 4
        got = {r.run_id: r.total for r in query("SELECT run_id, total FROM verdict")(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", least)
    assert got == {k: a / b for k, (a, b) in want.items()}
