"""Ranks by counted values against sorting, and the hold-out against counting pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import ranks

SCHEMA = "g string, v double, y boolean"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [(rng.choice(["a", "b", None]), rng.choice([rng.random(), 0.5, 0.25]), rng.random() < 0.3) for _ in range(900)]
    return out + [("one", 0.1, True), ("same", 0.2, False), ("same", 0.2, True), ("a", None, True), ("none", None, True)]


def chance(pairs):
    p, q = ([v for v, y in pairs if y == k] for k in (True, False))
    return sum((a > b) + (a == b) / 2 for a in p for b in q) / (len(p) * len(q)) if p and q else None


@pytest.mark.parametrize("parts", [1, 13])
def test_ranks_are_those_of_sorting(spark, rows, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, SCHEMA)
        for by in (["g"], []):
            groups = {}
            for g, v, y in rows:
                if v is not None:
                    groups.setdefault(g if by else None, []).append((v, y))
            got = ranks.counted(table, F.col("v"), by).collect()
            assert all(r.before == sum(v < r.value for v, _ in groups[r.g if by else None]) and r.n == sum(v == r.value for v, _ in groups[r.g if by else None]) for r in got)
            assert len(got) == sum(len({v for v, _ in x}) for x in groups.values())
            got = {(r.g if by else None): r.auc for r in ranks.auc(table, F.col("v"), F.col("y"), by).collect()}
            assert got.keys() == groups.keys() and all(got[k] == (None if (c := chance(x)) is None else pytest.approx(c)) for k, x in groups.items())
            got = {(r.g if by else None): (r.p, r.m) for r in ranks.nearest_rank(table, F.col("v"), by, {"p": 0.95, "m": 0.5}).collect()}
            assert got == {k: tuple(sorted(v for v, _ in x)[math.floor(len(x) * s)] for s in (0.95, 0.5)) for k, x in groups.items()}
        assert ranks.auc(table.limit(0), F.col("v"), F.col("y"), ["g"]).count() == ranks.nearest_rank(table.limit(0), F.col("v"), ["g"], {"p": 0.5}).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_window_holds_all_rows(spark):
    plan = ranks.j16_auc(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and plan.count("SinglePartition") <= 2  # the sums of ranges, and the last sum
