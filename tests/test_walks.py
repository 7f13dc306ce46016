"""Walks over gaps beyond the rows that a recursive query may have, and on graphs with circles."""

import random

import pytest

from gradeloom.operators import walks
from gradeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["g1_root_gap", "g2_recommend", "g7_interventions", "g8_gap_depth", "r1_risk", "r2_course_risk", "r3_risk_invariant"])
def test_no_recursive_query_and_the_rows_of_the_sql(spark, name):
    """Spark ends a recursive query at spark.sql.cteRecursionRowLimit rows; 5 rows are less than these walks have."""
    from gradeloom.plans.catalog import _SQL
    from gradeloom.plans.evidence import query

    plain = lambda df: sorted(map(str, df.collect()))
    want = plain(query(_SQL[name])(spark, DATA))
    spark.conf.set("spark.sql.cteRecursionRowLimit", "5")
    try:
        got = plain(catalog.queries()[name](spark, DATA))
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    assert got == want and got


def test_circles_and_forks(spark):
    rng = random.Random(3)
    names = "abcdefg"
    edges = {(rng.choice(names), rng.choice(names)) for _ in range(12)} | {("a", "b"), ("b", "a")}
    known = {s: {c: rng.random() for c in names} for s in range(20)}

    def longest(m, path):
        return max([len(path), *(longest(m, [*path, q]) for p, q in edges if p == path[-1] and m[q] < 0.7 and q not in path)])

    def down(m, path):
        ways = sorted((m[q], q) for p, q in edges if p == path[-1] and m[q] < 0.7)
        return path if not ways or ways[0][1] in path else down(m, [*path, ways[0][1]])

    table = spark.createDataFrame([(s, c, v) for s, m in known.items() for c, v in m.items()], "student_id int, concept string, m double")
    graph = spark.createDataFrame(sorted(edges), "concept string, prereq string")
    got = {(r.student_id, r.start_): (r.target, r.depth) for r in walks.goals(table, graph).collect()}
    paths = {(s, c): down(m, [c]) for s, m in known.items() for c in names if m[c] < 0.7}
    assert got == {k: (p[-1], len(p) - 1) for k, p in paths.items()}
    gaps = table.filter("m < 0.7").selectExpr("student_id", "concept", "concept < 'd' AS start")
    starts = {s: [c for c in "abc" if m[c] < 0.7] for s, m in known.items()}
    assert {r.student_id: r.depth for r in walks.depths(gaps, graph).collect()} == {s: max(longest(known[s], [c]) for c in cs) for s, cs in starts.items() if cs}
