"""Briefs: requirements in order, once each, and the rubric's extra items."""

from gradeloom.operators import briefs as B


def kinds(rows, i):
    return [(r.kind, r.target) for r in sorted((r for r in rows if r.id == i), key=lambda r: r.ord)]


def test_requirements(spark):
    rows = B.requirements(B.sample(spark)).collect()
    assert kinds(rows, 1) == [("function_defined", "solve"), ("recursion_present", None), ("guard_present", "input_length")]
    assert kinds(rows, 2) == [("function_defined", "solve"), ("class_defined", "Stack"), ("uses_iteration", None), ("documented", None), (None, None)]
    assert kinds(rows, 3) == [("function_defined", "solve"), ("api_absent", "sorted"), ("loop_nesting", "1"), ("algorithm_class", "divide_and_conquer_sort")]
    for i in (4, 5, 6):
        assert kinds(rows, i) == [("function_defined", "solve")]


def test_drafts_have_something_to_test(spark):
    rows = B.rubric(B.sample(spark)).collect()
    assert all(any("test" in r.checks for r in rows if r.id == i) for i in range(1, 7))
    assert not any("report" in r.checks for r in rows)
    static = B.rubric(B.sample(spark), mode="static", report=True).collect()
    assert not any("test" in r.checks for r in static)
    assert sorted(r.item_key for r in static if r.id == 5) == ["rb_01", "rb_02", "rb_03"]
