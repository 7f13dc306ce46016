"""Static checks and predicates."""

import pytest
from pyspark.sql import functions as F

from gradeloom.functions import checks as K

SOURCE = "import math\nclass Stack:\n    pass\n# note\ndef f(xs):\n    if len(xs) == 0:\n        return 0\n    try:\n        return f(xs[1:]) + math.floor(1)\n    except ValueError:\n        return 1\n"


@pytest.mark.parametrize(
    "kind, target, number, passed",
    [
        ("guard_present", "input_length", None, True), ("recursion_present", None, None, True), ("api_called", "floor", None, True), ("api_absent", "floor", None, False), ("api_absent", "sorted", None, True),
        ("loop_nesting", None, 0.0, True), ("error_handling", None, None, True), ("function_defined", "f", 1.0, True), ("function_defined", "f", 2.0, False), ("class_defined", "Stack", None, True),
        ("class_defined", "Queue", None, False), ("uses_iteration", None, None, False), ("min_functions", None, None, False), ("no_global_state", None, None, True), ("documented", None, 0.05, True), ("what", None, None, False),
    ],
)
def test_checks(spark, kind, target, number, passed):
    rows = spark.createDataFrame([(SOURCE, kind, target, number)], "source string, kind string, target string, number double")
    got = K.checked(rows).first()
    assert got.passed == passed and got.advisory == (kind in K.ADVISORY or kind == "what")


def test_predicates(spark):
    rows = spark.createDataFrame([([3, 1, 1], [1, 1, 3]), ([1], [2, 1]), ([], []), ([1], None)], "i array<int>, o array<int>")
    got = [r[0] for r in rows.select(K.failed_predicates(["is_ascending", "multiset_equal_to_input", "no_duplicates", "nonsense"], F.col("i"), F.col("o"))).collect()]
    assert got == [["no_duplicates", "nonsense"], ["is_ascending", "multiset_equal_to_input", "nonsense"], ["nonsense"], ["is_ascending", "multiset_equal_to_input", "no_duplicates", "nonsense"]]


def test_queries(spark):
    for name, q in K.queries().items():
        assert q(spark, "/root/testdata/sf0.001").count() > 0, name
    assert {r.failed for r in K.queries()["x3_predicates"](spark, "/root/testdata/sf0.001").collect()} <= {"is_descending,non_negative", "is_descending", "non_negative"}
