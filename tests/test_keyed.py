"""Keyed tables: what a second run changes, carried labels, deletes, conflicts and odd keys."""

import pytest
from pyspark.sql import functions as F

from gradeloom.operators import sinks
from gradeloom.runtime import run_folder
from gradeloom.sources.keyed import Conflict, KeyedTable

SCHEMA = "k bigint, c string, v double"


@pytest.fixture
def table(spark):
    return KeyedTable(spark, run_folder(spark, "keyed-test"), ["k", "c"], buckets=8)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def test_a_second_run_changes_only_its_keys(spark, table):
    assert table.read() is None and table.version() == 0
    first = [(i, "a", float(i)) for i in range(40)] + [(None, None, 1.0)]
    assert table.upsert(spark.createDataFrame(first, SCHEMA)) == 1
    files = table._manifest(1)["buckets"]
    assert table.upsert(spark.createDataFrame([(3, "a", 9.0), (4, "a", 4.0), (99, "b", 1.0), (None, None, 2.0)], SCHEMA)) == 2
    want = [(k, c, {3: 9.0}.get(k, v) if k is not None else 2.0, 2 if k in (3, None) else 1) for k, c, v in first] + [(99, "b", 1.0, 2)]
    assert rows(table.read()) == sorted(map(str, want))
    touched = {b for b, p in table._manifest(2)["buckets"].items() if p != files.get(b)}
    assert 1 <= len(touched) <= 3 and rows(table.read(1)) == sorted(str((*r, 1)) for r in first)
    assert table.upsert(spark.createDataFrame([(3, "a", 9.0)], SCHEMA)) == 2 and table.upsert(spark.createDataFrame([], SCHEMA)) == 2


def test_repeated_keys_other_columns_and_null_values(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 1.0), (1, "a", 3.0), (1, "a", None)], SCHEMA))
    assert rows(table.read()) == ["(1, 'a', 3.0, 1)"]
    table.upsert(spark.createDataFrame([(1, "a", None)], SCHEMA))
    assert rows(table.read()) == ["(1, 'a', None, 2)"]
    assert table.upsert(spark.createDataFrame([(None, "a", 1)], "v double, c string, k bigint")) == 2
    with pytest.raises(ValueError, match="columns"):
        table.upsert(spark.createDataFrame([(1, "a")], "k bigint, c string"))


def test_rebuild_carries_labels_by_key(spark, table):
    table.rebuild(spark.createDataFrame([(1, "x", 1.0), (2, "y", 1.0)], SCHEMA), ["label"])
    table.upsert(table.read().drop("version").filter("k = 1").withColumn("label", F.lit("off by one")))
    table.rebuild(spark.createDataFrame([(1, "x", 5.0), (3, "z", 1.0)], SCHEMA), ["label"])
    assert rows(table.read().drop("version")) == ["(1, 'x', 5.0, 'off by one')", "(3, 'z', 1.0, None)"]


def test_delete_by_some_columns(spark, table):
    table.upsert(spark.createDataFrame([(i, c, 0.0) for i in range(5) for c in "ab"], SCHEMA))
    assert table.delete(spark.createDataFrame([(2,), (77,)], "k bigint")) == 2
    assert table.read().count() == 8 and table.read().filter("k = 2").count() == 0
    assert table.delete(spark.createDataFrame([(77,)], "k bigint")) == 2
    assert table.delete(table.read().select("k").distinct()) == 3 and table.read().count() == 0
    with pytest.raises(ValueError, match="confirmation"):
        sinks.deleted_assignment({}, table.read(), "a1", "a2")


def test_a_writer_that_comes_second_fails_and_leaves_the_table(spark, table):
    table.upsert(spark.createDataFrame([(1, "a", 1.0)], SCHEMA))
    late = KeyedTable(spark, table.path, table.keys, 8)
    late.version = lambda: 0  # it read before the first writer's commit
    with pytest.raises(Conflict):
        late.upsert(spark.createDataFrame([(1, "a", 5.0)], SCHEMA))
    assert table.version() == 1
