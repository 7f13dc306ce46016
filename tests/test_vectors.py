"""All pairs of vectors in blocks against the SQL, at block and tile sizes that cut the groups."""

import duckdb
import pytest

from gradeloom.operators import vectors
from gradeloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.mark.parametrize("name,value", [("ma4_cosine", "cosine"), ("j17_distances", "d"), ("c1_mutual_reachability", "reach"), ("w12_core_distance", "core")])
def test_pairs_equal_the_sql(spark, name, value):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{DATA}/embeddings.parquet'")
    sql = catalog.oracle_sql()[name]
    for t in ("events", "lineitem", "orders", "customer", "nation", "region"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    columns = ["a", value] if name == "w12_core_distance" else ["a", "b", value]
    want = sorted(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())
    assert rows(catalog.queries()[name](spark, DATA), *columns) == want and want


def test_blocks_and_copies(spark, monkeypatch):
    """Blocks of some vectors give what one block gives; no row joins all pairs (the SQL form's plan did)."""
    table = vectors._vectors(spark, DATA)
    copies = table.unionByName(table.selectExpr("grp", "id + 1000 AS id", "v")).unionByName(spark.createDataFrame([(77, 5000, None), (77, 5001, [1.0, 0.0]), (None, 5002, [1.0])], "grp int, id bigint, v array<float>"))
    for made in (vectors.pair_cosines, vectors.pair_distances, vectors.core_distances):
        one, many = made(copies), made(copies, 50)
        assert rows(one, *one.columns[:2]) == rows(many, *many.columns[:2])
    got = {(r.a, r.b): r.cosine for r in vectors.pair_cosines(copies, 50).collect()}
    assert got[(5000, 5001)] is None and got[(1, 1001)] == 1.0
    assert {(r.a, r.b): r.d for r in vectors.pair_distances(copies, 50).collect()}[(5001, 5000)] == 0.0
    assert "CartesianProduct" not in vectors.pair_cosines(table)._jdf.queryExecution().toString() and "SortMergeJoin Inner" not in vectors.pair_cosines(table)._jdf.queryExecution().toString()
    assert vectors.pair_cosines(table.limit(0)).count() == 0
