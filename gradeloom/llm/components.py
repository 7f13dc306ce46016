"""Connected components of a link table by alternating large and small stars; every step is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gradeloom.runtime import stored


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node that has a link to another one.

    Each round moves every link's larger end to its neighbours' minimum, found by a pre-aggregated groupBy; nothing of a
    node's neighbours is gathered into one row, so hubs are no hot spots. Null ends and self links are ignored.
    """
    edges = stored(
        links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter("a is not null and b is not null and a <> b").distinct(),
        "links",
    )
    before = _digest(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(lowest, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        edges = stored(small, "links")
        after = _digest(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select("b", "b").toDF("node", "root").distinct())
