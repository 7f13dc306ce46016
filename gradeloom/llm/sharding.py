"""Sharding by a minimax contiguous partition, in DataFrame and SQL functions alone.

Equal texts are one atomic group. Groups are dealt by a hash to at most `BUCKETS` ordered buckets, so what the search
sees is bounded whatever the table holds; a bucket is atomic too. The smallest feasible capacity is found by binary
search over the ordered bucket sizes, each step checked greedily; then the row of buckets is cut so that no shard
passes that capacity. Buckets above the fair share come first in the order, each in a shard of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.runtime import stored

P = "__shard_"
BUCKETS = 1 << 16
#: Parts of a bucket for numbering its rows, so that a group that holds much of the table is numbered by many tasks.
SALTS = 64


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(16)


def _marked(docs: DataFrame, text: str, key: str) -> DataFrame:
    t = F.col(text)
    return docs.withColumns({
        f"{P}size": text_size(t),
        f"{P}crc": F.crc32(F.coalesce(t, F.lit("")).cast("binary")),
        f"{P}bucket": F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"),
        f"{P}salt": F.pmod(F.xxhash64(F.col(key), F.lit("salt")), F.lit(SALTS)).cast("int"),
    })


#: Greedy check: shards needed for the ordered sizes `s` if none may pass the capacity `c`.
_NEEDED = "aggregate(s, named_struct('k', 1L, 'cur', 0L), (a, x) -> if(a.cur + x.b > {c}, named_struct('k', a.k + 1, 'cur', x.b), named_struct('k', a.k, 'cur', a.cur + x.b)), a -> a.k)"


def cut_points(sizes: DataFrame, shards: int) -> DataFrame:
    """One row: s (ordered buckets), capacity, and starts (the position in s at which each shard begins)."""
    row = sizes.agg(F.sum("b").alias("total"), F.max("b").alias("most"), F.array_sort(F.collect_list(F.struct("o", "bucket", "b"))).alias("s")).filter("size(s) > 0")
    half = "((z.lo + z.hi) div 2)"
    row = row.withColumn(
        "capacity",
        F.expr(
            "aggregate(sequence(1, 63), named_struct('lo', greatest(most, (total + {n} - 1) div {n}), 'hi', most + (total + {n} - 1) div {n}),"
            " (z, i) -> if(z.lo >= z.hi, z, if({needed} <= {n}, named_struct('lo', z.lo, 'hi', {half}), named_struct('lo', {half} + 1, 'hi', z.hi))), z -> z.lo)".format(n=shards, half=half, needed=_NEEDED.format(c=half))
        ),
    )
    # latest[j - 1]: the first position from which j shards hold all the rest
    row = row.withColumn(
        "latest",
        F.expr(
            "aggregate(reverse(s), named_struct('cur', 0L, 'i', size(s), 'at', cast(array() as array<int>)), (a, x) ->"
            " if(a.cur + x.b > capacity, named_struct('cur', x.b, 'i', a.i - 1, 'at', array_append(a.at, a.i)), named_struct('cur', a.cur + x.b, 'i', a.i - 1, 'at', a.at)), a -> a.at)"
        ),
    )
    rest = f"({shards} - size(a.starts))"
    fair = f"((total - a.gone) / cast({shards} - size(a.starts) + 1 as double))"
    allowed = f"({rest} > 0 and a.cur > 0 and a.i >= if({rest} > size(latest), 0, element_at(latest, greatest(1, {rest}))))"
    close = f"(a.cur + x.b > capacity or ({allowed} and a.cur + x.b / 2.0D >= {fair}))"
    return row.withColumn(
        "starts",
        F.expr(
            "aggregate(s, named_struct('cur', 0L, 'gone', 0L, 'i', 0, 'starts', array(0)), (a, x) ->"
            f" if({close}, named_struct('cur', x.b, 'gone', a.gone + a.cur, 'i', a.i + 1, 'starts', array_append(a.starts, a.i)),"
            " named_struct('cur', a.cur + x.b, 'gone', a.gone, 'i', a.i + 1, 'starts', a.starts)), a -> a.starts)"
        ),
    )


def plan_shards(cells: DataFrame, shards: int) -> DataFrame:
    """For each cell (bucket, salt) its shard and the slot of its first row; cells have n rows and b bytes."""
    buckets = cells.groupBy(f"{P}bucket").agg(F.sum("b").alias("b"))
    total = F.sum("b").over(Window.partitionBy(F.lit(0)))
    # the oversized first, the largest of them first; then by hash
    sizes = buckets.select(F.when(F.col("b") * shards > total, -F.col("b")).otherwise(F.col(f"{P}bucket").cast("long")).alias("o"), F.col(f"{P}bucket").alias("bucket"), "b")
    cuts = cut_points(sizes, shards).select("starts", F.posexplode("s").alias("i", "x"))
    where = cuts.select(F.col("x.bucket").alias(f"{P}bucket"), F.expr("size(filter(starts, p -> p <= i)) - 1").alias(f"{P}shard"))
    order = Window.partitionBy(f"{P}shard").orderBy(f"{P}bucket", f"{P}salt").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(where, f"{P}bucket").select(f"{P}bucket", f"{P}salt", f"{P}shard", F.coalesce(F.sum("n").over(order), F.lit(0)).alias(f"{P}first"))


def shard(docs: DataFrame, shards: int = 40, *, text: str = "text", key: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with size, text_crc32, law, shard, slot and grown_shard (null under the law `bytes`).

    Null texts weigh 16 and are a group of their own, with the checksum of the empty text. Repeated rows share a shard
    and have slots of their own; ties in the slot order are between rows alike in key and size. Fewer buckets than shards
    leave the last shards empty. Input columns named like an output column are replaced. An empty table gives an empty result.
    """
    out = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in out]
    marked = _marked(docs.select(*dict.fromkeys([*columns, text, key])), text, key)
    own = [f"{P}size", f"{P}crc", f"{P}bucket", f"{P}salt"]
    if keep is not None:
        marked = stored(marked.select(*dict.fromkeys([*columns, key, *own])), "shard-rows")
    cells = stored(marked.groupBy(f"{P}bucket", f"{P}salt").agg(F.count(F.lit(1)).alias("n"), F.sum(f"{P}size").alias("b")), "shard-cells")
    plan = stored(plan_shards(cells, shards), "shard-plan")
    within = Window.partitionBy(f"{P}bucket", f"{P}salt").orderBy(key, f"{P}size")
    numbered = marked.withColumn(f"{P}i", F.row_number().over(within)).join(plan, [f"{P}bucket", f"{P}salt"])
    return numbered.select(
        *columns,
        F.col(f"{P}size").alias("size"),
        F.col(f"{P}crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        F.col(f"{P}shard").cast("int").alias("shard"),
        (F.col(f"{P}first") + F.col(f"{P}i") - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op9_shard(spark, sf_dir: str) -> DataFrame:
    """Shard and slot of every document. Nulls, ties and empty tables: see `shard`."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
