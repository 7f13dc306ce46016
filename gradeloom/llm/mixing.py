"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions alone.

Every document is a packet of its source's queue. Queues are shuffled by a hash; a packet's virtual finish time is
the source's cumulative tokens divided by the source's target. Packets are dealt to ranges of virtual time, ranges are
summed, and the range in which the running total passes the budget is ordered exactly to find the cut.
A source may be passed through `repeats` times.

Where documents may be cut (`whole` is false), packets are served in the same order up to the same cut. What a source's
packets then have beyond its target goes back from the last of them, and what they lack comes from the packet after them,
so every source has its target, but for part of a word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from gradeloom.runtime import stored

#: Fixed value: a word is a run of characters other than space, tab and the line ends.
WORD = r"[^\x20\x09-\x0D]+"
P = "__mix_"
#: Documents in a cell of a source's shuffled order, and packets in a range of virtual time, on average, at least; of a
#: large table their square root, so that neither a cell nor the table of cells is large.
CELL_ROWS = 4000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def _sized(docs: DataFrame, text: str, source: str, key: str, cells: int) -> DataFrame:
    order = F.xxhash64(F.col(key), F.col(text))
    return docs.withColumns({
        f"{P}size": word_count(F.col(text)),
        f"{P}h": order,
        f"{P}none": F.col(source).isNull(),
        f"{P}src": F.coalesce(F.col(source), F.lit("")),
    }).withColumn(f"{P}cell", F.least(F.lit(cells - 1), F.floor((F.col(f"{P}h") / F.lit(2.0**64) + F.lit(0.5)) * F.lit(cells))).cast("long"))


def source_targets(cells: DataFrame, weights: tuple[int, ...], share: float, repeats: int) -> DataFrame:
    """Target of each source: its weight's part of share x all sizes, filled like water up to repeats x its size."""
    per = cells.groupBy(f"{P}none", f"{P}src").agg(F.sum(f"{P}bytes").alias(f"{P}source_size"))
    ranked = per.withColumn(f"{P}rank", F.row_number().over(Window.orderBy(f"{P}none", f"{P}src")))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col(f"{P}rank") - 1) % len(weights) + 1).cast("int"))
    every = Window.partitionBy(F.lit(0))
    up = Window.partitionBy(F.lit(0)).orderBy(f"{P}ratio", f"{P}rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    f = (
        ranked.withColumn(f"{P}w", w)
        .withColumn(f"{P}most", F.col(f"{P}source_size") * F.lit(float(repeats)))
        .withColumn(f"{P}ratio", F.col(f"{P}most") / F.col(f"{P}w"))
        .withColumn(f"{P}budget", F.lit(share) * F.sum(f"{P}source_size").over(every))
        .withColumn(f"{P}w_left", F.sum(f"{P}w").over(every) - F.sum(f"{P}w").over(up) + F.col(f"{P}w"))
        .withColumn(f"{P}level", (F.col(f"{P}budget") - (F.sum(f"{P}most").over(up) - F.col(f"{P}most"))) / F.col(f"{P}w_left"))
    )
    # level: the water level if all sources from this one on, in order of ratio, stay below their limit; the first that does fixes it
    fits = F.when(F.col(f"{P}ratio") >= F.col(f"{P}level"), F.struct(f"{P}ratio", f"{P}rank", f"{P}level"))
    full = f.withColumn(f"{P}at", F.min(fits).over(every)[f"{P}level"])
    target = F.when(F.col(f"{P}at").isNull(), F.col(f"{P}most")).otherwise(F.least(F.col(f"{P}most"), F.col(f"{P}at") * F.col(f"{P}w")))
    return full.select(f"{P}none", f"{P}src", f"{P}rank", f"{P}source_size", target.cast("double").alias(f"{P}target"), f"{P}budget")


def _positions(sized: DataFrame, offsets: DataFrame, key: str) -> DataFrame:
    """Adds the finish time of a document's first packet; one shuffle, by cell."""
    w = Window.partitionBy(f"{P}none", f"{P}src", f"{P}cell").orderBy(f"{P}h", key, f"{P}size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = sized.withColumn(f"{P}run", F.sum(f"{P}size").over(w))
    return run.join(offsets, [f"{P}none", f"{P}src", f"{P}cell"], "left").withColumn(f"{P}cum", F.col(f"{P}run") + F.col(f"{P}before"))


def _finish(epoch) -> Column:
    return F.try_divide((F.col(f"{P}cum") + F.col(f"{P}source_size") * epoch).cast("double"), F.col(f"{P}target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, whole: bool = True, keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns `keep`) with size, source_size, target and taken, in words.

    With `whole`, documents are taken whole, 0 to `repeats` times; else each source's last one is taken in part, so that
    the source meets its target.

    Null texts have size 0 and are never taken; null sources are one source, the last; repeated rows are packets of
    their own; ties in the shuffled order are broken by key and size, beyond which rows are alike. Input columns named
    like an output column are replaced. An empty table gives an empty result.
    """
    out = ["size", "source_size", "target", "taken"]
    columns = [c for c in (docs.columns if keep is None else keep) if c not in out]
    need = list(dict.fromkeys([*columns, text, source, key]))
    docs = docs.select(*need)
    rows = docs.select(key).count()
    parts = max(1, -(-rows // max(CELL_ROWS, math.isqrt(rows))))
    narrow = stored(_sized(docs, text, source, key, parts).select(key, f"{P}size", f"{P}h", f"{P}none", f"{P}src", f"{P}cell", *[c for c in columns if keep is not None and c != key]), "mix-sizes")
    cells = stored(narrow.groupBy(f"{P}none", f"{P}src", f"{P}cell").agg(F.sum(f"{P}size").alias(f"{P}bytes")), "mix-cells")
    targets = source_targets(cells, weights, share, repeats)
    by = Window.partitionBy(f"{P}none", f"{P}src").orderBy(f"{P}cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stored(cells.withColumn(f"{P}before", F.coalesce(F.sum(f"{P}bytes").over(by), F.lit(0))).drop(f"{P}bytes").join(targets, [f"{P}none", f"{P}src"]), "mix-offsets")
    placed = stored(_positions(narrow, offsets, key), "mix-places")
    cut = _cut(placed, parts, repeats)
    if not whole:
        served = stored(_served(placed, cut, repeats), "mix-served")
    if keep is None:  # whole rows: one shuffle of the texts
        placed = _positions(_sized(docs, text, source, key, parts), offsets, key)
    if not whole:
        placed = placed.join(F.broadcast(served), [f"{P}none", f"{P}src"], "left")
    took, words = F.lit(0), F.lit(0)
    for epoch in range(repeats):
        inside = _within(cut, F.lit(epoch))
        # whole up to the cut; there a source's last packet gives back what is beyond its target, or the next one is taken in part
        took = took + F.when(inside, 1).otherwise(0)
        if not whole:
            end = F.col(f"{P}cum") + F.col(f"{P}source_size") * F.lit(epoch)
            due = F.floor(f"{P}target") - F.coalesce(f"{P}served", F.lit(0))
            back = F.least(F.col(f"{P}size"), F.greatest(F.lit(0), end - F.floor(f"{P}target")))
            more = F.least(F.col(f"{P}size"), F.greatest(F.lit(0), F.col(f"{P}served") + due - (end - F.col(f"{P}size"))))
            words = words + F.when(inside, F.col(f"{P}size") - F.when(due < 0, back).otherwise(0)).otherwise(F.when(due > 0, more).otherwise(0))
    return placed.select(
        *columns,
        F.col(f"{P}size").alias("size"),
        F.col(f"{P}source_size").alias("source_size"),
        F.col(f"{P}target").alias("target"),
        F.when(F.col(f"{P}size") > 0, F.col(f"{P}size") * took if whole else words).otherwise(0).cast("long").alias("taken"),
    )


def _within(cut: tuple[float, int] | None, epoch: Column) -> Column:
    """Whether a packet is within the cut, in order of finish time and rank."""
    if cut is None:
        return F.lit(False)
    f = _finish(epoch)
    return F.coalesce((f < cut[0]) | ((f == cut[0]) & (F.col(f"{P}rank") <= cut[1])), F.lit(False))


def _served(placed: DataFrame, cut: tuple[float, int] | None, repeats: int) -> DataFrame:
    """Words that each source has by its packets within the cut."""
    times = sum((F.when(_within(cut, F.lit(e)), 1).otherwise(0) for e in range(repeats)), F.lit(0))
    return placed.groupBy(f"{P}none", f"{P}src").agg(F.sum(F.col(f"{P}size") * times).alias(f"{P}served"))


def _cut(placed: DataFrame, parts: int, repeats: int) -> tuple[float, int] | None:
    """Finish time and source rank of the last packet within the budget, in order of finish time and rank."""
    packets = (
        placed.filter(F.col(f"{P}size") > 0)
        .select(f"{P}size", f"{P}rank", f"{P}budget", F.explode(F.array(*[_finish(F.lit(e)) for e in range(repeats)])).alias(f"{P}f"))
        .withColumn(f"{P}range", F.floor(F.col(f"{P}f") * F.lit(float(parts))))
    )
    sums = packets.groupBy(f"{P}range").agg(F.sum(f"{P}size").alias(f"{P}bytes"), F.max(f"{P}budget").alias(f"{P}budget"))
    run = sums.withColumn(f"{P}upto", F.sum(f"{P}bytes").over(Window.orderBy(f"{P}range").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    edge = run.filter(F.col(f"{P}upto") > F.col(f"{P}budget")).agg(F.min(F.struct(f"{P}range", (F.col(f"{P}upto") - F.col(f"{P}bytes")).alias("before"), f"{P}budget"))).first()[0]
    if edge is None:  # all packets fit, or there are none
        last = packets.agg(F.max(F.struct(f"{P}f", f"{P}rank"))).first()[0]
        return None if last is None else (float(last[0]), int(last[1]))
    within = packets.filter(F.col(f"{P}range") == edge[0])
    order = Window.partitionBy(f"{P}range").orderBy(f"{P}f", f"{P}rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = within.withColumn(f"{P}upto", F.sum(f"{P}size").over(order) + F.lit(edge[1])).filter(F.col(f"{P}upto") <= F.col(f"{P}budget")).agg(F.max(F.struct(f"{P}f", f"{P}rank"))).first()[0]
    if last is None:  # the last packet of the range before: all before the range are in
        return (float(edge[0]) / parts, 0)
    return float(last[0]), int(last[1])


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself, of a table mixed whole: each document as often as it is taken; those not taken, and empty ones, go."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn(f"{P}copies", F.array_repeat(F.lit(1), times)).withColumn(f"{P}copy", F.explode(f"{P}copies")).drop(f"{P}copies", f"{P}copy", "size", "source_size", "target", "taken")


def op2_mix(spark, sf_dir: str) -> DataFrame:
    """Words of every document that the mix takes; each source meets its target. Nulls, ties and empty tables: see `mix`."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), whole=False, keep=["doc_id"])
