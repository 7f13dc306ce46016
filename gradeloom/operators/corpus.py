"""One text in a hundred against the corpus: shared prints counted where the other text lies, and the screen over the scores.

A text's prints are made in its own row, each time they are asked for, so no table of words or prints is shuffled. The
prints of the texts that ask are 1 % of all; every task gets them and counts what its own texts share with them.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gradeloom.runtime import ship

#: Words of a gram, grams of a window, the share of texts that makes a print common and the least number of
#: texts for it, which keys ask.
GRAM, WINDOW, COMMON_SHARE, COMMON_LEAST, EVERY = 5, 4, 0.4, 3, 100
#: Prints that a task holds at a time.
HELD = 1 << 20
_APART = re.compile("[^a-z0-9]+")


def prints(text: str | None) -> set[bytes]:
    """The least digest of each WINDOW grams in a row; of fewer grams all. Text is in lower case."""
    if text is None:
        return set()
    words = _APART.split(text)
    digests = [hashlib.md5(" ".join(words[i : i + GRAM]).encode()).digest() for i in range(len(words) - GRAM + 1)]
    if len(digests) < WINDOW:
        return set(digests)
    return set(map(min, *[digests[k : len(digests) - WINDOW + 1 + k] for k in range(WINDOW)]))


def _halves(digests: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(digests, "V16").view("<u8").reshape(-1, 2)
    return np.ascontiguousarray(x[:, 0]), np.ascontiguousarray(x[:, 1])


def _pieces(batches, common: frozenset[bytes] = frozenset()):
    """(keys, number of prints of each, their digests) of texts of about HELD prints."""
    keys, sizes, held = [], [], []
    for batch in batches:
        for key, text in zip(batch.column(0), batch.column(1), strict=True):
            own = prints(text.as_py()) - common
            keys.append(key.as_py())
            sizes.append(len(own))
            held.extend(own)
            if len(held) >= HELD:
                yield keys, np.array(sizes), b"".join(held)
                keys, sizes, held = [], [], []
    if keys:
        yield keys, np.array(sizes), b"".join(held)


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(key).cast("long").alias("id"), F.lower(F.col(text)).alias("text"))


def common_prints(texts: DataFrame, rows: int) -> frozenset[bytes]:
    """Prints of COMMON_SHARE of the texts.

    Such a print has that share of one piece at least, so pieces name those that may be common, some hundred each; only
    where there are any, they are counted over all texts.
    """
    least = max(COMMON_LEAST, int(np.floor(COMMON_SHARE * rows)))

    def named(batches):
        for keys, _, held in _pieces(batches):
            found, n = np.unique(np.frombuffer(held, "V16").view("S16") if held else np.empty(0, "S16"), return_counts=True)
            some = [x.ljust(16, b"\0") for x in found[n >= least / rows * len(keys) - 1e-9].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary())], ["h"])

    maybe = frozenset(bytes(r.h) for r in texts.mapInArrow(named, "h binary").distinct().toLocalIterator()) if rows else frozenset()
    if not maybe:
        return maybe

    def counted(batches):
        n: dict[bytes, int] = {}
        for batch in batches:
            for text in batch.column(1):
                for h in prints(text.as_py()) & maybe:
                    n[h] = n.get(h, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["h", "n"])

    total = texts.mapInArrow(counted, "h binary, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
    return frozenset(bytes(r.h) for r in total.select("h").toLocalIterator())


def pair_scores(docs: DataFrame, *, key: str = "doc_id", text: str = "text", every: int = EVERY) -> DataFrame:
    """a, b, score: each text whose key is divisible by `every`, all others that share a print with it, and the Jaccard similarity of their prints.

    Prints that COMMON_SHARE of the texts have are left out. Null texts have no prints. An empty table gives an empty result.
    """
    texts = _texts(docs, key, text)
    common = common_prints(texts, docs.count())

    def asked(batches):
        for keys, sizes, held in _pieces(batches, common):
            hi, lo = _halves(held)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(keys, np.int64), sizes)), pa.array(np.repeat(sizes, sizes)), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64))], ["a", "n", "hi", "lo"])

    rows = texts.filter(F.col("id") % every == 0).mapInArrow(asked, "a bigint, n bigint, hi bigint, lo bigint").toArrow()
    hi = rows["hi"].to_numpy().view(np.uint64)
    order = np.argsort(hi, kind="stable")
    ask = docs.sparkSession.sparkContext.broadcast((hi[order], rows["lo"].to_numpy().view(np.uint64)[order], rows["a"].to_numpy()[order], rows["n"].to_numpy()[order]))

    def met(batches):
        q_hi, q_lo, q_a, q_n = ask.value
        for keys, sizes, held in _pieces(batches, common):
            hi, lo = _halves(held)
            row = np.repeat(np.arange(len(keys)), sizes)
            first, end = np.searchsorted(q_hi, hi, "left"), np.searchsorted(q_hi, hi, "right")
            hit = np.flatnonzero(end > first)
            k = (end - first)[hit]
            upto = np.cumsum(k)
            edge = [0, *np.searchsorted(upto, np.arange(HELD, upto[-1] if len(upto) else 0, HELD)).tolist(), len(hit)]
            # a text's prints stay together: pieces end where a text does
            edge = sorted({0, len(hit), *(int(np.searchsorted(row[hit], row[hit[e]], "left")) for e in edge[1:-1])})
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                at, times = hit[x:y], k[x:y]
                place = np.repeat(first[at] - np.cumsum(times) + times, times) + np.arange(times.sum())
                mine = np.repeat(at, times)
                same = q_lo[place] == lo[mine]
                pair = np.stack([row[mine[same]], q_a[place[same]], q_n[place[same]]])
                order = np.lexsort(pair[:2])
                pair = pair[:, order]
                new = np.flatnonzero(np.concatenate([[True], (pair[0, 1:] != pair[0, :-1]) | (pair[1, 1:] != pair[1, :-1])])) if pair.shape[1] else np.empty(0, int)
                shared = np.diff(np.concatenate([new, [pair.shape[1]]]))
                b = np.array(keys, np.int64)[pair[0, new]]
                a, both = pair[1, new], pair[2, new] + sizes[pair[0, new]]
                keep = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array((shared / (both - shared))[keep])], ["a", "b", "score"])

    return texts.filter("id is not null").mapInArrow(met, "a bigint, b bigint, score double")


def screen(pairs: DataFrame) -> DataFrame:
    """a, n, top, median, p90 and z of each asking text's scores; median and p90 by nearest rank. Equal scores are one row with their number."""
    scores = pairs.groupBy("a", "score").agg(F.count(F.lit(1)).alias("k"))
    own, up = Window.partitionBy("a"), Window.partitionBy("a").orderBy("score").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = scores.withColumns({"n": F.sum("k").over(own), "upto": F.sum("k").over(up), "mean": F.sum(F.col("k") * F.col("score")).over(own) / F.sum("k").over(own)})
    at = lambda rank: F.min(F.when(F.col("upto") > F.floor(rank), F.col("score")))
    one = ranked.groupBy("a").agg(
        F.max("n").alias("n"), F.max("score").alias("top"), at(F.col("n") / 2.0).alias("median"), at(F.col("n") * 0.9).alias("p90"),
        F.max("mean").alias("mean"), F.sqrt(F.sum(F.col("k") * (F.col("score") - F.col("mean")) ** 2) / F.when(F.max("n") > 1, F.max("n") - 1)).alias("off"),
    )
    z = F.when((F.col("n") >= 4) & (F.col("off") > 1e-6), F.try_divide(F.col("top") - F.col("mean"), F.col("off"))).otherwise(0.0)
    return one.select("a", "n", "top", "median", "p90", z.alias("z"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def j18_one_vs_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth document with all that share a print with it."""
    return _pairs(spark, sf_dir).select("a", "b", F.round("score", 6).alias("score"))


def a32_corpus_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of every hundredth document's scores."""
    return screen(_pairs(spark, sf_dir)).select("a", "n", *[F.round(c, 6).alias(c) for c in ("top", "median", "p90")], F.round("z", 5).alias("z"))


def i4_outlier_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether every hundredth document's best score stands out."""
    out = (F.col("top") >= 0.55) & ((F.col("z") >= 2.5) | (F.col("n") < 4))
    return screen(_pairs(spark, sf_dir)).select("a", out.alias("outlier"), F.round(F.when(out, F.col("top")).otherwise(F.least("top", F.lit(0.5))), 6).alias("flag_score"))


def queries() -> dict:
    return {f.__name__: f for f in (j18_one_vs_corpus, a32_corpus_scores, i4_outlier_screen)}
