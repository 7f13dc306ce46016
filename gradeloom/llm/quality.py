"""Quality classifier: naive Bayes support vectors.

Features are n-gram indicators over two views of the whole text: runs of up to three word shapes (case, ends, length,
and whether the word or the word pair came before in the text) and lower-cased words. Indicators are scaled by the
log-count ratio of the classes; a linear hinge-loss model is fitted by dual coordinate descent and its margin becomes a
probability by a logistic fit. Labels, lang, source and ids are never inputs of a score.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gradeloom.llm import bytetext as B
from gradeloom.runtime import ship

#: Labelled rows that the fit sees at most, those with the smallest hash of id and text.
MOST_ROWS = 8000
DIMENSIONS = 1 << 18
SMOOTHING, COST, ROUNDS, FOLDS = 1.0, 1.0, 20, 3
THRESHOLD = 0.3
#: Bytes of text whose indicators a task holds at once, whole texts.
SLICE = 1 << 20

# classes of a byte: other, lower, upper, digit, beyond ASCII; ASCII marks are classes of their own
_CLASS = np.zeros(256, np.uint64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
for _i, _c in enumerate(b"!\"#$%&'()*+,-./:;<=>?@[]_{|}~"):
    _CLASS[_c] = 5 + _i
_LENGTHS = np.array([1, 2, 3, 5, 8, 12, 20])


def features(piece: pa.RecordBatch, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Row and feature of every indicator that is on, once each, in order of row."""
    raw, at = B.utf8(piece.column(text))
    starts, ends, row = B.word_bounds(raw, at, B.NOT_SPACE)
    n = len(starts)
    word = B.span_hashes(B.LOWER[raw], starts, ends)
    shape = _CLASS[raw[starts]] + np.uint64(64) * _CLASS[raw[ends - 1]] + np.uint64(4096) * np.searchsorted(_LENGTHS, ends - starts, "right").astype(np.uint64)
    second = np.minimum(starts + 1, ends - 1)
    shape += np.uint64(1 << 16) * _CLASS[raw[second]]
    same_row = np.zeros(n, bool)
    same_row[1:] = row[1:] == row[:-1]
    last = np.zeros(n, bool)
    last[1:] = same_row[1:] & (word[1:] == word[:-1])
    pair = np.zeros(n, np.uint64)
    pair[1:] = word[:-1] * np.uint64(0xD6E8FEB86659FD93) + word[1:]
    # the pair came before in the same text
    order = np.lexsort((np.arange(n), pair, row))
    again = np.zeros(n, bool)
    again[order[1:]] = (pair[order[1:]] == pair[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    again &= same_row
    shape += np.uint64(1 << 24) * last.astype(np.uint64) + np.uint64(1 << 25) * again.astype(np.uint64)
    found = [(row, B.mix64(word + np.uint64(11)))]
    gram, ok = B.mix64(shape + np.uint64(1)), np.ones(n, bool)
    found.append((row, gram))
    for k in (1, 2, 3):
        ok = ok[1:] & (row[k:] == row[:-k])
        gram = B.mix64(gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + shape[k:] + np.uint64(k))
        found.append((row[k:][ok], gram[ok]))
    # runs of repeated pairs: the longest, by power of two
    m = len(again)
    if m:
        run = np.arange(m) - np.maximum.accumulate(np.where(again, -1, np.arange(m)))
        found.append((row[run > 0], B.mix64(np.floor(np.log2(run[run > 0])).astype(np.uint64) + np.uint64(1 << 40))))
    # share of repeated pairs and of words followed by the same mark, in tenths
    size = np.maximum(1, np.bincount(row, minlength=piece.num_rows))
    mark = (_CLASS[raw[ends - 1]] > 4).astype(np.float64) if n else np.zeros(0)
    upper = (_CLASS[raw[starts]] == 2).astype(np.float64) if n else np.zeros(0)
    for i, x in enumerate((again.astype(np.float64), mark, upper)):
        tenth = np.floor(np.bincount(row, x, piece.num_rows) / size * 10).astype(np.uint64)
        found.append((np.arange(piece.num_rows), B.mix64(tenth + np.uint64((2 << 40) + i * 64))))
    rows = np.concatenate([r for r, _ in found]).astype(np.int64)
    ids = (np.concatenate([f for _, f in found]) % np.uint64(DIMENSIONS)).astype(np.int64)
    both = np.unique(rows * DIMENSIONS + ids)
    return both // DIMENSIONS, both % DIMENSIONS


class Rows:
    """Feature ids and values of the examples, each in one flat array; rows from first[i] to first[i + 1]."""

    def __init__(self, ids: np.ndarray, first: np.ndarray):
        self.ids, self.first = ids, first
        self.values = np.zeros(0, np.float32)

    def scaled(self, ratio: np.ndarray) -> None:
        """Every indicator becomes its ratio; rows of more than length 1 are shortened to it."""
        self.values = ratio.astype(np.float32)[self.ids]
        for i in range(len(self.first) - 1):
            own = self.values[self.first[i] : self.first[i + 1]]
            own /= math.sqrt(max(1.0, float((own.astype(np.float64) ** 2).sum())))

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.ids[self.first[i] : self.first[i + 1]], self.values[self.first[i] : self.first[i + 1]]

    def counts(self, of: np.ndarray) -> np.ndarray:
        """Number of the rows `of` that have each feature."""
        out = np.zeros(DIMENSIONS)
        for i in range(0, len(of), 512):
            out += np.bincount(np.concatenate([self.row(j)[0] for j in of[i : i + 512]] or [self.ids[:0]]), minlength=DIMENSIONS)
        return out


def _descend(x: Rows, of: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Dual coordinate descent on the hinge loss over the rows `of`; the bias is a feature that is always 1."""
    sign = np.where(y > 0, 1.0, -1.0)
    cost = COST * len(y) / (2 * np.where(y > 0, (y > 0).sum(), (y == 0).sum()))  # classes weigh alike
    norm = np.array([float((x.row(i)[1] ** 2).sum()) + 1.0 for i in of])
    w, bias, alpha = np.zeros(DIMENSIONS), 0.0, np.zeros(len(y))
    draw = np.random.default_rng(7)
    for _ in range(ROUNDS):
        change = 0.0
        for i in draw.permutation(len(y)):
            ids, values = x.row(of[i])
            g = sign[i] * (float(w[ids] @ values) + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            d = (new - alpha[i]) * sign[i]
            if d:
                w[ids] += d * values
                bias += d
                change = max(change, abs(d))
                alpha[i] = new
        if change < 1e-3:
            break
    return w, bias


def fit(x: Rows, y: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights over the indicators (ratio included), and slope and offset of the logistic fit.

    No rows, or rows of one class: the class's smoothed share for all texts.
    """
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return np.zeros(DIMENSIONS), 1.0, math.log(p / (1 - p))
    pos, neg = (SMOOTHING + x.counts(np.flatnonzero(y == c)) for c in (1, 0))
    ratio = np.log((pos / pos.sum()) / (neg / neg.sum()))
    ratio[(pos + neg) < 2 * SMOOTHING + 2] = 0.0  # seen once: no evidence
    x.scaled(ratio)
    every = np.arange(len(y))
    w, bias = _descend(x, every, y)
    # margins of rows that a model of the other rows sees for the first time
    margin = np.empty(len(y))
    for f in range(FOLDS):
        out = every % FOLDS == f
        if min(np.bincount(y[~out], minlength=2)) == 0 or not out.any():
            other = (w, bias)
        else:
            other = _descend(x, every[~out], y[~out])
        for i in np.flatnonzero(out):
            ids, values = x.row(i)
            margin[i] = float(other[0][ids] @ values) + other[1]
    slope, offset = 1.0, 0.0
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y == 0).sum() + 2))
    for _ in range(50):  # Newton steps of the logistic fit
        p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
        s = p * (1 - p) + 1e-9
        gradient = np.array([((p - target) * margin).sum() + 1e-3 * slope, (p - target).sum()])
        hessian = np.array([[(s * margin**2).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(hessian, gradient)
        slope, offset = slope - step[0], offset - step[1]
        if np.abs(step).max() < 1e-9:
            break
    # ratio and weight in one table; the norm needs the ratio alone
    return np.stack([w * ratio, ratio**2]), float(slope), float(offset + slope * bias)


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", folds: int = 5, held: int = 0, most_rows: int = MOST_ROWS):
    """The model, from labelled rows outside the held-out fold, at most `most_rows` of them by hash of the key.

    Null keys and null labels are left out; of several labels of a key the largest counts, of several texts the one with
    the smallest hash; a null text is an empty one. Other columns are not read. With no labelled text, or labels of one
    class, the model gives all texts one score. The fit runs in one task, which holds 8 bytes for each indicator of the
    chosen rows; the driver gets the weights alone.
    """
    ship(docs.sparkSession)
    outside = F.pmod(F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), F.lit(folds)) != held
    marked = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & outside).groupBy(key).agg(F.max(label).alias("__label"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(most_rows)
    rows = docs.select(key, text).join(F.broadcast(chosen), key)  # at most most_rows rows of two numbers

    def run(batches):
        for batch in batches:
            for piece in B.slices(batch, text, SLICE):
                row, ids = features(piece, text)
                cut = np.searchsorted(row, np.arange(piece.num_rows + 1))
                data = [ids[a:b].astype(np.int32).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([piece.column("k"), piece.column("h"), piece.column("__label").cast(pa.int32()), pa.array(data, pa.binary())], ["k", "h", "y", "x"])

    def fitted(batches):
        k, y, x = [], [], []
        for batch in batches:
            k.append(batch.column("k").to_numpy())
            y.append(batch.column("y").to_numpy())
            x.append(batch.column("x"))
        if not k:
            return
        order = np.argsort(np.concatenate(k), kind="stable")
        data = [v.as_buffer() for c in x for v in c]
        first = np.concatenate([[0], np.cumsum([data[i].size // 4 for i in order])])
        ids = np.empty(first[-1], np.int32)
        for n, i in enumerate(order):
            ids[first[n] : first[n + 1]] = np.frombuffer(data[i], np.int32)
        data, x = [], None
        table, slope, offset = fit(Rows(ids, first), np.concatenate(y)[order])
        yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary()), pa.array([table.ndim]), pa.array([slope]), pa.array([offset])], ["w", "n", "slope", "offset"])

    # repeated rows of a key are one example; keys of any type are compared by their hash
    of = rows.select(F.xxhash64(key).alias("k"), F.xxhash64(text).alias("h"), text, "__label").mapInArrow(run, "k bigint, h bigint, y int, x binary")
    one = of.groupBy("k").agg(F.max("y").alias("y"), F.min_by("x", "h").alias("x"))
    got = one.repartition(1).mapInArrow(fitted, "w binary, n bigint, slope double, offset double").first()
    if got is None:
        return fit(Rows(np.zeros(0, np.int32), np.zeros(1, np.int64)), np.zeros(0, np.int64))
    table = np.frombuffer(bytes(got["w"]))
    return table.reshape(2, -1) if got["n"] == 2 else table, got["slope"], got["offset"]


def score(docs: DataFrame, model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold, else 0).

    Null and empty texts have the few indicators of an empty text and so one score. Repeated rows are scored alike. Input
    columns of these names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = docs.drop("score", "predicted")
    names, shared = docs.columns, spark.sparkContext.broadcast(model)

    def run(batches):
        table, slope, offset = shared.value
        for batch in batches:
            for piece in B.slices(batch, text, SLICE):
                n = piece.num_rows
                if table.ndim == 1:
                    margin = np.zeros(n)
                else:
                    row, ids = features(piece, text)
                    margin = np.bincount(row, table[0][ids], n) / np.sqrt(np.maximum(1.0, np.bincount(row, table[1][ids], n)))
                p = 1 / (1 + np.exp(-np.clip(slope * margin + offset, -30, 30)))
                yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*names, "score", "predicted"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document. Nulls, labels and empty tables: see `learn` and `score`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0
    return score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")
