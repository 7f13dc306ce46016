"""Embedding whitening: MLlib's SVD of exactly centred rows, singular values rescaled by the divisor n."""

from __future__ import annotations

from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from gradeloom.runtime import ship, stored

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond it are taken as the bound itself; all integers up to it are exact doubles.
MOST = 1 << 53
#: Bytes of a batch's matrix of doubles that a Python worker holds at once.
SLICE = 8 << 20
LONG = (1 << 63) - 1


def whole_vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of the rows' vectors, -1 where the vector is null or holds a null or a non-finite entry; all entries as doubles."""
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten()
    entries = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls are NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    end = np.cumsum(size)
    length = np.where((bad[end] > bad[end - size]) | column.is_null().to_numpy(zero_copy_only=False), -1, size)
    return length, entries


def quantised(entries: np.ndarray) -> np.ndarray:
    """floor(64 c) + 1000000 as longs."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(entries * SCALE), -MOST, MOST).astype(np.int64) + SHIFT


def matrices(batch: pa.RecordBatch, column: str, length: int | None):
    """(rows, matrix of x) of a batch's vectors of one length, or of each length; in pieces of bounded size."""
    lengths, entries = whole_vectors(batch.column(column))
    size = pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(size) - size
    for d in np.unique(lengths[lengths >= 0]) if length is None else [length]:
        rows, step = np.flatnonzero(lengths == d), max(1, SLICE // (8 * max(1, int(d))))
        for i in range(0, len(rows), step):
            own = rows[i : i + step]
            yield own, quantised(entries[start[own][:, None] + np.arange(d)])


def packed(x: np.ndarray) -> list[bytes]:
    """The rows of x as bytes, of 4 bytes an entry where all of a row's fit."""
    narrow = (np.abs(x) < 1 << 31).all(1)
    small, wide = x.astype("<i4"), x.astype("<i8")
    return [(small if n else wide)[i].tobytes() for i, n in enumerate(narrow.tolist())]


def unpacked(column: pa.Array, length: int):
    """Matrices of x from their bytes, in pieces of bounded size."""
    step = max(1, SLICE // (8 * length))
    for i in range(0, len(column), step):
        rows = column.slice(i, step).to_pylist()
        if all(len(r) == 4 * length for r in rows):
            yield np.frombuffer(b"".join(rows), "<i4").reshape(-1, length).astype(np.int64)
        else:
            yield np.array([np.frombuffer(r, "<i4" if len(r) == 4 * length else "<i8").astype(np.int64) for r in rows])


def scaled_deviation(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, exact: longs where these hold it, else Python's integers."""
    if n * (MOST if not x.size else int(np.abs(x).max())) + max(map(abs, sums)) < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def squared(d: np.ndarray) -> list[int]:
    """The sum of squares of each row, exact."""
    if d.dtype != object and d.size and d.shape[1] * int(np.abs(d).max()) ** 2 > LONG:
        d = d.astype(object)
    return (d * d).sum(1).tolist()


def fit_list(vectors: DataFrame, column: str) -> DataFrame:
    """Each distinct x vector once: x (bytes) and d (its length), stored."""

    def run(batches):
        for batch in batches:
            for _, x in matrices(batch, "v", None):
                yield pa.RecordBatch.from_arrays([pa.array(packed(x), pa.binary()), pa.array(np.full(len(x), x.shape[1], np.int32))], ["x", "d"])

    return stored(vectors.select(F.col(column).alias("v")).mapInArrow(run, "x binary, d int").distinct(), "whitening-fit")


def totals(fit: DataFrame, length: int, of) -> dict[int, Decimal]:
    """Sums over the fit list of what `of` gives for each matrix: a row of integers; one row a task is sent."""

    def run(batches):
        held: list[int] = []
        for batch in batches:
            for x in unpacked(batch.column("x"), length):
                held = [a + b for a, b in zip(held or [0] * len(got), got, strict=True)] if (got := of(x)) else held
        yield pa.RecordBatch.from_arrays([pa.array(range(len(held)), pa.int32()), pa.array([str(v) for v in held], pa.string())], ["at", "s"])

    sent = fit.filter(F.col("d") == length).select("x").mapInArrow(run, "at int, s string")
    return {r["at"]: r["s"] for r in sent.groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}


def principal(fit: DataFrame, length: int, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns of the covariance with divisor n, by MLlib's SVD of the centred rows."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.mllib.linalg.distributed import RowMatrix
    from pyspark.mllib.util import MLUtils

    def centre(batches):
        for batch in batches:
            for x in unpacked(batch.column("x"), length):
                c = (scaled_deviation(x, n, sums) / n).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(np.arange(0, c.size + 1, length, dtype=np.int32), c.ravel())], ["c"])

    rows = fit.filter(F.col("d") == length).select("x").mapInArrow(centre, "c array<double>").select(array_to_vector("c").alias("c"))
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "c"), n, length).computeSVD(length)
    v = svd.V.toArray()
    return svd.s.toArray() ** 2 / n, v * np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])])


def whiten(vectors: DataFrame, *, vector: str = "embedding", key: str = "vec_id", components: int = 16) -> DataFrame:
    """key, component (from 1), n, deviation, whitened, explained and identity_error of every row with a whole vector.

    Rows whose vector is null or holds a null or non-finite entry are left out, and so are those of another length than
    most of the distinct vectors have (ties: the longest). Repeated rows and null keys stay; the fit list has each vector
    once. Vectors of fewer entries than `components` have as many components as entries. Components whose variance is
    not above rounding (a constant table, fewer distinct vectors than components) have a null whitened. `explained`
    is null where there is no variance at all; `deviation` is null where it is beyond a long. Entries beyond 2^53 / 64
    count as that bound. A table without whole vectors gives an empty result. Only sums of bounded size (the square of
    the vectors' length at most) reach the driver.
    """
    spark = vectors.sparkSession
    ship(spark)
    names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
    kind = vectors.schema[key].dataType.simpleString()
    fit = fit_list(vectors, vector)
    sizes = sorted(((r["count"], r["d"]) for r in fit.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()), reverse=True)
    if not sizes or not sizes[0][1]:
        return spark.createDataFrame([], f"`{key}` {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double")
    n, length = sizes[0]
    shown = min(components, length)
    by_entry = totals(fit, length, lambda x: [int(v) for v in x.astype(object).sum(0)] if np.abs(x).max() * len(x) > LONG >> 1 else x.sum(0).tolist())
    sums = [int(by_entry[i]) for i in range(length)]
    total = int(totals(fit, length, lambda x: [sum(squared(scaled_deviation(x, n, sums)))])[0])
    value, unit = principal(fit, length, n, sums) if total else (np.zeros(0), np.zeros((length, 0)))
    real = int((value[:shown] > length * np.finfo(float).eps * value[0]).sum()) if total else 0
    turn = unit[:, :real] / np.sqrt(value[:real])
    value = np.append(value, np.zeros(length))[:shown]
    trace = Fraction(total, n**3)

    def cross(batches):
        held = np.zeros((real, real + 1))
        for batch in batches:
            for x in unpacked(batch.column("x"), length):
                w = (scaled_deviation(x, n, sums) / n).astype(np.float64) @ turn
                held += w.T @ np.column_stack([w, np.ones(len(w))])
        yield pa.RecordBatch.from_arrays([pa.array(range(held.size), pa.int32()), pa.array(held.ravel())], ["at", "s"])

    error = 0.0
    if real:
        sent = fit.filter(F.col("d") == length).select("x").mapInArrow(cross, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect()
        m = np.array([s for _, s in sorted((r["at"], r["s"]) for r in sent)]).reshape(real, real + 1) / n
        error = float(np.abs(m[:, :-1] - np.outer(m[:, -1], m[:, -1]) - np.eye(real)).max())

    def project(batches):
        for batch in batches:
            for own, x in matrices(batch, "v", length):
                d = scaled_deviation(x, n, sums)
                w = np.full((len(x), shown), np.nan)
                w[:, :real] = (d / n).astype(np.float64) @ turn
                entries = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
                deviation = pa.array([v if v <= LONG else None for v in squared(d)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("k").take(pa.array(own)), deviation, pa.ListArray.from_arrays(np.arange(0, w.size + 1, shown, dtype=np.int32), entries)], ["k", "deviation", "w"])

    rows = vectors.select(F.col(key).alias("k"), F.col(vector).alias("v")).mapInArrow(project, f"k {kind}, deviation bigint, w array<double>")
    shares = F.array(*[F.lit(float(Fraction(float(e)) / trace) if total else None).cast("double") for e in value])
    return rows.select("k", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        F.col("k"), (F.col("i") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", F.element_at(shares, F.col("i") + 1).alias("explained"), F.lit(error).alias("identity_error")
    ).toDF(*names)


def op11_whiten(spark, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding. Nulls, other lengths, ties and empty tables: see `whiten`."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
