"""Linear systems as column expressions, and the confidence model as an estimator that fits, saves, loads and transforms."""

from __future__ import annotations

import itertools

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gradeloom.operators import gate
from gradeloom.operators.refresh import LEAST_EXAMPLES, PRIOR_WEIGHTS
from gradeloom.plans.evidence import query
from gradeloom.runtime import run_folder, stored

#: A pivot below it makes a system singular.
LEAST_PIVOT = 1e-12


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def solved(rows: Column, n: int) -> Column:
    """The solution of n equations, an array; `rows` has n arrays of n coefficients and the right side. Null where it is singular or null.

    Elimination of one unknown after the other from all other rows, each by the row with its largest coefficient.
    """

    def pivoted(k: Column, m: Column) -> Column:
        """The row with the largest k-th coefficient among those from k on comes to place k."""
        return _let(F.transform(m, lambda r, i: F.when(i >= k, F.abs(r[k])).otherwise(-1.0)), lambda size: _let(
            F.array_position(size, F.array_max(size)).cast("int") - 1,
            lambda p: F.transform(m, lambda r, i: F.when(i == k, F.get(m, p)).when(i == p, m[k]).otherwise(r)),
        ))

    def cleared(k: Column, m: Column) -> Column:
        row = F.when(F.abs(m[k][k]) >= LEAST_PIVOT, F.transform(m[k], lambda v: v / m[k][k]))
        return _let(row, lambda one: F.when(one.isNotNull(), F.transform(m, lambda r, i: F.when(i == k, one).otherwise(F.zip_with(r, one, lambda a, b: a - r[k] * b)))))

    whole = F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), rows, lambda m, k: _let(pivoted(k, m), lambda q: cleared(k, q)))
    return F.transform(whole, lambda r: r[n])


def normal_rows(names: list[str], ridge: float, prior: list[float]) -> tuple[list[Column], Column]:
    """The sums of products of columns x0.. and y, and from them (as a struct `s`) the rows of the ridge system shrunk towards the prior."""
    pairs = list(itertools.combinations_with_replacement(range(len(names)), 2))
    sums = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i, j in pairs] + [F.sum(F.col(f"x{i}") * F.col("y")).alias(f"q{i}") for i in range(len(names))]
    at = lambda i, j: F.col(f"p{min(i, j)}_{max(i, j)}") + (ridge if i == j else 0.0)
    return sums, F.array(*[F.array(*[at(i, j) for j in range(len(names))], F.col(f"q{i}") + ridge * prior[i]) for i in range(len(names))])


class _Agreement(Params):
    features = Param(Params._dummy(), "features", "columns of the features, 'bias' for the constant", TypeConverters.toListString)
    target = Param(Params._dummy(), "target", "column of the target", TypeConverters.toString)
    prediction = Param(Params._dummy(), "prediction", "column of the confidence", TypeConverters.toString)


class AgreementRegression(Estimator, _Agreement, DefaultParamsReadable, DefaultParamsWritable):
    """Ridge regression towards prior weights, in closed form.

    Features and target are held to 0..1, null features are 0, rows without a target do not count. Fewer rows than
    LEAST_EXAMPLES, and a singular system, leave the prior.
    """

    ridge = Param(Params._dummy(), "ridge", "pull towards the prior", TypeConverters.toFloat)
    prior = Param(Params._dummy(), "prior", "prior weights of the features", TypeConverters.toListFloat)

    def __init__(self, prior: dict[str, float] = PRIOR_WEIGHTS, ridge: float = 1.0, target: str = "target"):
        super().__init__()
        self._set(features=list(prior), prior=list(prior.values()), ridge=ridge, target=target, prediction="confidence")

    def _fit(self, dataset: DataFrame) -> AgreementModel:
        names, prior = self.getOrDefault("features"), self.getOrDefault("prior")
        unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c.cast("double")))
        xs = [F.lit(1.0) if n == "bias" else unit(F.coalesce(F.col(n).cast("double"), F.lit(0.0))) for n in names]
        y = F.col(self.getOrDefault("target"))
        rows = dataset.filter(y.isNotNull()).select(*[x.alias(f"x{i}") for i, x in enumerate(xs)], unit(y).alias("y"))
        sums, system = normal_rows(names, self.getOrDefault("ridge"), prior)
        got = rows.agg(F.count(F.lit(1)).alias("n"), *sums).select("n", F.when(F.col("n") >= LEAST_EXAMPLES, solved(system, len(names))).alias("w")).first()
        return AgreementModel(names, list(got.w) if got.w else prior, got.n, self.getOrDefault("prediction"))


class AgreementModel(Model, _Agreement, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the chance that a review would keep a score."""

    weights = Param(Params._dummy(), "weights", "weights of the features", TypeConverters.toListFloat)
    examples = Param(Params._dummy(), "examples", "rows it was fitted on", TypeConverters.toInt)

    def __init__(self, features: list[str] | None = None, weights: list[float] | None = None, examples: int = 0, prediction: str = "confidence"):
        super().__init__()
        self._set(features=features or [], weights=weights or [], examples=examples, prediction=prediction)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        weights = dict(zip(self.getOrDefault("features"), self.getOrDefault("weights"), strict=True))
        return dataset.withColumn(self.getOrDefault("prediction"), gate.confidence({n: F.col(n) for n in weights if n != "bias"}, weights))


def ma12_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of each assignment's ridge system: the score by a constant, the item's weight and its concept."""
    rows = query("SELECT assignment_id, score AS y, 1e0 AS x0, weight / 50e0 AS x1, concept / 5e0 AS x2 FROM item")(spark, sf_dir)
    sums, system = normal_rows(["x0", "x1", "x2"], 1.0, [0.0, 0.0, 0.0])
    w = rows.groupBy("assignment_id").agg(*sums).select("assignment_id", solved(system, 3).alias("w"))
    return w.select("assignment_id", *[F.round(F.col("w")[i], 6).alias(f"w{i}") for i in range(3)])


def x6_confidence_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The confidence model fitted on the items of overridden runs, saved, loaded, and what it gives over all items, by feature."""
    # the fit and the mean read the features, which are made once
    items = stored(gate.item_features(gate.item_facts(spark, sf_dir)).select("run_id", "raw_", *[n for n in PRIOR_WEIGHTS if n != "bias"]), "item-features")
    human = query("SELECT v.run_id, v.total FROM verdict v WHERE v.state = 'overridden'")(spark, sf_dir)
    model = AgreementRegression().fit(items.join(human, "run_id").withColumn("target", 1 - F.abs(F.col("raw_") - F.col("total"))))
    path = run_folder(spark, "confidence-model")
    model.save(path)
    loaded = AgreementModel.load(path)
    mean = loaded.transform(items).agg(F.avg("confidence")).first()[0]
    w = spark.createDataFrame(list(zip(loaded.getOrDefault("features"), loaded.getOrDefault("weights"), strict=True)), "feature string, weight double")
    return w.select("feature", F.round("weight", 6).alias("weight"), F.lit(loaded.getOrDefault("examples")).cast("long").alias("n"), F.round(F.lit(mean), 6).alias("mean_confidence"))


def queries() -> dict:
    return {f.__name__: f for f in (ma12_solve, x6_confidence_model)}


def oracle_sql() -> dict[str, str]:
    """Cramer's rule for three unknowns."""
    det = "({a} * ({e} * {i} - {f} * {h}) - {b} * ({d} * {i} - {f} * {g}) + {c} * ({d} * {h} - {e} * {g}))"
    m = dict(zip("abcdefghi", ["n + 1e0", "s1", "s2", "s1", "s11 + 1e0", "s12", "s2", "s12", "s22 + 1e0"], strict=True))
    m = {k: f"({v})" for k, v in m.items()}
    tops = [det.format(**(m | dict(zip(col, ["sy", "s1y", "s2y"], strict=True)))) for col in ("adg", "beh", "cfi")]
    w = ", ".join(f"round({t} / {det.format(**m)}, 6) AS w{i}" for i, t in enumerate(tops))
    return {"ma12_solve": f"WITH x AS (SELECT assignment_id, score AS y, weight / 50e0 AS x1, concept / 5e0 AS x2 FROM item), s AS (SELECT assignment_id, count(*) * 1e0 AS n, sum(x1) AS s1, sum(x2) AS s2, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(y) AS sy, sum(x1 * y) AS s1y, sum(x2 * y) AS s2y FROM x GROUP BY assignment_id) SELECT assignment_id, {w} FROM s"}
