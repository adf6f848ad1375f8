"""Seeded split, least squares and its scores."""

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations_with_replacement

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duefold.functions import absolute_error, named, squared_error
from duefold.functions.names import unused


@dataclass(frozen=True)
class ModelOptions:
    """What to learn from what. The defaults are fixed values."""

    test_size: float = 0.2
    seed: int = 3
    target: str = "price"
    features: Sequence[str] = field(
        default=(
            "engines",
            "passenger_capacity",
            "crew",
            "check_complete",
            "clearance_complete",
            "approved",
            "rating",
            "review_score",
        )
    )


# Hex digits of a prefix. The first level orders a million prefixes at most, and of a trillion
# rows a million hashes on average are left under one of them for the second.
_PREFIX = 5


def _check_share(test_size: float) -> None:
    if not 0 <= test_size <= 1:
        raise ValueError(f"the test share must lie between 0 and 1, not {test_size}")


def _with_hash(df: DataFrame, keys: Sequence[str], seed: int, name: str = "_hash") -> DataFrame:
    text = [F.coalesce(named(k).cast("string"), F.lit("")) for k in keys]
    return df.withColumn(name, F.md5(F.concat_ws("|", *text, F.lit(str(seed)))))


def split_point(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int = 3
) -> DataFrame:
    """The greatest hash on the test side when it holds ``ceil(test_size * rows)`` rows.

    One row with one text, null when the test side is empty. Two narrow passes over the keys:
    counts per hash prefix, then the hashes under the prefix that holds the cut.
    """
    _check_share(test_size)
    name = unused("_hash", keys)
    hashed = _with_hash(df.select(*map(named, keys)), keys, seed, name).select(
        named(name).alias("_hash")
    )
    wanted = F.ceil(F.lit(float(test_size)) * F.col("total"))
    total = F.sum("held").over(Window.partitionBy())
    held = _held(hashed, _PREFIX).withColumn("total", total).withColumn("missing", wanted)
    first = _cut(held)
    under = hashed.join(F.broadcast(first), F.substring("_hash", 1, _PREFIX) == F.col("at"))
    return _cut(_held(under, 32, "missing")).agg(F.min("at").alias("cut"))


def _held(hashed: DataFrame, digits: int, *carried: str) -> DataFrame:
    """Rows per hash prefix."""
    return hashed.groupBy(F.substring("_hash", 1, digits).alias("prefix")).agg(
        F.count(F.lit(1)).alias("held"), *[F.max(c).alias(c) for c in carried]
    )


def _cut(held: DataFrame) -> DataFrame:
    """(at, missing): the prefix with the row of rank ``missing``, and that row's rank in it.

    One row at most.
    """
    upto = Window.orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = F.col("upto") - F.col("held")
    return (
        held.withColumn("upto", F.sum("held").over(upto))
        .where(F.col("missing").between(before + 1, F.col("upto")))
        .select(F.col("prefix").alias("at"), (F.col("missing") - before).alias("missing"))
    )


def split(
    df: DataFrame,
    keys: Sequence[str],
    test_size: float = 0.2,
    seed: int = 3,
    exact: bool = True,
    cut: str | None = None,
) -> DataFrame:
    """Add ``is_test``, decided by a hash of ``keys`` and the seed.

    The answer does not depend on partitioning or row order, so the two sides can be computed
    apart. ``keys`` should identify a row; rows with equal keys share a side.

    ``exact`` sends precisely ``ceil(test_size * rows)`` rows to the test side (more only when
    the last of them has equals), at :func:`split_point`; give its text as ``cut`` if it is
    known. Without ``exact`` the hash is compared with the share: no pass is needed, and the
    size is right up to chance.
    """
    _check_share(test_size)
    # Temporary names that no column of the caller has.
    name, cut_name = unused("_hash", df.columns), unused("cut", df.columns)
    hashed, digest = _with_hash(df, keys, seed, name), F.col(name)
    if cut is not None:
        is_test = digest <= F.lit(cut)
    elif exact:
        point = split_point(df, keys, test_size, seed).withColumnRenamed("cut", cut_name)
        hashed = hashed.crossJoin(F.broadcast(point))
        is_test = F.coalesce(digest <= F.col(cut_name), F.lit(False))
    else:
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        is_test = number < F.lit(round(test_size * 16**8))
    kept = [named(c) for c in df.columns if c != "is_test"]
    return hashed.select(*kept, is_test.alias("is_test"))


def fit(train: DataFrame, options: ModelOptions = ModelOptions()) -> PipelineModel:
    """Ordinary least squares with an intercept: one pass that sums the normal equations."""
    assembler = VectorAssembler(inputCols=list(options.features), outputCol="features")
    regression = LinearRegression(
        featuresCol="features",
        labelCol=options.target,
        predictionCol="prediction",
        solver="normal",
        regParam=0.0,
    )
    return Pipeline(stages=[assembler, regression]).fit(train)


def coefficients(model: PipelineModel, features: Sequence[str], spark) -> DataFrame:
    """Term and weight, the intercept first."""
    fitted = model.stages[-1]
    rows = [("intercept", float(fitted.intercept))]
    rows += [(name, float(w)) for name, w in zip(features, fitted.coefficients, strict=True)]
    schema = T.StructType(
        [T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())]
    )
    return spark.createDataFrame(rows, schema)


@dataclass(frozen=True)
class LinearFit:
    """Weights of a linear model, and how many of its features are independent."""

    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    rank: int
    n: int


#: Moments that one pass sums.
_MOMENTS = 1000
#: Share of the largest eigenvalue of the correlations below which a direction counts as none.
_TOLERANCE = 1e-10
_ROUNDING = 1e-9


def _products(far: DataFrame, pairs: Sequence[tuple[int, int]]) -> DataFrame:
    """One row: the sum of each column, then of the products of each pair of columns."""
    names = far.columns
    products = [F.sum(F.col(names[i]) * F.col(names[j])) for i, j in pairs]
    return far.agg(*[F.sum(c) for c in names], *products)


def co_moments(df: DataFrame, columns: Sequence[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, means, covariances) of the rows that have all columns, NaN counting as missing.

    One pass for the means and one that sums products of distances from them, beyond some 40 columns one for
    every thousand pairs; never raw squares, which would cancel. Plain sums stay small enough to be compiled,
    which covariance functions by the dozen do not. The driver receives one number per pair of
    columns, however many rows there are.
    """
    numbers = df.select(*[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names = numbers.columns
    for name in names:
        numbers = numbers.where(F.col(name).isNotNull() & ~F.isnan(name))
    row = numbers.agg(F.count(F.lit(1)), *[F.avg(c) for c in names]).first()
    n, about = row[0], np.array([v or 0.0 for v in row[1:]])
    far = numbers.select(*[(F.col(c) - F.lit(float(v))).alias(c) for c, v in zip(names, about)])
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    matrix = np.zeros((len(names), len(names)))
    means = about
    for start in range(0, max(len(pairs), 1), _MOMENTS):
        part = pairs[start : start + _MOMENTS]
        row = _products(far, part).first()
        # What rounding left of the means is taken away.
        rest = np.array([v or 0.0 for v in row[: len(names)]]) / max(n, 1)
        means = about + rest
        for (i, j), value in zip(part, row[len(names) :]):
            matrix[i, j] = matrix[j, i] = (value or 0.0) / max(n, 1) - rest[i] * rest[j]
    return n, means, matrix


def minimum_norm(covariances: np.ndarray, with_target: np.ndarray) -> tuple[np.ndarray, int]:
    """The least-squares weights of the smallest length, and the rank.

    Directions without spread are found among the correlations, so features of any scale do;
    of all weights that fit equally well the shortest are those with no part along these
    directions in the features' own units.
    """
    spread = np.sqrt(np.diag(covariances))
    varies = spread > 0
    weights = np.zeros(len(spread))
    scale = spread[varies]
    if not varies.any():
        return weights, 0
    values, vectors = np.linalg.eigh(covariances[np.ix_(varies, varies)] / np.outer(scale, scale))
    kept = values > _TOLERANCE * values.max()
    inside, outside = vectors[:, kept], vectors[:, ~kept]
    found = inside @ ((inside.T @ (with_target[varies] / scale)) / values[kept]) / scale
    if outside.size:
        # An orthonormal basis of the directions along which predictions do not change. What rounding
        # leaves on the other features is taken away, since a small unit would blow it up.
        outside = np.where(np.abs(outside) < _ROUNDING, 0.0, outside)
        free, _ = np.linalg.qr(outside / scale[:, None])
        found -= free @ (free.T @ found)
    weights[varies] = found
    return weights, int(kept.sum())


def fit_min_norm(train: DataFrame, options: ModelOptions = ModelOptions()) -> LinearFit:
    """Ordinary least squares with an intercept; with collinear features the shortest weights.

    The features' covariances and those with the target are summed by Spark; the driver solves a
    system as large as the number of features squared. Rows that miss a feature or the target are left out. A
    feature without spread has weight zero. Without rows all weights are zero and the rank is 0.
    """
    columns = [*options.features, options.target]
    n, means, matrix = co_moments(train, columns)
    weights, rank = minimum_norm(matrix[:-1, :-1], matrix[:-1, -1])
    intercept = float(means[-1] - means[:-1] @ weights)
    return LinearFit(tuple(options.features), tuple(map(float, weights)), intercept, rank, n)


def linear_weights(fitted: LinearFit, spark) -> DataFrame:
    """Term and weight, the intercept first."""
    rows = [("intercept", fitted.intercept), *zip(fitted.features, fitted.weights, strict=True)]
    return spark.createDataFrame(rows, "term string, weight double")


def predict_linear(fitted: LinearFit, df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """Add the prediction, one expression; null where a feature is missing."""
    total = F.lit(fitted.intercept)
    for name, weight in zip(fitted.features, fitted.weights, strict=True):
        total = total + F.nanvl(named(name).cast("double"), F.lit(None)) * F.lit(weight)
    return df.withColumn(prediction, total)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add ``prediction``."""
    return model.transform(df).drop("features")


def score(predicted: DataFrame, target: str = "price", prediction: str = "prediction") -> DataFrame:
    """R squared, mean absolute error and greatest error, in one pass and one row.

    Rows without a target or without a prediction, NaN included, count for nothing.
    With a constant target R squared is 1 if every prediction is right, else 0. With fewer
    than two rows it is null.
    """
    y, p = named(target).cast("double"), named(prediction).cast("double")
    both = y.isNotNull() & p.isNotNull() & ~F.isnan(y) & ~F.isnan(p)
    y, p = F.when(both, y), F.when(both, p)
    sums = predicted.agg(
        F.count(y - p).alias("n"),
        F.sum(squared_error(y, p)).alias("residual"),
        (F.var_pop(y) * F.count(y)).alias("spread"),
        F.avg(absolute_error(y, p)).alias("mae"),
        F.max(absolute_error(y, p)).alias("max_error"),
    )
    r2 = (
        F.when(F.col("n") < 2, F.lit(None).cast("double"))
        .when(F.col("spread") != 0, 1 - F.col("residual") / F.nullif(F.col("spread"), F.lit(0.0)))
        .when(F.col("residual") == 0, F.lit(1.0))
        .otherwise(F.lit(0.0))
    )
    return sums.select("n", r2.alias("r2"), "mae", "max_error")
