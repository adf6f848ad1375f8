import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from duefold.operators import features as FE
from duefold.operators import regression as R
from duefold.operators import tables as TA
from duefold.operators.missing import complete_rows, nan_to_null
from duefold.plans.price_model import capacity_report, prepare, train_and_score

from .conftest import rows_of


@pytest.fixture(scope="module")
def tables(spark):
    vehicles = spark.createDataFrame(
        [
            (1, "A", 2, 1, 3, "t", "f", "$1,000.00", 7),
            (2, "A", 4, 2, 5, None, "t", "$50.5", 8),
            (3, "B", 1, 1, 1, "f", "f", None, 7),
            (4, "B", 9, 4, 2, "t", "t", "$3.00", None),
            (5, None, 9, 4, 2, "t", "t", "$3.00", 7),
        ],
        "id bigint, vehicle_type string, passenger_capacity int, engines int, crew int,"
        " check_complete string, clearance_complete string, price string, operator_id bigint",
    )
    ratings = spark.createDataFrame(
        [("r1", 1, 90.0), ("r2", 1, 80.0), ("r3", 2, None), ("r4", 2, 70.0), ("r5", 3, 1.0),
         ("r6", None, 5.0), ("r7", 4, 2.0), ("r8", 5, 2.0), ("r9", 99, 2.0),
         ("r10", 2, float("nan"))],
        "review_id string, vehicle_id bigint, review_score double",
    )
    operators = spark.createDataFrame(
        [(7, "95%", "t"), (8, "0%", None), (9, None, "t")],
        "id bigint, rating string, approved string",
    )
    return vehicles, ratings, operators


def test_cleaning(tables):
    vehicles, _, operators = tables
    assert rows_of(FE.clean_operators(operators)) == [(7, 0.95, True), (8, 0.0, False), (9, None, True)]
    cleaned = FE.clean_vehicles(vehicles)
    assert cleaned.columns == vehicles.columns
    assert [(r.check_complete, r.price) for r in cleaned.collect()][:3] == [
        (True, 1000.0), (False, 50.5), (False, None)
    ]


def test_model_table_joins_and_drops_incomplete_rows(tables):
    table = prepare(*tables)
    assert table.columns == [
        "vehicle_type", "passenger_capacity", "engines", "crew", "check_complete",
        "clearance_complete", "price", "operator_id", "review_id", "vehicle_id", "review_score",
        "id", "rating", "approved",
    ]
    assert sorted((r.review_id, r.id, r.rating, r.approved) for r in table.collect()) == [
        ("r1", 7, 0.95, True), ("r2", 7, 0.95, True), ("r4", 8, 0.0, False)
    ]


def test_columns_on_both_sides_get_suffixes(spark):
    left = spark.createDataFrame([(1, 5, "l")], "id int, operator_id int, name string")
    ratings = spark.createDataFrame([(1, "r")], "vehicle_id int, name string")
    operators = spark.createDataFrame([(5, "o")], "id int, name_x string")
    table = FE.model_table(left, ratings, operators)
    assert table.columns == ["operator_id", "name_x_x", "vehicle_id", "name_y", "id", "name_x_y"]
    assert rows_of(table) == [(5, "l", 1, "r", 5, "o")]


def test_missing_helpers(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("nan")), (None, 3.0)], "a int, b double")
    assert rows_of(complete_rows(df)) == [(1, 1.0)]
    assert rows_of(nan_to_null(df)) == [(1, 1.0), (2, None), (None, 3.0)]


def test_mean_by_counts_flags_as_numbers(tables):
    report = capacity_report(tables[0])
    means = {r.vehicle_type: r for r in report["mean_by_type"].collect()}
    assert set(means) == {"A", "B"}
    assert means["A"].check_complete == 0.5 and means["A"].price == 525.25 and means["B"].price == 3.0
    assert rows_of(report["capacity_by_type"]) == [("A", 3.0), ("B", 5.0)]


def test_confusion_pairs(spark):
    # The pairs whose cross table is known.
    actual = [0, 1, 0, 0, 1, 1, 1, 0, 1, 0, 1]
    predicted = [1, 1, 0, 1, 0, 1, 0, 0, 0, 1, 1]
    df = spark.createDataFrame(list(zip(actual, predicted)), "actual int, predicted int")
    for values in (None, [0, 1]):
        table = TA.crosstab(df, "actual", "predicted", values)
        assert table.columns == ["actual", "predicted_0", "predicted_1"]
        assert rows_of(table) == [(0, 2, 3), (1, 3, 3)]
    unused = TA.crosstab(df, "actual", "predicted", [0, 1, 2])
    assert rows_of(unused) == [(0, 2, 3, 0), (1, 3, 3, 0)]


@pytest.mark.parametrize("n, share", [(1, 0.2), (7, 0.2), (1000, 0.2), (1000, 0.0), (10, 1.0)])
def test_exact_split_size(spark, n, share):
    df = spark.range(n)
    divided = R.split(df, ["id"], share, 3)
    assert divided.count() == n
    assert divided.where("is_test").count() == math.ceil(share * n)


def test_split_is_stable_and_seeded(spark):
    df = spark.range(2000)
    for exact in (True, False):
        test = {r.id for r in R.split(df, ["id"], 0.2, 3, exact).where("is_test").collect()}
        again = {
            r.id for r in R.split(df.repartition(7), ["id"], 0.2, 3, exact).where("is_test").collect()
        }
        other = {r.id for r in R.split(df, ["id"], 0.2, 4, exact).where("is_test").collect()}
        assert test == again != other
        assert 320 < len(test) < 480


def test_rows_with_equal_keys_share_a_side(spark):
    df = spark.range(3000).withColumn("id", F.when(F.col("id") < 1000, 0).otherwise(F.col("id")))
    divided = R.split(df, ["id"], 0.2, 3)
    assert divided.count() == 3000
    assert divided.where("id = 0").select("is_test").distinct().count() == 1
    assert divided.where("is_test").count() >= 600


def test_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3))
    flag = rng.random(500) < 0.4
    y = 4 + x @ [1.0, -2.0, 0.5] + 3 * flag + rng.normal(size=500) / 10
    pdf = pd.DataFrame(x, columns=list("abc")).assign(flag=flag, y=y)
    options = R.ModelOptions(target="y", features=("a", "b", "c", "flag"))
    df = spark.createDataFrame(pdf)
    model = R.fit(df, options)
    design = np.column_stack([np.ones(500), x, flag])
    expected = np.linalg.lstsq(design, y, rcond=None)[0]
    found = R.coefficients(model, options.features, spark).collect()
    assert [r.term for r in found] == ["intercept", "a", "b", "c", "flag"]
    assert np.allclose([r.weight for r in found], expected)
    residual = y - design @ expected
    scores = R.score(R.predict(model, df), "y").collect()[0]
    assert scores.n == 500
    assert scores.r2 == pytest.approx(1 - residual @ residual / ((y - y.mean()) ** 2).sum())
    assert scores.mae == pytest.approx(np.abs(residual).mean())
    assert scores.max_error == pytest.approx(np.abs(residual).max())


def test_collinear_features_still_predict(spark):
    df = spark.range(60).selectExpr(
        "double(id % 9) AS a", "2.0D * (id % 9) AS b", "5.0D + 4 * (id % 9) AS y"
    )
    options = R.ModelOptions(target="y", features=("a", "b"))
    assert R.score(R.predict(R.fit(df, options), df), "y").collect()[0].max_error < 1e-4


@pytest.mark.parametrize("scale", [1.0, 1e-6, 1e7])
def test_minimum_norm_equals_numpy(spark, scale):
    """A doubled feature, a sum of two, a constant one and very different units."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 4)) * [1.0, scale, 1.0, 3.0] + [5.0, 0.0, 1000.0, 0.0]
    design = np.column_stack([x, 2 * x[:, 0], x[:, 2] + x[:, 3], np.full(400, 7.0)])
    y = 3 + x @ [1.0, 2.0 / scale, -1.0, 0.5] + rng.normal(size=400)
    names = tuple(f"f{k}" for k in range(design.shape[1]))
    pdf = pd.DataFrame(design, columns=list(names)).assign(y=y)
    df = spark.createDataFrame(pdf).repartition(7)
    fitted = R.fit_min_norm(df, R.ModelOptions(target="y", features=names))
    centred = design - design.mean(axis=0)
    # Of the independent features' weights, shared out over the features that depend on them.
    b = np.linalg.lstsq(centred[:, :4] / [1.0, scale, 1.0, 1.0], y - y.mean(), rcond=None)[0]
    third = (b[2] + b[3]) / 3
    expected = np.array([b[0] / 5, b[1] / scale, b[2] - third, b[3] - third, 2 * b[0] / 5, third, 0])
    if scale == 1.0:
        assert np.allclose(expected, np.linalg.lstsq(centred, y - y.mean(), rcond=1e-9)[0])
    assert fitted.rank == 4 and fitted.n == 400
    assert np.allclose(fitted.weights, expected, rtol=1e-5, atol=1e-9)
    assert fitted.intercept == pytest.approx(y.mean() - design.mean(axis=0) @ expected, rel=1e-5)
    errors = R.predict_linear(fitted, df).selectExpr("max(abs(prediction - y)) AS e").first().e
    assert errors == pytest.approx(np.abs(centred @ expected + y.mean() - y).max(), rel=1e-6)


def test_minimum_norm_of_missing_and_few_rows(spark):
    rows = [(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 9.0), (4.0, None), (float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "a double, y double")
    options = R.ModelOptions(target="y", features=("a",))
    fitted = R.fit_min_norm(df, options)
    assert fitted.n == 3 and fitted.weights[0] == pytest.approx(2) and abs(fitted.intercept) < 1e-9
    assert [r.prediction is None for r in R.predict_linear(fitted, df).collect()] == [False] * 3 + [True, False, True]
    empty = R.fit_min_norm(df.limit(0), options)
    assert (empty.n, empty.weights, empty.intercept, empty.rank) == (0, (0.0,), 0.0, 0)


def test_many_features_take_several_passes(spark, monkeypatch):
    monkeypatch.setattr(R, "_MOMENTS", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 6))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcdef")))
    n, means, matrix = R.co_moments(df, list("abcdef"))
    assert n == 200 and np.allclose(means, x.mean(axis=0))
    assert np.allclose(matrix, np.cov(x.T, bias=True))


@pytest.mark.parametrize(
    "pairs, r2",
    [
        ([(2.0, 2.0), (2.0, 2.0)], 1.0),
        ([(2.0, 2.0), (2.0, 3.0)], 0.0),
        ([(1.0, 1.0)], None),
        ([(0.1, 0.1)] * 7, 1.0),
    ],
)
def test_scores_of_a_constant_target(spark, pairs, r2):
    df = spark.createDataFrame(pairs, "price double, prediction double")
    assert R.score(df).collect()[0].r2 == r2


def test_train_and_score(spark):
    df = spark.range(400).selectExpr("id", "double(id % 7) AS a", "3.0D + 2 * (id % 7) AS price")
    options = R.ModelOptions(features=("a",))
    model, scores = train_and_score(df, ["id"], options)
    row = scores.collect()[0]
    assert row.n == 80 and row.r2 == pytest.approx(1.0) and row.max_error < 1e-9
