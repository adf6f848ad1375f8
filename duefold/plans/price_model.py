"""From three raw tables to a scored price model."""

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from duefold.operators import features as F
from duefold.operators import regression as R
from duefold.operators import tables as T


def prepare(vehicles: DataFrame, ratings: DataFrame, operators: DataFrame) -> DataFrame:
    """Clean and join. Write the result: training and scoring both read it."""
    return F.model_table(F.clean_vehicles(vehicles), ratings, F.clean_operators(operators))


def train_and_score(
    table: DataFrame, keys: Sequence[str], options: R.ModelOptions = R.ModelOptions()
) -> tuple[PipelineModel, DataFrame]:
    """The fitted model and its scores on the test rows.

    Give a ``table`` that is read from files, such as the written result of :func:`prepare`.
    """
    model, predicted = train_and_predict(table, keys, options)
    return model, R.score(predicted, options.target)


def train_and_predict(
    table: DataFrame, keys: Sequence[str], options: R.ModelOptions = R.ModelOptions()
) -> tuple[PipelineModel, DataFrame]:
    """The fitted model and the test rows with their predictions."""
    columns = dict.fromkeys((*keys, *options.features, options.target))
    # One hash comes to the driver; with it the sides are plain filters on the scan.
    cut = R.split_point(table, keys, options.test_size, options.seed).first().cut
    divided = R.split(table.select(*columns), keys, seed=options.seed, cut=cut or "")
    model = R.fit(divided.where("NOT is_test"), options)
    return model, R.predict(model, divided.where("is_test"))


def capacity_report(vehicles: DataFrame) -> dict[str, DataFrame]:
    """Means by vehicle type, and the two columns a bar chart of them shows."""
    means = T.mean_by(F.clean_vehicles(vehicles), "vehicle_type")
    return {
        "mean_by_type": means,
        "capacity_by_type": means.select("vehicle_type", "passenger_capacity"),
    }
