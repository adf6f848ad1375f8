"""Text-coded tables made numeric, and joined into the input of a model."""

from collections.abc import Sequence

from pyspark.sql import DataFrame

from duefold.functions import is_true, named, parse_money, parse_percentage
from duefold.operators.missing import complete_rows


def clean_operators(
    operators: DataFrame,
    flags: Sequence[str] = ("approved",),
    percentages: Sequence[str] = ("rating",),
    lenient: bool = False,
) -> DataFrame:
    """Approval flags to booleans, ratings in percent to fractions."""
    return operators.withColumns(
        {c: is_true(named(c)) for c in flags}
        | {c: parse_percentage(named(c), lenient) for c in percentages}
    )


def clean_vehicles(
    vehicles: DataFrame,
    flags: Sequence[str] = ("check_complete", "clearance_complete"),
    money: Sequence[str] = ("price",),
    lenient: bool = False,
) -> DataFrame:
    """Completion flags to booleans, prices to numbers."""
    return vehicles.withColumns(
        {c: is_true(named(c)) for c in flags} | {c: parse_money(named(c), lenient) for c in money}
    )


def _join_keeping_both_keys(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str
) -> DataFrame:
    """Inner join; other columns found on both sides get the suffixes ``_x`` and ``_y``."""
    shared = set(left.columns) & set(right.columns)
    left = left.withColumnsRenamed({c: f"{c}_x" for c in shared})
    right = right.withColumnsRenamed({c: f"{c}_y" for c in shared})
    left_name = f"{left_key}_x" if left_key in shared else left_key
    right_name = f"{right_key}_y" if right_key in shared else right_key
    return left.join(right, left[left_name] == right[right_name], "inner")


def model_table(
    vehicles: DataFrame,
    ratings: DataFrame,
    operators: DataFrame,
    vehicle_key: str = "id",
    rated_vehicle: str = "vehicle_id",
    vehicle_operator: str = "operator_id",
    operator_key: str = "id",
) -> DataFrame:
    """Vehicles with each of their ratings and their operator; incomplete rows dropped.

    Rows that miss a value are dropped from every table before it is joined, which gives the
    same rows and shuffles fewer. Nothing is forced to broadcast: Spark compares the sizes,
    and adaptive skew handling splits the ratings of a popular vehicle or operator.
    """
    rated = _join_keeping_both_keys(
        complete_rows(vehicles), complete_rows(ratings), vehicle_key, rated_vehicle
    ).drop(vehicle_key)
    return _join_keeping_both_keys(
        rated, complete_rows(operators), vehicle_operator, operator_key
    )
