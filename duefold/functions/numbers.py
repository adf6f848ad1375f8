"""Percentages, rounding, errors and the missing-value test."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .names import named


def percentage(part: Column, whole: Column) -> Column:
    """``100 * part / whole``; null when ``whole`` is zero."""
    return F.lit(100.0) * part / F.nullif(whole, F.lit(0))


def round_half_even(number: Column, digits: int = 0) -> Column:
    return F.bround(number, digits)


def absolute_error(actual: Column, predicted: Column) -> Column:
    return F.abs(actual - predicted)


def squared_error(actual: Column, predicted: Column) -> Column:
    return (actual - predicted) * (actual - predicted)


def is_missing(name: str, data_type: T.DataType) -> Column:
    """Null, or NaN where the type can hold it."""
    column = named(name)
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    return column.isNull()
