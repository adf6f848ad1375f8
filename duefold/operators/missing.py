"""Missing values: null is the only form the operators work with."""

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duefold.functions import is_missing, named


def nan_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into null in the floating-point columns.

    Spark ranks NaN above every number, so it would win each ``max`` and pass each
    ``>`` filter.
    """
    chosen = set(df.columns if columns is None else columns)
    floats = [
        field.name
        for field in df.schema
        if field.name in chosen and isinstance(field.dataType, (T.FloatType, T.DoubleType))
    ]
    return df.withColumns({c: F.nanvl(named(c), F.lit(None)) for c in floats})


def complete_rows(df: DataFrame) -> DataFrame:
    """Keep the rows that miss no value.

    One predicate per column, not a single row-wide test, so that Catalyst can move each
    to the side of a join, and to the scan, it belongs to.
    """
    tests = [~is_missing(field.name, field.dataType) for field in df.schema]
    return df.where(reduce(lambda a, b: a & b, tests))
