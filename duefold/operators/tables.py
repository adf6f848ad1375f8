"""Small cross tables."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duefold.functions import named, quoted
from duefold.operators.missing import nan_to_null


def mean_by(df: DataFrame, *keys: str) -> DataFrame:
    """Mean of every numeric and boolean column per group."""
    averaged = [
        f.name
        for f in df.schema
        if f.name not in keys and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]

    def as_double(name: str):
        column = named(name)
        if isinstance(df.schema[name].dataType, T.BooleanType):
            column = column.cast("int")
        return column.cast("double")

    kept = nan_to_null(df)
    for key in keys:
        kept = kept.where(named(key).isNotNull())
    by = [named(key) for key in keys]
    return kept.groupBy(*by).agg(*[F.avg(as_double(c)).alias(c) for c in averaged]).orderBy(*by)


def crosstab(
    df: DataFrame, rows: str, columns: str, values: Sequence | None = None
) -> DataFrame:
    """Rows per pair of values: one output row per ``rows``, one column per ``columns`` value.

    Give ``values`` to save the job that looks them up; a value that is not among them then
    raises. Pairs with a null or NaN are left out.
    """
    pairs = nan_to_null(df.select(named(rows), named(columns)))
    pairs = pairs.where(named(rows).isNotNull() & named(columns).isNotNull())
    if values is not None:
        text = F.concat(F.lit(f"value of {columns} that is not listed: "), named(columns).cast("string"))
        unlisted = F.raise_error(text).cast(df.schema[columns].dataType)
        listed = F.when(named(columns).isin(list(values)), named(columns)).otherwise(unlisted)
        pairs = pairs.withColumn(columns, listed)
    table = (
        pairs.groupBy(named(rows))
        .pivot(quoted(columns), None if values is None else list(values))
        .count()
    )
    found = [c for c in table.columns if c != rows]
    return table.select(
        named(rows), *[F.coalesce(named(c), F.lit(0)).alias(f"{columns}_{c}") for c in found]
    ).orderBy(named(rows))
