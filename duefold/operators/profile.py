"""Profiles of a table: missing shares, schema, distinct counts, size and preview."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import is_missing, named
from duefold.operators.missing import nan_to_null


def _per_column(df: DataFrame, aggregate: dict, name: str) -> DataFrame:
    """One row per column from a single pass that yields one wide row."""
    return df.agg(*[measure.alias(c) for c, measure in aggregate.items()]).unpivot(
        [], [named(c) for c in aggregate], "column", name
    )


def missing_share(df: DataFrame) -> DataFrame:
    """Share of missing values per column, highest first; null for an empty table."""
    shares = {f.name: F.avg(is_missing(f.name, f.dataType).cast("int")) for f in df.schema}
    return _per_column(df, shares, "share").orderBy(F.desc("share"), "column")


def schema_profile(df: DataFrame) -> DataFrame:
    """Position, name, type and non-missing count of each column."""
    present = {f.name: F.count_if(~is_missing(f.name, f.dataType)) for f in df.schema}
    details = F.create_map(
        *[
            part
            for i, f in enumerate(df.schema)
            for part in (
                F.lit(f.name),
                F.struct(
                    F.lit(i).alias("position"), F.lit(f.dataType.simpleString()).alias("type")
                ),
            )
        ]
    )
    return (
        _per_column(df, present, "non_missing")
        .withColumn("detail", details[F.col("column")])
        .select(
            F.col("detail.position").alias("position"),
            "column",
            F.col("detail.type").alias("type"),
            "non_missing",
        )
        .orderBy("position")
    )


def distinct_counts(
    df: DataFrame, columns: Sequence[str], relative_error: float | None = None
) -> DataFrame:
    """Different values per column, nulls and NaN not counted.

    Exact by default. With ``relative_error`` a sketch answers instead, without a shuffle of
    the values; it is never used unless asked for.
    """
    df = nan_to_null(df, columns)
    if relative_error is None:
        counts = {c: F.count_distinct(named(c)) for c in columns}
    else:
        counts = {c: F.approx_count_distinct(named(c), relative_error) for c in columns}
    return _per_column(df, counts, "n_distinct").orderBy("column")


def table_shape(df: DataFrame) -> DataFrame:
    """Rows and columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("bigint").alias("n_columns")
    )


def preview(
    df: DataFrame, columns: Sequence[str], order: Sequence[str], rows: int = 3
) -> DataFrame:
    """The first rows of the chosen columns in a stated order."""
    return df.orderBy(*map(named, order)).limit(rows).select(*map(named, columns))
