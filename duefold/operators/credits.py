"""From installments to one row per credit, and the labels on it."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import first_non_null, named, percentage, three_way_label
from duefold.functions.labels import DEFAULT_MIN, PAID_MAX
from duefold.operators.missing import nan_to_null


def first_values(
    df: DataFrame, key: str, order: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """Per key, the first non-null value of each column in the given order.

    Values of one output row may come from different input rows: each column passes over
    its own nulls. Rows with a null key are dropped.
    """
    kept = [c for c in (df.columns if columns is None else columns) if c != key]
    order_columns = [named(c) for c in order]
    return (
        nan_to_null(df)
        .where(named(key).isNotNull())
        .groupBy(named(key))
        .agg(*[first_non_null(named(c), order_columns).alias(c) for c in kept])
    )


def credit_table(
    installments: DataFrame, paid_max: int = PAID_MAX, default_min: int = DEFAULT_MIN
) -> DataFrame:
    """One row per credit: first dates, first and worst lateness, and the label.

    Everything the reports need comes out of one grouping, so the detail is scanned and
    shuffled once. Columns a report does not use are pruned from that grouping. Write this
    table with ``sources.write_parquet`` and build all reports on it when there are several.
    """
    order = [F.col("installment_no"), F.col("due_at")]
    return (
        nan_to_null(installments, ["days_late", "installment_no"])
        .where(F.col("credit_id").isNotNull())
        .groupBy("credit_id")
        .agg(
            first_non_null(F.col("disbursed_at"), order).alias("disbursed_at"),
            first_non_null(F.col("due_at"), order).alias("due_at"),
            first_non_null(F.col("days_late"), order).alias("first_days_late"),
            F.max("days_late").alias("max_days_late"),
        )
        .withColumn("label", three_way_label(F.col("max_days_late"), paid_max, default_min))
    )


def label_credits(
    installments: DataFrame, paid_max: int = PAID_MAX, default_min: int = DEFAULT_MIN
) -> DataFrame:
    """Worst lateness of each credit over all its installments, and its label."""
    return credit_table(installments, paid_max, default_min).select(
        "credit_id", "max_days_late", "label"
    )


def class_distribution(credits: DataFrame) -> DataFrame:
    """Counts and shares of paid, default and grey credits, in one row.

    Grey includes credits whose lateness is unknown.
    """
    label = F.col("label")
    counts = credits.agg(
        F.count(F.lit(1)).alias("n_credits"),
        F.count_if(label == 1).alias("n_paid"),
        F.count_if(label == 0).alias("n_default"),
        F.count_if(label.isNull()).alias("n_grey"),
    )
    total = F.col("n_credits")
    return counts.withColumns(
        {
            f"pct_{name}": percentage(F.col(f"n_{name}"), total)
            for name in ("paid", "default", "grey")
        }
    )
