"""Maturity: whether a credit was observed long enough for its label to count."""

import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import elapsed_days, is_mature, keep_if_mature, minimum_days, percentage
from duefold.functions.labels import DEFAULT_MIN


def cutoff_date(installments: DataFrame) -> DataFrame:
    """The last disbursement, as one row. Rows without a credit id count too."""
    return installments.agg(F.max("disbursed_at").alias("cutoff"))


def maturity(
    credits: DataFrame,
    cutoff: DataFrame | datetime.datetime,
    default_min: int = DEFAULT_MIN,
) -> DataFrame:
    """Add observed and minimum days, the maturity flag and the label of mature credits.

    ``cutoff`` is the one-row frame of :func:`cutoff_date`, safe to broadcast, or a known
    moment, which saves the scan.
    """
    if isinstance(cutoff, datetime.datetime):
        dated = credits.withColumn("cutoff", F.lit(cutoff).cast("timestamp_ntz"))
    else:
        dated = credits.crossJoin(F.broadcast(cutoff))
    return (
        dated.withColumn("days_to_due", elapsed_days(F.col("due_at"), F.col("disbursed_at")))
        .withColumns(
            {
                "days_observed": elapsed_days(F.col("cutoff"), F.col("disbursed_at")),
                "days_needed": minimum_days(F.col("days_to_due"), default_min),
            }
        )
        .withColumn("mature", is_mature(F.col("days_observed"), F.col("days_needed")))
        .withColumn("clean_label", keep_if_mature(F.col("label"), F.col("mature")))
        .drop("cutoff")
    )


def maturity_report(matured: DataFrame) -> DataFrame:
    """Mature and immature credits, and the default rate with and without the filter.

    Rates are shares of the labelled credits only.
    """
    counts = matured.agg(
        F.count(F.lit(1)).alias("n_credits"),
        F.count_if(F.col("mature")).alias("n_mature"),
        F.count_if(~F.col("mature")).alias("n_immature"),
        F.count("label").alias("n_labelled"),
        F.count("clean_label").alias("n_labelled_mature"),
        F.count_if(F.col("label") == 0).alias("n_default"),
        F.count_if(F.col("clean_label") == 0).alias("n_default_mature"),
    )
    return counts.withColumns(
        {
            "pct_mature": percentage(F.col("n_mature"), F.col("n_credits")),
            "pct_immature": percentage(F.col("n_immature"), F.col("n_credits")),
            "default_rate": percentage(F.col("n_default"), F.col("n_labelled")),
            "default_rate_mature": percentage(
                F.col("n_default_mature"), F.col("n_labelled_mature")
            ),
        }
    )
