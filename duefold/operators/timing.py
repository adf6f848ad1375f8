"""Time from disbursement to the first due date."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import day_of_month, elapsed_days, month_gap, month_start, named, percentage
from duefold.operators.histogram import histogram
from duefold.operators.quantiles import quantiles_from_counts, value_counts
from duefold.operators.summary import summary

# Day counts are whole numbers inside the calendar: years 1 to 9999 give at most 7.3
# million different gaps, and a loan book a few thousand. Their distinct values fit in
# one task, unlike those of a free number.
_DAYS_ARE_FEW = True


def first_due(credits: DataFrame) -> DataFrame:
    """Add the disbursement day, both month buckets, the month gap and the day gap."""
    disbursed, due = F.col("disbursed_at"), F.col("due_at")
    return credits.withColumns(
        {
            "disbursement_day": day_of_month(disbursed),
            "disbursement_month": month_start(disbursed),
            "due_month": month_start(due),
            "month_gap": month_gap(due, disbursed),
            "days_to_due": elapsed_days(due, disbursed),
        }
    )


def timing_summary(timing: DataFrame) -> DataFrame:
    """Summary statistics of day, month gap, first lateness and label."""
    return summary(
        timing,
        ["disbursement_day", "month_gap", "first_days_late", "label"],  # fixed values
        small_domain=_DAYS_ARE_FEW,
    )


def gap_summary(timing: DataFrame, digits: int = 0) -> DataFrame:
    """Distribution of the day gap, tails included, with its count of negative gaps."""
    return summary(
        timing,
        ["days_to_due"],
        probabilities=(0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99),  # fixed values
        digits=digits,
        small_domain=_DAYS_ARE_FEW,
        count_negative=True,
    )


def negative_gaps(timing: DataFrame) -> DataFrame:
    """Credits due before they were disbursed: date errors."""
    return timing.where(F.col("days_to_due") < 0)


def default_by_month_pair(timing: DataFrame) -> DataFrame:
    """Default rates by month of disbursement and month of first payment, with all margins.

    Cells, both margins and the total come from one aggregation by grouping sets. ``level`` tells
    them apart (0 cell, 1 all due months, 2 all disbursement months, 3 total), since a month
    can be null for a credit without that date, too. Rates are shares of the labelled credits.
    """
    pair = [F.col("disbursement_month"), F.col("due_month")]
    sets = [pair, pair[:1], pair[1:], []]
    return (
        timing.groupingSets(sets, *pair)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.count(F.lit(1)).alias("n_credits"),
            F.count("label").alias("n_labelled"),
            F.count_if(F.col("label") == 0).alias("n_default"),
        )
        .withColumn("default_rate", percentage(F.col("n_default"), F.col("n_labelled")))
        .orderBy("level", "disbursement_month", "due_month")
    )


def _gap_limit(counts: DataFrame, upper: float) -> DataFrame:
    limit = quantiles_from_counts(counts, [upper])
    return limit.select(F.col("quantiles")[0].alias("gap_limit"))


def valid_range(timing: DataFrame, upper: float = 0.99) -> DataFrame:
    """Credits whose gap lies between zero and its upper quantile, both included.

    The quantile is taken over all gaps, before negative ones are removed. The limit is one
    row whatever the input, so broadcasting it is safe. Its branch of the plan asks for all
    columns that the rows have, so both share one grouping of the detail.
    """
    whole = timing.where(F.hash(*map(named, timing.columns)) >= F.lit(-(2**31)))  # always true
    limit = _gap_limit(value_counts(whole, "days_to_due"), upper)
    return timing.crossJoin(F.broadcast(limit)).where(
        F.col("days_to_due").between(F.lit(0), F.col("gap_limit"))
    )


def valid_range_size(timing: DataFrame, upper: float = 0.99) -> DataFrame:
    """How many credits there are and how many lie in the valid range."""
    limit = _gap_limit(value_counts(timing, "days_to_due"), upper)
    return (
        timing.crossJoin(F.broadcast(limit))
        .agg(
            F.count(F.lit(1)).alias("n_credits"),
            F.count_if(F.col("days_to_due").between(F.lit(0), F.col("gap_limit"))).alias("n_valid"),
            F.max("gap_limit").alias("gap_limit"),
        )
    )


def _valid_counts(timing: DataFrame, by: list[str], upper: float) -> DataFrame:
    """Number of credits per group and gap inside the valid range."""
    counts = value_counts(timing, "days_to_due", by)
    overall = counts.groupBy("value").agg(F.sum("copies").alias("copies"))
    return counts.crossJoin(F.broadcast(_gap_limit(overall, upper))).where(
        F.col("value").between(F.lit(0), F.col("gap_limit"))
    )


def gap_histogram(timing: DataFrame, bins: int = 60, upper: float = 0.99) -> DataFrame:
    """Equal-width histogram of the gaps in the valid range.

    Works on the counts per gap, which hold a row per different number of days.
    """
    return histogram(_valid_counts(timing, [], upper), "value", bins, copies="copies")


def gap_by_disbursement_day(timing: DataFrame, upper: float = 0.99) -> DataFrame:
    """Median, quartiles and count of the valid gaps per day of the month of disbursement."""
    counts = _valid_counts(timing, ["disbursement_day"], upper)
    return (
        counts.groupBy("disbursement_day")
        .agg(
            F.percentile("value", [0.5, 0.25, 0.75], F.col("copies")).alias("q"),
            F.sum("copies").alias("n"),
        )
        .select(
            "disbursement_day",
            F.col("q")[0].alias("median"),
            F.col("q")[1].alias("q25"),
            F.col("q")[2].alias("q75"),
            "n",
        )
        .orderBy("disbursement_day")
    )
