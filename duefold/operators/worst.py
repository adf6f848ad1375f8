"""The installments at which credits were latest."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duefold.functions import named, percentage, three_way_label
from duefold.functions.labels import DEFAULT_MIN, PAID_MAX
from duefold.functions.names import unused
from duefold.operators.missing import nan_to_null
from duefold.session import written


def rows_at_group_maximum(df: DataFrame, key: str, value: str) -> DataFrame:
    """Whole rows whose value equals the greatest of their group; all ties are kept.

    An aggregate joined back, not a window: a window would bring each group into one task.
    The maximum combines on the map side, its side of the join has one row per key, and
    adaptive skew handling can split the other side.
    """
    rows = nan_to_null(df, [value])
    return _at_maximum(rows, key, value)


def _at_maximum(rows: DataFrame, key: str, value: str) -> DataFrame:
    its_key, peak = unused("peak_key", rows.columns), unused("peak", rows.columns)
    peaks = (
        rows.where(named(key).isNotNull())
        .groupBy(named(key).alias(its_key))
        .agg(F.max(named(value)).alias(peak))
    )
    both = (named(key) == F.col(its_key)) & (named(value) == F.col(peak))
    return rows.join(peaks, both).select(*map(named, rows.columns))


#: Parts that the rows of one key are dealt into before their maxima are known.
_PARTS = 32


def rows_at_group_maximum_in_one_scan(df: DataFrame, key: str, value: str) -> DataFrame:
    """As :func:`rows_at_group_maximum`, the detail scanned once, by a job while the plan is built.

    Each task first keeps the rows at the greatest value it has seen of a key (a limit by rank,
    applied before the shuffle), so of a key's rows little more than the ties leave a task. A key's
    ties are dealt over ``_PARTS`` tasks. What is left is stored, and the maxima of the parts
    are joined to it, which adaptive skew handling can split for a key with very many ties.
    """
    part = unused("part", df.columns)
    rank = unused("rank", df.columns)
    rows = nan_to_null(df, [value]).where(named(key).isNotNull() & named(value).isNotNull())
    # Any deal gives the same rows in the end.
    dealt = rows.withColumn(part, F.pmod(F.monotonically_increasing_id(), F.lit(_PARTS)))
    best = Window.partitionBy(named(key), F.col(part)).orderBy(named(value).desc())
    near = (
        dealt.withColumn(rank, F.rank().over(best))
        .where(F.col(rank) <= 1)
        .select(*map(named, df.columns))
    )
    return _at_maximum(written(near, "rows-at-maximum"), key, value)


def worst_installments(
    installments: DataFrame,
    paid_max: int = PAID_MAX,
    default_min: int = DEFAULT_MIN,
    in_one_scan: bool = False,
) -> DataFrame:
    """Installments at the worst lateness of their credit, grey credits left out.

    Grey is left out by plain comparisons, which reach the scan; a null label would not.
    ``in_one_scan`` reads a detail that is costly to scan only once.
    """
    late = F.col("days_late")
    find = rows_at_group_maximum_in_one_scan if in_one_scan else rows_at_group_maximum
    return (
        find(installments, "credit_id", "days_late")
        .where((late <= paid_max) | (late > default_min))
        .withColumn("label", three_way_label(late, paid_max, default_min))
    )


def default_by_worst_installment(
    installments: DataFrame,
    paid_max: int = PAID_MAX,
    default_min: int = DEFAULT_MIN,
    min_rows: int = 0,
) -> DataFrame:
    """Default rate by the installment with the worst lateness.

    A credit with ties counts under each tied row. Equal rows are counted together before the
    window, so the group of one credit holds its different (installment, lateness) pairs, a
    number set by the calendar and the loan term, however many rows the credit has.
    ``min_rows`` drops installments with fewer rows.
    """
    pairs = (
        nan_to_null(installments, ["days_late", "installment_no"])
        .where(F.col("credit_id").isNotNull() & F.col("days_late").isNotNull())
        .groupBy("credit_id", "installment_no", "days_late")
        .agg(F.count(F.lit(1)).alias("copies"))
    )
    peak = F.max("days_late").over(Window.partitionBy("credit_id"))
    label = three_way_label(F.col("days_late"), paid_max, default_min)
    return (
        pairs.withColumn("peak", peak)
        .where(F.col("days_late") == F.col("peak"))
        .withColumn("label", label)
        .where(F.col("label").isNotNull() & F.col("installment_no").isNotNull())
        .groupBy("installment_no")
        .agg(
            F.sum("copies").alias("n_credits"),
            F.sum(F.when(F.col("label") == 0, F.col("copies")).otherwise(0)).alias("n_default"),
        )
        .where(F.col("n_credits") >= min_rows)
        .withColumn("default_rate", percentage(F.col("n_default"), F.col("n_credits")))
        .orderBy("installment_no")
    )
