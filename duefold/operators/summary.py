"""Summary statistics of numeric columns."""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import named, round_half_even
from duefold.operators.quantiles import exact_quantiles, present, value_counts


def percentile_name(probability: float) -> str:
    """0.25 is ``p25`` and 0.999 is ``p99_9``."""
    return "p" + f"{100 * probability:.10g}".replace(".", "_")


def summary(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float] = (0.25, 0.5, 0.75),
    digits: int | None = None,
    small_domain: bool = False,
    count_negative: bool = False,
) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles: one row per column.

    The columns are melted. With ``small_domain``, which promises few different values a column,
    equal values are counted together first and every statistic comes from these counts;
    otherwise from the rows, without shuffling them. The median is always included. ``digits``
    rounds half to even.
    """
    points = sorted({*probabilities, 0.5})
    melted = df.select(*[named(c).cast("double").alias(c) for c in columns]).unpivot(
        [], [named(c) for c in columns], "column", "value"
    )
    if small_domain:
        counts = value_counts(melted, "value", ["column"])
    else:
        counts = present(melted, "value", ["column"]).withColumn("copies", F.lit(1))

    value, copies = F.col("value"), F.col("copies")
    aggregates = [
        F.sum("copies").alias("count"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.sum(F.when(value < 0, copies).otherwise(0)).alias("n_negative"),
    ]
    # Deviations from the mean, not sums of squares, which would cancel: rows in a second pass, since moments
    # that merge lose digits of a spread far below the mean; the few different values, which ``percentile``
    # gathers too, by their list.
    if small_domain:
        aggregates += [
            F.collect_list(F.struct("value", "copies")).alias("held"),
            F.percentile("value", points, copies).alias("quantiles"),
        ]
    else:
        aggregates.append(F.avg("value").alias("mean"))
    totals = counts.groupBy("column").agg(*aggregates)
    if small_domain:
        zero = F.lit(0.0)
        total = F.aggregate("held", zero, lambda t, x: t + x["value"] * x["copies"])
        totals = totals.withColumn("mean", total / F.col("count"))
        squares = F.aggregate(
            "held",
            zero,
            lambda t, x: t + x["copies"] * (x["value"] - F.col("mean")) * (x["value"] - F.col("mean")),
        )
        spread = F.sqrt(squares / F.nullif(F.col("count") - 1, F.lit(0)))
        totals = totals.withColumn("std", spread).drop("held")
    else:
        apart = value - F.col("mean")
        # What rounding of the mean adds to the squares is taken off again.
        squares = F.greatest(F.sum(apart * apart) - F.sum(apart) * F.sum(apart) / F.count("*"), F.lit(0.0))
        spread = F.sqrt(squares / F.nullif(F.count("*") - 1, F.lit(0)))
        means = F.broadcast(totals.select("column", "mean"))
        spreads = counts.join(means, "column").groupBy("column").agg(spread.alias("std"))
        totals = totals.join(F.broadcast(spreads), "column")
    parts = [totals]
    if not small_domain:
        parts.append(exact_quantiles(melted, "value", points, ["column"]))

    names = df.sparkSession.range(1).select(
        F.posexplode(F.array(*[F.lit(c) for c in columns])).alias("position", "column")
    )
    wide = names
    for part in parts:
        wide = wide.join(F.broadcast(part), "column", "left")
    numbers = {
        "mean": F.col("mean"),
        "std": F.col("std"),
        "min": F.col("min"),
        **{percentile_name(p): F.col("quantiles")[i] for i, p in enumerate(points)},
        "max": F.col("max"),
    }
    if digits is not None:
        numbers = {name: round_half_even(number, digits) for name, number in numbers.items()}
    extra = [F.coalesce("n_negative", F.lit(0)).alias("n_negative")] if count_negative else []
    return wide.orderBy("position").select(
        "column",
        F.coalesce("count", F.lit(0)).alias("count"),
        *[number.alias(name) for name, number in numbers.items()],
        *extra,
    )
