"""Exact, linearly interpolated quantiles that need no task to hold all values.

Where the different values are few (day counts, ratings) equal ones are counted together, on the
map side already, and the built-in ``percentile`` finishes on the counts. Where they may be as
many as the rows (money) the column is never shuffled: the rows are cut into ranges at
approximate edges, ranges are counted exactly, and only the rows of ranges that hold a wanted
rank go on. Ranges that still hold many rows are cut again. Equal values of what is left are
counted together and put in order.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duefold.functions import named
from duefold.operators.missing import nan_to_null
from duefold.session import written


def present(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """The groups and ``value``, rows without one of them dropped."""
    kept = nan_to_null(df.select(*map(named, by), named(column).alias("value")), ["value"])
    for name in (*by, "value"):
        kept = kept.where(named(name).isNotNull())
    return kept


def value_counts(df: DataFrame, column: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows per different value, within groups if given; missing values and groups dropped."""
    kept = present(df, column, by)
    return kept.groupBy(*map(named, by), "value").agg(F.count(F.lit(1)).alias("copies"))


def quantiles_from_counts(
    counts: DataFrame, probabilities: Sequence[float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles per group as an array, from the output of :func:`value_counts`.

    For groups of few different values: one task holds those of a group.
    """
    return counts.groupBy(*map(named, by)).agg(
        F.percentile("value", list(probabilities), F.col("copies")).alias("quantiles")
    )


def exact_quantiles(
    df: DataFrame,
    column: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    small_domain: bool = False,
) -> DataFrame:
    """Exact quantiles of a numeric column, per group if given; no row for a group without values.

    ``small_domain`` promises that a group has few different values. Otherwise the rows are read
    two times for each level of ranges and once more, by jobs that store edges and ranges in the
    shared folder, so a frame that is costly to make is better stored first.
    """
    if small_domain:
        return quantiles_from_counts(value_counts(df, column, by), probabilities, by)
    keys = [f"by_{i}" for i in range(len(by))]
    rows = df.select(
        *[named(name).alias(key) for name, key in zip(by, keys)], named(column).alias("value")
    )
    found = _ordered_quantiles(present(rows, "value", keys), probabilities, keys)
    return found.select(*[F.col(key).alias(name) for name, key in zip(by, keys)], "quantiles")


_STEP = 16
_RANGES = _STEP * _STEP
#: A wanted range of more rows is cut again, up to so many levels in all. Rows that are left are
#: ordered whole, whatever their number; these two decide balance only.
_FINE_ROWS = 1 << 20
_LEVELS = 4


def _edges() -> Column:
    """``_RANGES - 1`` ascending values that cut a group into parts of nearly the same size."""
    # The shares as one text literal: a thousand separate literals make planning slow.
    text = ",".join(str(i / _RANGES) for i in range(1, _RANGES))
    shares = F.split(F.lit(text), ",").cast("array<double>")
    return F.percentile_approx("value", shares, 4 * _RANGES).alias("edges")


def _cut(rows: DataFrame, kept: Sequence[str], cut: str) -> DataFrame:
    """``kept`` and, as ``cut``, how many of a row's ascending edges are less than its value.

    In two steps, first among every sixteenth edge; plain comparisons, which are compiled, unlike
    a fold over an array.
    """

    def less(position: Column) -> Column:
        # Never null, so that no null test of the whole sum is moved below it.
        return F.when(F.element_at("edges", position) < F.col("value"), 1).otherwise(0)

    coarse = sum((less(F.lit(_STEP * i)) for i in range(2, _STEP)), less(F.lit(_STEP)))
    at = F.col("coarse") * _STEP
    fine = sum((less(at + i) for i in range(2, _STEP)), less(at + 1))
    return rows.withColumn("coarse", coarse).select(*kept, (at + fine).alias(cut))


def _ordered_quantiles(
    rows: DataFrame, probabilities: Sequence[float], by: Sequence[str]
) -> DataFrame:
    # For each probability the two ranks whose values it lies between, counted from zero.
    points = "array(" + ", ".join(f"{float(p)!r}D" for p in probabilities) + ")"
    pair = "array(floor(p * (total - 1)), ceil(p * (total - 1)))"
    ranks = F.expr(f"flatten(transform({points}, p -> {pair}))")

    keys = list(by)
    wanted = None
    for level in range(_LEVELS):
        # Edges only decide how evenly the rows spread over the ranges; ranks are counted exactly,
        # so approximate edges give exact quantiles. The first cut is the same for all groups: one
        # row, safe to broadcast. Later tables have at most two ranges per probability and
        # group; they are stored, so Spark knows their size and decides.
        if wanted is None:
            edges = written(rows.agg(_edges()), "quantile-edges")
            placed = rows.crossJoin(F.broadcast(edges))
        else:
            edges = written(rows.groupBy(*keys).agg(_edges()), "quantile-edges")
            placed = rows.join(edges, keys)
        cut = f"cut_{level}"
        placed = _cut(placed, [*keys, "value"], cut)
        counted = placed.groupBy(*keys, cut).agg(
            F.count(F.lit(1)).alias("held"), F.min("value").alias("low"), F.max("value").alias("high")
        )
        # At most ``_RANGES`` rows per group.
        group = Window.partitionBy(*keys)
        earlier = group.orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
        below = F.coalesce(F.sum("held").over(earlier), F.lit(0))
        if wanted is None:
            located = counted.withColumns(
                {"total": F.sum("held").over(group), "before": below}
            ).withColumn("ranks", ranks)
        else:
            outer = wanted.select(*keys, "total", "ranks", F.col("before").alias("outer"))
            located = counted.withColumn("below", below).join(outer, keys)
            located = located.withColumn("before", F.col("outer") + F.col("below"))
        inside = "array_distinct(filter(ranks, r -> r >= before AND r < before + held))"
        located = located.withColumn("ranks", F.expr(inside)).where("size(ranks) > 0")
        keys = [*keys, cut]
        wanted = written(
            located.select(*keys, "total", "before", "held", "ranks", "low", "high"), "quantile-ranges"
        )
        # Keys are unique; a semi join would move below the cut and compute it many times over.
        rows = placed.join(wanted.select(*keys), keys)
        if wanted.where((F.col("held") > _FINE_ROWS) & (F.col("low") < F.col("high"))).isEmpty():
            break

    within = Window.partitionBy(*keys).orderBy("value")
    up_to = within.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        rows.groupBy(*keys, "value")
        .agg(F.count(F.lit(1)).alias("copies"))
        .join(wanted.select(*keys, "total", "before", "ranks"), keys)
        .withColumn("upto", F.col("before") + F.sum("copies").over(up_to))
        .select(
            *by,
            "total",
            F.col("value").cast("double").alias("value"),
            F.expr("explode(filter(ranks, r -> r >= upto - copies AND r < upto))").alias("rank"),
        )
    )
    # Two entries per probability and group.
    at = F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("at")
    low, high = "at[floor(p * (total - 1))]", "at[ceil(p * (total - 1))]"
    between = f"{low} + ({high} - {low}) * (p * (total - 1) - floor(p * (total - 1)))"
    return (
        found.groupBy(*by, "total")
        .agg(at)
        .select(*by, F.expr(f"transform({points}, p -> {between})").alias("quantiles"))
    )
