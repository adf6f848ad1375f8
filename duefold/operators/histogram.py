"""Equal-width histogram with a closed last bin."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duefold.functions import named
from duefold.operators.missing import nan_to_null


def histogram(
    df: DataFrame, column: str, bins: int = 60, copies: str | None = None
) -> DataFrame:
    """Rows per bin between the least and the greatest value; empty bins are kept.

    ``copies`` names a column telling how many rows an input row stands for. When all values
    are equal the range is widened by a half on both sides; without values it is 0 to 1.
    """
    weight = F.lit(1) if copies is None else named(copies)
    values = nan_to_null(
        df.select(named(column).cast("double").alias("x"), weight.cast("bigint").alias("w"))
    ).where(F.col("x").isNotNull())

    # One row: least and greatest value.
    flat = F.min("x") == F.max("x")
    limits = values.agg(
        F.coalesce(F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")), F.lit(0.0)).alias("low"),
        F.coalesce(F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")), F.lit(1.0)).alias("high"),
    )
    low, high, x = F.col("low"), F.col("high"), F.col("x")

    def edge(index):
        return F.when(index == bins, high).otherwise(low + index * ((high - low) / bins))

    guess = F.least(F.floor((x - low) / (high - low) * bins).cast("int"), F.lit(bins - 1))
    # The division can land a value next to an edge in the neighbouring bin.
    bin_of = (
        F.when(x < edge(F.col("guess")), F.col("guess") - 1)
        .when((F.col("guess") < bins - 1) & (x >= edge(F.col("guess") + 1)), F.col("guess") + 1)
        .otherwise(F.col("guess"))
    )
    filled = (
        values.crossJoin(F.broadcast(limits))
        .withColumn("guess", guess)
        .groupBy(bin_of.alias("bin"))
        .agg(F.sum("w").alias("held"))
    )
    spark = df.sparkSession
    all_bins = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (
        all_bins.crossJoin(F.broadcast(limits))
        .join(F.broadcast(filled), "bin", "left")
        .select(
            "bin",
            edge(F.col("bin")).alias("left_edge"),
            edge(F.col("bin") + 1).alias("right_edge"),
            F.coalesce("held", F.lit(0)).cast("bigint").alias("n"),
        )
        .orderBy("bin")
    )
