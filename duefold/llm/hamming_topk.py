"""Exact k nearest binary codes by incremental multi-index hashing.

A code of b bits is cut into segments. Two codes at distance d have a segment in which they differ in at most
d / segments bits. Round r looks up, for each open query and segment, the codes whose segment differs in
exactly r bits; after it, every code within segments * (r + 1) - 1 bits has been met. Full
distances are verified, the best k kept, and a query is closed once its k-th distance is covered.
Rounds go on for the open queries until none is left.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from duefold.llm.common import column, written

SEGMENTS = 4
BITS = 64


def sign_code(vector: Column, bits: int = BITS) -> Column:
    """The signs of up to ``bits`` numbers as a long, bit i for number i; null, NaN and missing count as 0.

    A longer vector is an error: its other numbers would not count.
    """
    if bits > 64:
        raise ValueError("a code has at most 64 bits")
    longer = F.raise_error(F.lit(f"a vector of more than {bits} numbers")).cast("long")
    code = F.when(F.size(vector) > bits, longer).otherwise(F.lit(0).cast("long"))
    for k in range(bits):
        number = F.get(vector, F.lit(k))
        positive = F.coalesce((number > 0) & ~F.isnan(number), F.lit(False))
        code = code.bitwiseOR(F.when(positive, F.lit(1 << k if k < 63 else -(1 << 63))).otherwise(0))
    return code


def _segment(code: Column, k: int, width: int) -> Column:
    return F.shiftrightunsigned(code, k * width).bitwiseAND((1 << width) - 1).cast("long")


def _flips(width: int, radius: int) -> list[int]:
    """Words of ``width`` bits with exactly ``radius`` bits set."""
    return [sum(1 << b for b in bits) for bits in combinations(range(width), radius)]


def top_k(
    codes: DataFrame,
    queries: DataFrame,
    k: int = 10,
    bits: int = BITS,
    segments: int = SEGMENTS,
) -> DataFrame:
    """(query_id, neighbor_id, distance, rank): the k nearest rows of ``codes`` to each query.

    Both frames have (id, code). Order is by distance, then id; a row with the query's id is not among
    its neighbors. Queries with fewer than k other rows get all of them. Null ids are left out on
    both sides; a row that repeats an id counts once, with its smallest code. Empty frames give no rows.

    Rows of one code are one entry of the index, with their k + 1 smallest ids, since no other of them can
    be an answer; queries of one code share one search. So a code that a third of the rows
    have costs no more than any other.
    """
    if bits % segments:
        raise ValueError("segments must have equal widths")
    spark = codes.sparkSession
    width = bits // segments
    codes = written(
        codes.where("id IS NOT NULL").groupBy("id").agg(F.min("code").alias("code")), "codes"
    )
    total = codes.count()
    # A limit by rank is applied before the shuffle too, so a hot code sends k + 1 ids a task.
    entries = _first(codes, "code", ["id"], k + 1).groupBy("code").agg(
        F.collect_list("id").alias("ids")
    )
    parts = [
        F.struct(F.lit(s).alias("segment"), _segment(F.col("code"), s, width).alias("value"))
        for s in range(segments)
    ]
    index = written(
        entries.select("code", "ids", F.inline(F.array(*parts))), "segments"
    )
    asked = written(
        queries.where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.min("code").alias("query"))
        .withColumnRenamed("id", "query_id"),
        "queries",
    )
    # ``far``: distance of the (k + 1)-th best so far; no code beyond it can be an answer.
    opened = written(asked.select("query", F.lit(bits).alias("far")).distinct(), "open")
    best, closed = None, None
    for radius in range(width + 1):
        if opened.isEmpty():
            break
        found = _met(opened, index, radius, segments, width, spark)
        if best is not None:
            found = found.unionByName(best)
        best = written(_first(found, "query", ["distance", "id"], k + 1), "best")
        covered = segments * (radius + 1) - 1
        state = best.groupBy("query").agg(
            F.count("*").alias("n"), F.max("distance").alias("reach")
        )
        full = F.col("n") > k
        state = written(
            opened.drop("far")
            .join(state, "query", "left")
            .select(
                "query",
                F.when(full, F.col("reach")).otherwise(bits).alias("far"),
                F.coalesce((F.col("n") >= total) | (full & (F.col("reach") <= covered)), F.lit(False))
                .alias("done"),
            ),
            "state",
        )
        answers = best.join(state.where("done"), "query", "left_semi")
        closed = answers if closed is None else closed.unionByName(answers)
        opened = state.where("NOT done").select("query", "far")
        best = best.join(opened, "query", "left_semi")
    if closed is None:
        return spark.createDataFrame(
            [], "query_id long, neighbor_id long, distance int, rank int"
        )
    own = W.partitionBy("query_id").orderBy("distance", "neighbor_id")
    return (
        asked.join(closed, "query")
        .where("query_id != id")
        .select("query_id", F.col("id").alias("neighbor_id"), "distance")
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
    )


def _first(rows: DataFrame, group: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each group."""
    at = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return rows.withColumn("at", at).where(F.col("at") <= most).drop("at")


def _met(
    opened: DataFrame, index: DataFrame, radius: int, segments: int, width: int, spark
) -> DataFrame:
    """(query, id, distance) of codes that have a segment at ``radius`` and none nearer.

    A pair is met once: in the first of its segments that are nearest. Once the first s segments have
    been looked up at this radius, every code within segments * radius + s - 1 bits has been met, so a query
    asks no further segments than its ``far`` needs.
    """
    flips = spark.createDataFrame([(_flips(width, radius),)], "flips array<long>")
    parts = [
        F.struct(F.lit(s).alias("segment"), _segment(F.col("query"), s, width).alias("own"))
        for s in range(segments)
    ]
    # One row of at most 2^(width of a segment) words joins every open query.
    probes = (
        opened.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "query")
        .select("query", "far", F.inline(F.array(*parts)))
        .where(F.col("segment") <= F.col("far") - segments * radius)
        .join(F.broadcast(flips))
        .select("query", "far", "segment", F.explode("flips").alias("flip"), "own")
        .select("query", "far", "segment", F.col("own").bitwiseXOR(F.col("flip")).alias("value"))
    )
    apart = F.col("query").bitwiseXOR(F.col("code"))
    ranks = [F.bit_count(_segment(apart, s, width)) * segments + s for s in range(segments)]
    return (
        probes.join(index, ["segment", "value"])
        .where(F.bit_count(apart) <= F.col("far"))
        .where(F.least(*ranks) == radius * segments + F.col("segment"))
        .select("query", F.bit_count(apart).alias("distance"), F.explode("ids").alias("id"))
        .select("query", "id", "distance")
    )


def nearest_signs(
    vectors: DataFrame,
    k: int = 10,
    every: int = 20,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """``top_k`` of sign codes, for the rows whose id ``every`` divides against all rows.

    A null vector has code zero, as has one without positive numbers. Other columns are ignored.
    """
    codes = vectors.select(
        column(id_column).cast("long").alias("id"), sign_code(column(vector_column)).alias("code")
    )
    codes = written(codes, "sign-codes")
    return top_k(codes, codes.where(F.col("id") % every == 0), k)
