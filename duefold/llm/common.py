"""Expressions and small helpers that several operators share."""

from __future__ import annotations

import string
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duefold.session import new_path, written

__all__ = [
    "ascii_lower",
    "bounded_batches",
    "column",
    "connected",
    "crc32_of_id",
    "long_array",
    "new_path",
    "removed",
    "stored",
    "text_slices",
    "without",
    "workers_find_package",
    "written",
]

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Bytes of rows that a Python worker receives at once, about.
BATCH = 2 << 20
#: Bits of the map that tells which rows can be among those that go: 1 MB.
MAP_BITS = 1 << 23


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z and nothing else; null stays null."""
    plain = F.length(text) == F.octet_length(text)
    moved = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.when(plain, F.lower(text)).otherwise(moved)


def crc32_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package where its folder is reachable under the same path.

    Elsewhere it has to be installed on the executors or shipped with ``--py-files``.
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".strip(":")


def bounded_batches(spark: SparkSession, most: int = BATCH) -> None:
    """Let Python workers receive at most about ``most`` bytes at once, unless the session asks for less.

    By default a batch holds ten thousand rows, or 64 MB: with whole texts that is what an executor keeps several
    times over, in buffers outside its heap and in each worker. A row is never cut.
    """
    known = spark.conf.get(_BATCH_BYTES, None)
    if known is None or _bytes(known) > most:
        spark.conf.set(_BATCH_BYTES, f"{most}b")


def _bytes(size: str) -> int:
    """``64m`` or ``67108864b`` as a number."""
    digits = size.rstrip(string.ascii_letters)
    unit = size[len(digits) :].lower()[:1]
    return int(digits) * (1 << 10 * "bkmgtp".index(unit or "b"))


def text_slices(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """(first row, texts as UTF-8) in slices of about ``most`` bytes; null is empty.

    Every text is whole; one longer than ``most`` makes a slice of its own.
    """
    first, held, size = 0, [], 0
    for row, text in enumerate(texts.cast(pa.large_binary())):
        value = text.as_py() or b""
        if held and size + len(value) > most:
            yield first, held
            first, held, size = row, [], 0
        held.append(value)
        size += len(value)
    if held:
        yield first, held


def long_array(values: np.ndarray) -> pa.Array:
    """Unsigned 64-bit words as signed longs of the same bits."""
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``written``, then give back the disk space of the job's shuffles.

    Spark removes shuffle files when the driver's JVM collects the plan that made them, which
    may be long after the job. For operators that run several large shuffles one after another.
    """
    result = written(df, name)
    df.sparkSession.sparkContext._jvm.System.gc()
    return result


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table under ``new_path`` that was read for the last time."""
    table = spark._jvm.org.apache.hadoop.fs.Path(path)
    table.getFileSystem(spark._jsc.hadoopConfiguration()).delete(table, True)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose ``keys`` are not among those of the stored frame ``gone``, by ``=``: null keys stay.

    Rows are wide and few of them go, so most are told at once by a bitmap of ``MAP_BITS`` bits, on which each key of
    ``gone`` falls; it is no larger however many go. Only rows on a set bit are shuffled for the exact join.
    """
    spot = F.pmod(F.xxhash64(*keys), F.lit(MAP_BITS))
    maps = (
        gone.select(spot.alias("spot"))
        .groupBy(F.expr("spot div 32768").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.col("spot") % 32768).alias("bits"))
    )
    byte = F.expr("cast(conv(hex(substring(bits, cast(spot % 32768 div 8 AS INT) + 1, 1)), 16, 10) AS INT)")
    on_bit = byte.bitwiseAND(F.expr("shiftleft(1, cast(spot % 8 AS INT))")) != 0
    told = (
        rows.withColumn("spot", spot)
        .withColumn("bucket", F.expr("spot div 32768"))
        .join(F.broadcast(maps), "bucket", "left")
        .withColumn("asked", F.coalesce(on_bit, F.lit(False)))
        .drop("bucket", "spot", "bits")
    )
    return told.where("NOT asked").drop("asked").unionByName(
        told.where("asked").drop("asked").join(gone, keys, "left_anti")
    )


def connected(nodes_linked: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Connected components: (node, component), the component being its smallest node.

    ``nodes_linked`` has two long columns, the ends of each link. Large-star and small-star
    rounds alternate until nothing changes. Each round is written to the shared folder, so lineage
    stays short; the driver sees only a count and a checksum. Minima combine before the
    shuffle and the joins can be split by adaptive execution, so a hub is no burden.
    Nodes without a link to another node are not returned. Null ends are ignored.
    """
    a, b = nodes_linked.columns
    links = (
        nodes_linked.where(column(a) != column(b))
        .select(F.greatest(column(a), column(b)).alias("u"), F.least(column(a), column(b)).alias("v"))
        .distinct()
    )
    links = written(links, "links")
    before = _checksum(links)
    for _ in range(most_rounds):
        if before == (0, None):
            break
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Stored, so that both sides of the join are shuffled and a hub's links can be split.
        least = written(
            both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least"
        )
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        ).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        links = written(small, "links")
        after = _checksum(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the components did not settle")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _checksum(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")
    ).first()
    return row[0], row[1]
