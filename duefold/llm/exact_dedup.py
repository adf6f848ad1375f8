"""Exact dedup against a persistent digest index.

The index is a parquet table bucketed and sorted by the SHA-256 digest of the normalised
text. A batch is reduced to one row per digest before its first shuffle, dealt by digest
into the index's buckets, and anti-joined by sort-merge; the index side is read bucket by bucket
without a shuffle. What is left is new and gets appended. Only built-in functions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duefold.llm.common import ascii_lower, column, new_path, written


def digest(text: Column) -> Column:
    """SHA-256 (lowercase hex) of the text, A-Z lowered, in UTF-8; null counts as empty."""
    return F.sha2(F.coalesce(ascii_lower(text), F.lit("")).cast("binary"), 256)


@dataclass(frozen=True)
class DigestIndex:
    """A registered index: catalog name, folder and number of buckets."""

    name: str
    path: str
    buckets: int

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.table(self.name)


def open_index(
    spark: SparkSession, path: str, buckets: int, name: str | None = None
) -> DigestIndex:
    """Register the index in ``path``, empty if the folder holds none.

    The catalog may forget the name between sessions, the files stay. ``buckets`` must be the
    number with which the index was first written; about one per 128 MB expected.
    """
    name = name or f"digest_index_{uuid.uuid4().hex}"
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} (digest STRING, keep_id BIGINT) USING parquet "
        f"CLUSTERED BY (digest) SORTED BY (digest) INTO {int(buckets)} BUCKETS LOCATION '{path}'"
    )
    return DigestIndex(name, path, buckets)


def deduplicate(
    docs: DataFrame, index: DigestIndex, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Look up and append a batch; one row per row of ``docs``.

    Columns: the id, keep_id, group_size (rows of the batch with this text), kept, text_sha256.

    * A text the index holds keeps the index's document; kept is true only for that id, so a batch
      that is given again gets the same answer.
    * Of equal new texts the row with the largest id stays.
    * Null texts are empty texts. A null id stays only if no other row has its text, and an
      index entry with a null id keeps no later row. Rows that repeat the kept id are all marked kept.
    * An empty batch returns no rows and appends none. Other columns are ignored.
    """
    spark = docs.sparkSession
    rows = written(
        docs.select(column(id_column).alias("id"), digest(column(text_column)).alias("digest")),
        "digests",
    )
    # One row per text: partial maxima and counts are taken before the shuffle.
    groups = written(
        rows.groupBy("digest").agg(F.max("id").alias("newest"), F.count("*").alias("group_size")),
        "groups",
    ).repartition(index.buckets, "digest")
    fresh = groups.hint("merge").join(index.read(spark), "digest", "left_anti")
    (
        fresh.select("digest", F.col("newest").alias("keep_id"))
        .sortWithinPartitions("digest")
        .write.format("parquet")
        .mode("append")
        .bucketBy(index.buckets, "digest")
        .sortBy("digest")
        .option("path", index.path)
        .saveAsTable(index.name)
    )
    # Every text is in the index now. The answers are stored, so that both sides of the last
    # join are shuffled and adaptive execution can split a text that a third of the rows share.
    answers = written(
        groups.hint("merge").join(index.read(spark), "digest")
        .select("digest", "keep_id", "group_size"),
        "answers",
    )
    return rows.join(answers, "digest").select(
        F.col("id").alias(id_column),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_dedup(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    buckets: int | None = None,
) -> DataFrame:
    """``deduplicate`` against a new index in the shared folder."""
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = open_index(spark, new_path(spark, "digest-index"), buckets)
    return deduplicate(docs, index, id_column, text_column)


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose document stays, with their columns.

    Of rows that repeat both id and text one is kept. Texts are shuffled once, for the join;
    dropping repeated rows reuses its partitions.
    """

    def row_key(doc_id: Column, text_digest: Column) -> Column:
        return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), text_digest)

    kept = exact_dedup(docs).where("kept")
    keys = kept.select(row_key(F.col("doc_id"), F.col("text_sha256")).alias("row_key"))
    return (
        docs.select(
            F.struct("*").alias("doc"),
            row_key(F.col("doc_id"), digest(F.col("text"))).alias("row_key"),
        )
        .join(keys, "row_key", "left_semi")
        .dropDuplicates(["row_key"])
        .select("doc.*")
    )
