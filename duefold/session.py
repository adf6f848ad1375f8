"""Where jobs may leave files."""

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, taken from ``spark.checkpoint.dir``.

    A machine-local folder would lose files, so an unset value is an error everywhere.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows as a parquet table in the shared folder, its lineage cut.

    For a frame that several jobs read: they scan a narrow file instead of repeating the joins
    before it, and a lost executor costs no recomputation.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
