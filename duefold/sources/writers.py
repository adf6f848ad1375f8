"""Files, tables, models and reports out."""

import datetime
import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_WRITE_MODES = {"replace": "overwrite", "fail": "errorifexists", "append": "append"}


def write_parquet(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), if_exists: str = "replace"
) -> None:
    df.write.mode(_WRITE_MODES[if_exists]).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", if_exists: str = "replace") -> None:
    """CSV with a header in every file; missing values are empty cells.

    Quotes inside cells are doubled. Line breaks inside cells are written as they are; such
    files are read back with ``multi_line``.
    """
    (
        df.write.mode(_WRITE_MODES[if_exists])
        .options(
            header=True,
            sep=sep,
            emptyValue="",
            escape='"',
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
            timestampNTZFormat="yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]",
        )
        .csv(path)
    )


def write_table(
    df: DataFrame, name: str, if_exists: str = "fail", path: str | None = None
) -> None:
    """A catalog table: replaced, appended to, or refused when it exists."""
    writer = df.write.mode(_WRITE_MODES[if_exists])
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)


# A version is a folder that nobody reads before its manifest names it. The manifest is one small
# file, created last and never overwritten, so a job that dies leaves a folder without a name.
_MANIFESTS = "_versions"


def new_version() -> str:
    """A version name that sorts by time."""
    now = datetime.datetime.now(datetime.timezone.utc)
    return now.strftime("%Y-%m-%dT%H.%M.%S.%fZ")


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _publish(spark: SparkSession, path: str, version: str, details: dict) -> None:
    files, manifest = _file_system(spark, f"{path}/{_MANIFESTS}/{version}.json")
    # An error if the version has been published before.
    out = files.create(manifest, False)
    try:
        out.write(bytearray(json.dumps({"version": version, **details}, sort_keys=True).encode()))
    finally:
        out.close()


def versions(spark: SparkSession, path: str) -> list[str]:
    """Published versions under ``path``, oldest first, on any file system Spark can reach."""
    files, folder = _file_system(spark, f"{path}/{_MANIFESTS}")
    if not files.exists(folder):
        return []
    found = (s for s in files.listStatus(folder) if s.isFile() and s.getLen() > 0)
    names = (s.getPath().getName() for s in found)
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json"))


def _published(spark: SparkSession, path: str, version: str | None) -> str:
    known = versions(spark, path)
    if not known or version is not None and version not in known:
        raise FileNotFoundError(f"no published version {version or ''} under {path}")
    return version or known[-1]


def write_version(
    df: DataFrame, path: str, file_format: str = "parquet", version: str | None = None, **options
) -> str:
    """The rows as a new version under ``path``; returns its name. Older versions stay.

    A version that exists, published or half-written, raises.
    """
    version = version or new_version()
    df.write.mode("errorifexists").options(**options).format(file_format).save(f"{path}/{version}")
    _publish(df.sparkSession, path, version, {"format": file_format, "schema": df.schema.json()})
    return version


def read_version(spark: SparkSession, path: str, version: str | None = None) -> DataFrame:
    """A published version, the newest unless named, with the columns and types it was written with."""
    name = _published(spark, path, version)
    text = spark.read.option("wholetext", True).text(f"{path}/{_MANIFESTS}/{name}.json").first()[0]
    manifest = json.loads(text)
    schema = T.StructType.fromJson(json.loads(manifest["schema"]))
    return spark.read.schema(schema).format(manifest["format"]).load(f"{path}/{name}")


def write_report(report: DataFrame, path: str, file_format: str = "json") -> str:
    """A small result under a new version of ``path``; returns where it was written.

    JSON keeps null fields, so that a report reads back with all its columns.
    """
    options = {"ignoreNullFields": False} if file_format == "json" else {}
    return f"{path}/{write_version(report, path, file_format, **options)}"


def save_model(model: PipelineModel, path: str, version: str | None = None) -> str:
    """Save under ``path/version``, a new version unless named; returns the version."""
    version = version or new_version()
    model.write().save(f"{path}/{version}")
    _publish(SparkSession.active(), path, version, {"format": "model"})
    return version


def load_model(spark: SparkSession, path: str, version: str | None = None) -> PipelineModel:
    """Load a published version, the newest unless named."""
    return PipelineModel.load(f"{path}/{_published(spark, path, version)}")
