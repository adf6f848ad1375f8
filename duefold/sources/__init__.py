"""Readers and writers."""

from .readers import read_delimited, read_parquet, read_table, read_typed_csv
from .writers import (
    load_model,
    read_version,
    save_model,
    write_csv,
    write_parquet,
    write_report,
    write_table,
    write_version,
)

__all__ = [
    "load_model",
    "read_delimited",
    "read_parquet",
    "read_table",
    "read_typed_csv",
    "read_version",
    "save_model",
    "write_csv",
    "write_parquet",
    "write_report",
    "write_table",
    "write_version",
]
