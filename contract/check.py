"""Run every registered query beside its SQL and compare.

    python -m contract.check [folder of tables] [query ...]
"""

import glob
import os
import sys
import tempfile
import time

import duckdb
import pyarrow as pa
from pyspark import SparkConf
from pyspark.sql import SparkSession

from contract.oracles import ORACLES
from contract.queries import QUERIES


def spark_session(cores: str = "8", partitions: str = "8") -> SparkSession:
    shared = SparkConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="contract-")
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", partitions)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duckdb_session(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _rows(table: pa.Table) -> list[tuple]:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    # Minus zero prints apart from zero.
    columns = [[v + 0.0 if isinstance(v, float) else v for v in c] for c in columns]
    return sorted(map(repr, zip(*columns))) if columns else []


def _types(table: pa.Table) -> dict[str, str]:
    def plain(t: pa.DataType) -> str:
        return str(t).replace("large_string", "string")

    return {f.name: plain(f.type) for f in sorted(table.schema, key=lambda f: f.name)}


def differences(found: pa.Table, expected: pa.Table) -> str:
    """Empty when names, types and rows agree."""
    if _types(found) != _types(expected):
        return f"types {_types(found)} against {_types(expected)}"
    a, b = _rows(found), _rows(expected)
    if a == b:
        return ""
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"{len(a)} rows against {len(b)}; only here {only_a}; only there {only_b}"


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    chosen = sys.argv[2:] or list(QUERIES)
    spark, connection = spark_session(), duckdb_session(folder)
    failed = 0
    for name in chosen:
        start = time.time()
        try:
            found = QUERIES[name](spark, folder).toArrow()
            seconds = time.time() - start
            expected = connection.sql(ORACLES[name]).to_arrow_table()
            problem = differences(found, expected)
        except Exception as error:  # the check goes on with the next query
            seconds, problem = time.time() - start, f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:36s} {seconds:6.2f}s {problem}", flush=True)
    print(f"{len(chosen) - failed} of {len(chosen)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main())
