import datetime as dt

import pytest
from pyspark.sql import functions as F

from duefold.operators import regression as R
from duefold.session import new_path, shared_folder, written
from duefold.sources import (
    load_model, read_delimited, read_parquet, read_table, read_typed_csv, save_model,
    write_csv, write_parquet, write_report, write_table,
)
from duefold.sources import schemas
from duefold.sources.writers import new_version, read_version, versions, write_version

from .conftest import rows_of

RAW = """valor_pagado,credito_id_anon,cliente_id_anon,fecha_desembolso,numero_cuota,dias_retraso,fecha_t_pago,fecha_pago,extra
10.5,c1,k1,2024-01-05,1,3.0,2024-02-09,2024-02-12 10:00:00,x
NaN,c1,k1,2024-01-05,2,,2024-03-09,NA,y
,,null,2024-01-06,N/A,-4,,,z
"""


def test_raw_installments(spark, tmp_path):
    (tmp_path / "pagos.csv").write_text(RAW)
    df = read_typed_csv(
        spark, str(tmp_path / "pagos.csv"), schemas.INSTALLMENTS, schemas.INSTALLMENT_NAMES
    )
    assert df.schema == schemas.INSTALLMENTS
    assert rows_of(df) == [
        ("c1", "k1", dt.datetime(2024, 1, 5), 1, 3, dt.datetime(2024, 2, 9), dt.datetime(2024, 2, 12, 10), 10.5),
        ("c1", "k1", dt.datetime(2024, 1, 5), 2, None, dt.datetime(2024, 3, 9), None, None),
        (None, None, dt.datetime(2024, 1, 6), None, -4, None, None, None),
    ]


def test_bad_cells_and_missing_columns_raise(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(RAW.replace(",-4,", ",soon,"))
    read = lambda: read_typed_csv(
        spark, str(tmp_path / "bad.csv"), schemas.INSTALLMENTS, schemas.INSTALLMENT_NAMES
    )
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read().collect()
    (tmp_path / "bad.csv").write_text(RAW.replace("dias_retraso", "dias"))
    with pytest.raises(Exception, match="days_late"):
        read()
    (tmp_path / "bad.csv").write_text(RAW.replace(",-4,", ",1.5,"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read().collect()


def test_unused_text_is_not_parsed(spark, tmp_path):
    (tmp_path / "bad.csv").write_text(RAW.replace(",-4,", ",soon,"))
    df = read_typed_csv(
        spark, str(tmp_path / "bad.csv"), schemas.INSTALLMENTS, schemas.INSTALLMENT_NAMES
    )
    assert df.where("credit_id IS NOT NULL").select("credit_id").count() == 2


def test_other_date_patterns(spark, tmp_path):
    (tmp_path / "p.csv").write_text(RAW.splitlines()[0] + "\n1,c,k,05/01/2024,1,0,09/02/2024,,x\n")
    df = read_typed_csv(
        spark, str(tmp_path / "p.csv"), schemas.INSTALLMENTS, schemas.INSTALLMENT_NAMES,
        timestamp_pattern="dd/MM/yyyy",
    )
    assert df.select("due_at").collect()[0].due_at == dt.datetime(2024, 2, 9)


def test_csv_keeps_awkward_text(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 2, 'say "hi", ok', 1, None, 3, "t", None, "$1,234.50"), (2, None, None, *[None] * 6)],
        schemas.VEHICLES,
    )
    write_csv(df, str(tmp_path / "v"))
    back = read_typed_csv(spark, str(tmp_path / "v"), schemas.VEHICLES)
    assert sorted(rows_of(back)) == sorted(rows_of(df))


def test_microseconds_survive_csv(spark, tmp_path):
    moment = dt.datetime(2024, 1, 2, 3, 4, 5, 678901)
    df = spark.createDataFrame([("a", "b", moment, 1, 2, moment, None, 0.1)], schemas.INSTALLMENTS)
    write_csv(df, str(tmp_path / "i"))
    assert rows_of(read_typed_csv(spark, str(tmp_path / "i"), schemas.INSTALLMENTS)) == rows_of(df)


def test_delimited_with_wildcard(spark, tmp_path):
    df = spark.createDataFrame([(1, "95%"), (2, None)], "id int, rating string")
    write_csv(df, str(tmp_path / "day=1"), sep="|")
    back = read_delimited(spark, str(tmp_path / "day*"), sep="|").select("id", "rating")
    assert sorted(rows_of(back)) == [(1, "95%"), (2, None)]
    assert dict(back.dtypes)["id"] == "int"


def test_parquet_modes_and_pruning(spark, tmp_path):
    df = spark.range(4).selectExpr("id", "id % 2 AS part", "IF(id = 1, double('NaN'), 1.0D) AS x")
    path = str(tmp_path / "t")
    write_parquet(df, path, partition_by=["part"])
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        write_parquet(df, path, if_exists="fail")
    back = read_parquet(spark, path, ["id", "x"])
    assert sorted(rows_of(back), key=str) == [(0, 1.0), (1, None), (2, 1.0), (3, 1.0)]
    plan = read_parquet(spark, path, ["id"])._jdf.queryExecution().toString()
    assert "ReadSchema: struct<id:bigint>" in plan


def test_table_modes(spark):
    df = spark.createDataFrame([(1, "a", 2.0)], "gear int, name string, extra double")
    write_table(df, "bikes", "replace")
    with pytest.raises(Exception, match="TABLE_OR_VIEW_ALREADY_EXISTS|already exists"):
        write_table(df, "bikes", "fail")
    write_table(df, "bikes", "append")
    back = read_table(spark, "bikes", ["name", "gear"], index=["name"])
    assert back.columns == ["name", "gear"] and rows_of(back) == [("a", 1), ("a", 1)]
    write_table(df, "bikes", "replace")
    assert read_table(spark, "bikes").count() == 1
    spark.sql("DROP TABLE bikes")


def test_model_versions(spark, tmp_path):
    path = str(tmp_path / "regressor")
    options = R.ModelOptions(target="y", features=("x",))
    df = spark.range(10).selectExpr("double(id) AS x", "1 + 2.0D * id AS y")
    first = save_model(R.fit(df, options), path)
    save_model(R.fit(df.selectExpr("x", "-y AS y"), options), path)
    assert versions(spark, path)[0] == first and len(versions(spark, path)) == 2
    assert load_model(spark, path).stages[-1].coefficients[0] == pytest.approx(-2)
    assert load_model(spark, path, first).stages[-1].coefficients[0] == pytest.approx(2)


def test_torn_versions_are_never_read(spark, tmp_path):
    path = str(tmp_path / "versions")
    assert versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        read_version(spark, path)
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")
    first = write_version(df, path, "json", ignoreNullFields=False)
    second = write_version(df.where("a = 2"), path)
    # A job that died: its folder is there, whole or not, but no manifest, or an empty one.
    df.write.parquet(f"{path}/9999-torn")
    (tmp_path / "versions/_versions/9999-empty.json").write_text("")
    assert versions(spark, path) == [first, second]
    assert rows_of(read_version(spark, path)) == [(2, 0.5)]
    assert sorted(rows_of(read_version(spark, path, first))) == [(1, None), (2, 0.5)]
    assert read_version(spark, path, first).schema == df.schema
    with pytest.raises(FileNotFoundError):
        read_version(spark, path, "9999-torn")
    with pytest.raises(Exception, match="(?i)exist"):
        write_version(df, path, version=second)


def test_versions_sort_by_time():
    assert new_version() < new_version()


@pytest.mark.parametrize("file_format", ["json", "parquet"])
def test_reports(spark, tmp_path, file_format):
    df = spark.createDataFrame([(1, None), (2, 0.5)], "a int, b double")
    place = write_report(df, str(tmp_path / "r"), file_format)
    again = write_report(df, str(tmp_path / "r"), file_format)
    assert place != again
    back = spark.read.schema(df.schema).format(file_format).load(place)
    assert sorted(rows_of(back)) == [(1, None), (2, 0.5)]


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder
    assert new_path(spark, "a").startswith(f"{folder}/a-") and new_path(spark, "a") != new_path(spark, "a")
    copy = written(spark.range(3).withColumn("x", F.lit(1.5)), "t")
    assert copy.count() == 3 and "Range" not in copy._jdf.queryExecution().toString()
