import datetime as dt

import pytest
from pyspark.sql import SparkSession

from duefold.sources.schemas import INSTALLMENTS

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def payments(spark):
    """Installments from tuples (credit, installment, days late, disbursed, due)."""

    def build(*rows):
        full = [(c, "client", d, n, late, due, None, 1.0) for c, n, late, d, due in rows]
        return spark.createDataFrame(full, INSTALLMENTS)

    return build


def day(text):
    return dt.datetime.fromisoformat(text)


def rows_of(df):
    return [tuple(r) for r in df.collect()]
