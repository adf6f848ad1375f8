"""Every registered query against its SQL on the smallest tables."""

import subprocess
import sys

import pytest

import __spark_entry__ as entry_points
from contract.oracles import ORACLES
from contract.check import differences, duckdb_session
from contract.queries import QUERIES

from .conftest import SMALL


@pytest.fixture(scope="module")
def connection():
    return duckdb_session(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


def test_entry_without_the_optional_package():
    """What that package needs cannot be imported: the other queries are all there."""
    code = (
        "import sys; sys.modules['ahocorasick'] = None; sys.modules['xxhash'] = None\n"
        "import __spark_entry__ as e; from contract.queries import QUERIES\n"
        "assert e.queries().keys() == QUERIES.keys() == e.oracle_sql().keys()"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)


def test_entry(spark):
    row = entry_points.entry(spark).collect()[0]
    assert row.n_mature + row.n_immature == row.n_credits > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, name):
    found = QUERIES[name](spark, SMALL).toArrow()
    expected = connection.sql(ORACLES[name]).to_arrow_table()
    assert differences(found, expected) == ""
    # The smallest tables have no date errors; those ten times larger do.
    assert found.num_rows > 0 or name == "negative_gaps"


def test_the_session_zone_changes_nothing(spark, connection):
    """A zone whose clock change falls on midnight, where some local times do not exist."""
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        for name in ("first_due", "maturity_report", "parsed_dates", "installments_csv_round_trip"):
            test_query_equals_sql(spark, connection, name)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
