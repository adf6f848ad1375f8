"""Inputs derived from the given parquet tables, with gaps and errors put in.

The given tables hold no nulls, no clock times and no text-coded numbers, so these are made
by rule from their values. ``FIXTURES.md`` has the same definitions as SQL.
"""

from pyspark.sql import DataFrame, SparkSession


# The columns used of each given table. Stated, so that reading starts no job to look them up.
_SCHEMAS = {
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate TIMESTAMP_NTZ",
    "part": "p_partkey BIGINT, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "supplier": "s_suppkey BIGINT",
    "labels": "quality INT, toxic INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING",
}


def given_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{folder}/{name}.parquet")


def installments(spark: SparkSession, folder: str) -> DataFrame:
    """One row per line item, read as a payment of the credit that is its order."""
    return spark.sql(
        """
        SELECT CASE WHEN l_suppkey % 97 = 0 THEN NULL ELSE l_orderkey END AS credit_id,
               CASE WHEN o_custkey % 89 = 0 THEN NULL ELSE o_custkey END AS client_id,
               o_orderdate + make_dt_interval(0, CAST(o_orderkey % 24 AS INT)) AS disbursed_at,
               CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE l_linenumber END AS installment_no,
               CASE WHEN l_partkey % 17 = 0 THEN NULL
                    ELSE pmod(datediff(l_shipdate, o_orderdate), 120) - 45 END AS days_late,
               CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE
                 CAST(date_add(
                        add_months(trunc(CAST(o_orderdate AS DATE), 'MM'),
                                   CASE WHEN day(o_orderdate) <= 20 THEN 1 ELSE 2 END
                                     + l_linenumber - 1),
                        9 - CASE WHEN l_partkey % 331 = 0 THEN 400 ELSE 0 END)
                      AS TIMESTAMP_NTZ) END AS due_at,
               CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_shipdate END AS paid_at,
               CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS amount_paid
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        """,
        lineitem=given_table(spark, folder, "lineitem"),
        orders=given_table(spark, folder, "orders"),
    )


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        """
        SELECT p_partkey AS id, p_type AS vehicle_type, p_size AS passenger_capacity,
               CAST(1 + p_partkey % 4 AS INT) AS engines, CAST(1 + p_partkey % 7 AS INT) AS crew,
               CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 't'
                    ELSE 'f' END AS check_complete,
               CASE WHEN p_partkey % 5 < 2 THEN 't' ELSE 'f' END AS clearance_complete,
               CASE WHEN p_partkey % 23 = 0 THEN NULL
                    ELSE concat('$', format_number(p_retailprice * 10, 2)) END AS price,
               CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 12 END AS operator_id
        FROM {part}
        """,
        part=given_table(spark, folder, "part"),
    )


def operators(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        """
        SELECT s_suppkey AS id,
               CASE WHEN s_suppkey % 11 = 7 THEN NULL
                    ELSE concat(CAST((s_suppkey * 37) % 101 AS STRING), '%') END AS rating,
               CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_suppkey % 2 = 0 THEN 't'
                    ELSE 'f' END AS approved
        FROM {supplier}
        """,
        supplier=given_table(spark, folder, "supplier"),
    )


def ratings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.sql(
        """
        SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS review_id,
               CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_partkey END AS vehicle_id,
               CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE l_quantity * 2 END AS review_score
        FROM {lineitem}
        """,
        lineitem=given_table(spark, folder, "lineitem"),
    )


def confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Two 0/1 columns of the labels table, as actual and predicted class."""
    return given_table(spark, folder, "labels").selectExpr("quality AS actual", "toxic AS predicted")
