"""Layouts of the input files, and the English names the operators use.

Fixed values: the keys of the name tables are the headers found in the raw files.
"""

from pyspark.sql import types as T

INSTALLMENT_NAMES = {
    "credito_id_anon": "credit_id",
    "cliente_id_anon": "client_id",
    "fecha_desembolso": "disbursed_at",
    "numero_cuota": "installment_no",
    "dias_retraso": "days_late",
    "fecha_t_pago": "due_at",
    "fecha_pago": "paid_at",
    "valor_pagado": "amount_paid",
}

CREDIT_NAMES = {
    "credito_id_anon": "credit_id",
    "max_mora": "max_days_late",
    "target": "label",
}

VEHICLE_NAMES = {
    "id": "id",
    "company_id": "operator_id",
    "shuttle_type": "vehicle_type",
    "engines": "engines",
    "passenger_capacity": "passenger_capacity",
    "crew": "crew",
    "d_check_complete": "check_complete",
    "moon_clearance_complete": "clearance_complete",
    "price": "price",
}

OPERATOR_NAMES = {"id": "id", "company_rating": "rating", "iata_approved": "approved"}

RATING_NAMES = {
    "review_id": "review_id",
    "shuttle_id": "vehicle_id",
    "review_scores_rating": "review_score",
}

INSTALLMENTS = T.StructType(
    [
        T.StructField("credit_id", T.StringType()),
        T.StructField("client_id", T.StringType()),
        T.StructField("disbursed_at", T.TimestampNTZType()),
        T.StructField("installment_no", T.IntegerType()),
        T.StructField("days_late", T.IntegerType()),
        T.StructField("due_at", T.TimestampNTZType()),
        T.StructField("paid_at", T.TimestampNTZType()),
        T.StructField("amount_paid", T.DoubleType()),
    ]
)

CREDITS = T.StructType(
    [
        T.StructField("credit_id", T.StringType()),
        T.StructField("max_days_late", T.IntegerType()),
        T.StructField("label", T.IntegerType()),
    ]
)

VEHICLES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("operator_id", T.LongType()),
        T.StructField("vehicle_type", T.StringType()),
        T.StructField("engines", T.IntegerType()),
        T.StructField("passenger_capacity", T.IntegerType()),
        T.StructField("crew", T.IntegerType()),
        T.StructField("check_complete", T.StringType()),
        T.StructField("clearance_complete", T.StringType()),
        T.StructField("price", T.StringType()),
    ]
)

OPERATORS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("rating", T.StringType()),
        T.StructField("approved", T.StringType()),
    ]
)

RATINGS = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("vehicle_id", T.LongType()),
        T.StructField("review_score", T.DoubleType()),
    ]
)

# Cell texts that mean "missing" in the raw files.
MISSING_TEXTS = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)
