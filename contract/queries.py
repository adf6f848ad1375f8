"""Registered queries: each takes (spark, folder of the given tables) and returns a frame."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duefold.functions import parse_timestamp
from duefold.operators import credits as C
from duefold.operators import features as FE
from duefold.operators import maturity as M
from duefold.operators import profile as P
from duefold.operators import quantiles as Q
from duefold.operators import regression as R
from duefold.operators import summary as S
from duefold.operators import tables as TA
from duefold.operators import timing as TI
from duefold.operators import worst as W
from duefold.plans.price_model import prepare, train_and_predict
from duefold.session import new_path, written
from duefold.sources import readers, schemas, stand_ins, writers

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the doubles: the last digits differ between engines."""
    names = [f.name for f in df.schema if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.round(F.col(f"`{c}`"), digits) for c in names})


def _credits(spark, folder):
    return C.credit_table(stand_ins.installments(spark, folder))


def _timing(spark, folder):
    return TI.first_due(_credits(spark, folder))


def credit_labels(spark, folder):
    return C.label_credits(stand_ins.installments(spark, folder))


def class_distribution(spark, folder):
    return rounded(C.class_distribution(_credits(spark, folder)))


def first_values(spark, folder):
    return C.first_values(
        stand_ins.installments(spark, folder), "credit_id", ["installment_no", "due_at"]
    )


def first_due(spark, folder):
    return _timing(spark, folder).select(
        "credit_id",
        "disbursed_at",
        "due_at",
        "first_days_late",
        "disbursement_day",
        "disbursement_month",
        "due_month",
        "month_gap",
        "days_to_due",
    )


def timing_summary(spark, folder):
    return rounded(TI.timing_summary(_timing(spark, folder)))


def gap_summary(spark, folder):
    return TI.gap_summary(_timing(spark, folder))


def negative_gaps(spark, folder):
    return TI.negative_gaps(_timing(spark, folder)).select(
        "credit_id", "disbursed_at", "due_at", "days_to_due"
    )


def valid_range(spark, folder):
    return rounded(
        TI.valid_range(_timing(spark, folder)).select("credit_id", "days_to_due", "gap_limit")
    )


def valid_range_size(spark, folder):
    return rounded(TI.valid_range_size(_timing(spark, folder)))


def gap_histogram(spark, folder):
    return rounded(TI.gap_histogram(_timing(spark, folder)))


def gap_by_day(spark, folder):
    return rounded(TI.gap_by_disbursement_day(_timing(spark, folder)))


def maturity(spark, folder):
    payments = stand_ins.installments(spark, folder)
    return M.maturity(C.credit_table(payments), M.cutoff_date(payments)).select(
        "credit_id",
        "max_days_late",
        "label",
        "days_to_due",
        "days_observed",
        "days_needed",
        "mature",
        "clean_label",
    )


def maturity_report(spark, folder):
    payments = stand_ins.installments(spark, folder)
    matured = M.maturity(C.credit_table(payments), M.cutoff_date(payments))
    return rounded(M.maturity_report(matured))


def worst_installments(spark, folder):
    return W.worst_installments(stand_ins.installments(spark, folder))


def worst_installments_in_one_scan(spark, folder):
    return W.worst_installments(stand_ins.installments(spark, folder), in_one_scan=True)


def default_by_month_pair(spark, folder):
    return rounded(TI.default_by_month_pair(_timing(spark, folder)))


def default_by_installment(spark, folder):
    return rounded(W.default_by_worst_installment(stand_ins.installments(spark, folder)))


def default_by_installment_supported(spark, folder):
    return rounded(
        W.default_by_worst_installment(stand_ins.installments(spark, folder), min_rows=50)
    )


def missing_share(spark, folder):
    return rounded(P.missing_share(stand_ins.installments(spark, folder)))


def schema_profile(spark, folder):
    return P.schema_profile(stand_ins.installments(spark, folder))


def distinct_counts(spark, folder):
    return P.distinct_counts(stand_ins.installments(spark, folder), ["credit_id", "client_id"])


def table_shape(spark, folder):
    return P.table_shape(stand_ins.installments(spark, folder))


def preview(spark, folder):
    columns = [
        "credit_id",
        "client_id",
        "disbursed_at",
        "installment_no",
        "days_late",
        "due_at",
        "paid_at",
        "amount_paid",
    ]
    return P.preview(stand_ins.installments(spark, folder), columns, columns)


def amount_quantiles(spark, folder):
    amounts = stand_ins.installments(spark, folder).select("installment_no", "amount_paid")
    found = Q.exact_quantiles(
        written(amounts, "amounts"),
        "amount_paid",
        [0.01, 0.25, 0.5, 0.75, 0.99],
        ["installment_no"],
    )
    return rounded(
        found.select(
            "installment_no",
            *[F.col("quantiles")[i].alias(c) for i, c in enumerate(("p1", "p25", "p50", "p75", "p99"))],
        )
    )


def amount_summary(spark, folder):
    columns = ["amount_paid", "days_late"]
    amounts = written(stand_ins.installments(spark, folder).select(*columns), "amounts")
    return rounded(S.summary(amounts, columns), 4)


def clean_operators(spark, folder):
    return rounded(FE.clean_operators(stand_ins.operators(spark, folder)))


def clean_vehicles(spark, folder):
    return rounded(FE.clean_vehicles(stand_ins.vehicles(spark, folder)))


def parsed_dates(spark, folder):
    orders = stand_ins.given_table(spark, folder, "orders")
    text = F.replace(F.col("o_orderdate").cast("string"), F.lit("-"), F.lit("/"))
    return orders.select(
        F.col("o_orderkey"), parse_timestamp(text, "yyyy/MM/dd HH:mm:ss").alias("ordered_at")
    )


def _model_table(spark, folder):
    return prepare(
        stand_ins.vehicles(spark, folder),
        stand_ins.ratings(spark, folder),
        stand_ins.operators(spark, folder),
    )


def model_table(spark, folder):
    return rounded(_model_table(spark, folder))


def mean_by_type(spark, folder):
    vehicles = FE.clean_vehicles(stand_ins.vehicles(spark, folder))
    return rounded(TA.mean_by(vehicles, "vehicle_type"))


def capacity_by_type(spark, folder):
    vehicles = FE.clean_vehicles(stand_ins.vehicles(spark, folder))
    return rounded(
        TA.mean_by(vehicles, "vehicle_type").select("vehicle_type", "passenger_capacity")
    )


def crosstab(spark, folder):
    return TA.crosstab(stand_ins.confusion(spark, folder), "actual", "predicted", [0, 1])


def crosstab_text(spark, folder):
    """Languages by source, the languages looked up."""
    return TA.crosstab(stand_ins.given_table(spark, folder, "documents"), "source", "lang")


KEYS = ["review_id"]


def split(spark, folder):
    keys = _model_table(spark, folder).select(*KEYS)
    return R.split(keys, KEYS, exact=False)


def split_exact(spark, folder):
    keys = written(_model_table(spark, folder).select(*KEYS), "model-keys")
    return R.split(keys, KEYS)


def _fitted(spark, folder):
    options = R.ModelOptions()
    table = _model_table(spark, folder).select(*KEYS, *options.features, options.target)
    return train_and_predict(written(table, "model-table"), KEYS, options)


def ols_fit(spark, folder):
    model, _ = _fitted(spark, folder)
    return rounded(R.coefficients(model, R.ModelOptions().features, spark), 3)


def ols_min_norm(spark, folder):
    """With one feature doubled and one the sum of two, so that many weights fit equally well."""
    options = R.ModelOptions()
    first, second, third = options.features[:3]
    table = _model_table(spark, folder).select(*KEYS, *options.features, options.target)
    table = written(
        table.withColumn("doubled", 2 * F.col(first)).withColumn("summed", F.col(second) + F.col(third)),
        "model-table",
    )
    wide = R.ModelOptions(features=(*options.features, "doubled", "summed"))
    cut = R.split_point(table, KEYS, wide.test_size, wide.seed).first().cut
    train = R.split(table, KEYS, seed=wide.seed, cut=cut or "").where("NOT is_test")
    return rounded(R.linear_weights(R.fit_min_norm(train, wide), spark), 3)


def ols_predictions(spark, folder):
    _, predicted = _fitted(spark, folder)
    return rounded(predicted.select("review_id", "price", "prediction"), 3)


def ols_scores(spark, folder):
    _, predicted = _fitted(spark, folder)
    return rounded(R.score(predicted), 4)


def model_round_trip(spark, folder):
    """The scores of a model that was saved and loaded again."""
    model, predicted = _fitted(spark, folder)
    path = new_path(spark, "price-model")
    writers.save_model(model, path)
    loaded = writers.load_model(spark, path)
    return rounded(R.score(R.predict(loaded, predicted.drop("prediction"))), 4)


def csv_round_trip(spark, folder):
    path = new_path(spark, "vehicles-csv")
    writers.write_csv(stand_ins.vehicles(spark, folder), path)
    return readers.read_typed_csv(spark, path, schemas.VEHICLES)


def installments_csv_round_trip(spark, folder):
    """Written with the raw headers, read back under ours, then labelled."""
    payments = stand_ins.installments(spark, folder)
    raw_names = {ours: raw for raw, ours in schemas.INSTALLMENT_NAMES.items()}
    path = new_path(spark, "installments-csv")
    writers.write_csv(payments.withColumnsRenamed(raw_names), path)
    read = readers.read_typed_csv(
        spark, path, schemas.INSTALLMENTS, names=schemas.INSTALLMENT_NAMES
    )
    matured = M.maturity(C.credit_table(read), M.cutoff_date(read))
    return rounded(M.maturity_report(matured))


def csv_text_round_trip(spark, folder):
    """Texts with quotes, commas, backslashes and line breaks."""
    documents = stand_ins.given_table(spark, folder, "documents")
    path = new_path(spark, "documents-csv")
    writers.write_csv(documents, path)
    return readers.read_typed_csv(spark, path, documents.schema, multi_line=True)


def raw_tables_model_table(spark, folder):
    """The three tables written under their raw headers, read back and joined."""
    tables = {
        "vehicles": (schemas.VEHICLES, schemas.VEHICLE_NAMES),
        "ratings": (schemas.RATINGS, schemas.RATING_NAMES),
        "operators": (schemas.OPERATORS, schemas.OPERATOR_NAMES),
    }
    read = []
    for name, (schema, names) in tables.items():
        path = new_path(spark, f"raw-{name}")
        raw_names = {ours: raw for raw, ours in names.items()}
        writers.write_csv(getattr(stand_ins, name)(spark, folder).withColumnsRenamed(raw_names), path)
        read.append(readers.read_typed_csv(spark, path, schema, names))
    return rounded(prepare(*read))


def credits_csv_round_trip(spark, folder):
    """The credit-level table under its raw headers."""
    raw_names = {ours: raw for raw, ours in schemas.CREDIT_NAMES.items()}
    path = new_path(spark, "credits-csv")
    writers.write_csv(credit_labels(spark, folder).withColumnsRenamed(raw_names), path)
    return readers.read_typed_csv(
        spark, path, schemas.CREDITS, names=schemas.CREDIT_NAMES
    ).withColumn("credit_id", F.col("credit_id").cast("bigint"))


def model_table_csv_round_trip(spark, folder):
    table = _model_table(spark, folder)
    path = new_path(spark, "model-table-csv")
    writers.write_csv(table, path)
    return rounded(readers.read_typed_csv(spark, path, table.schema))


def delimited_round_trip(spark, folder):
    path = new_path(spark, "operators-delimited")
    writers.write_csv(stand_ins.operators(spark, folder), path, sep="|")
    return readers.read_delimited(spark, f"{path}/*.csv", sep="|").select(
        F.col("id").cast("bigint").alias("id"), "rating", "approved"
    )


def parquet_round_trip(spark, folder):
    path = new_path(spark, "model-table")
    writers.write_parquet(_model_table(spark, folder), path)
    return rounded(readers.read_parquet(spark, path))


def table_round_trip(spark, folder):
    """Created, appended to, then read back in part."""
    path = new_path(spark, "vehicle-table")
    name = "vehicles_" + path[-32:]
    cleaned = FE.clean_vehicles(stand_ins.vehicles(spark, folder))
    writers.write_table(cleaned, name, "fail", path)
    writers.write_table(cleaned, name, "append", path)
    found = rounded(readers.read_table(spark, name, ["vehicle_type", "price"], index=["id"]))
    spark.sql(f"DROP TABLE {name}")  # the name only: its files have a path of their own
    return found


def versioned_model_table(spark, folder):
    """Two versions of the model table, the older one read back."""
    table, path = _model_table(spark, folder), new_path(spark, "model-versions")
    older = writers.write_version(table, path)
    writers.write_version(table.where("price > 5000"), path)
    return rounded(writers.read_version(spark, path, older))


def report_round_trip(spark, folder):
    report = maturity_report(spark, folder)
    written = writers.write_report(report, new_path(spark, "maturity-report"))
    return spark.read.schema(report.schema).json(written)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        credit_labels,
        class_distribution,
        first_values,
        first_due,
        timing_summary,
        gap_summary,
        negative_gaps,
        valid_range,
        valid_range_size,
        gap_histogram,
        gap_by_day,
        maturity,
        maturity_report,
        worst_installments,
        worst_installments_in_one_scan,
        default_by_month_pair,
        default_by_installment,
        default_by_installment_supported,
        missing_share,
        schema_profile,
        distinct_counts,
        table_shape,
        preview,
        amount_quantiles,
        amount_summary,
        clean_operators,
        clean_vehicles,
        parsed_dates,
        model_table,
        mean_by_type,
        capacity_by_type,
        crosstab,
        crosstab_text,
        split,
        split_exact,
        ols_fit,
        ols_min_norm,
        ols_predictions,
        ols_scores,
        model_round_trip,
        csv_round_trip,
        installments_csv_round_trip,
        csv_text_round_trip,
        raw_tables_model_table,
        credits_csv_round_trip,
        model_table_csv_round_trip,
        delimited_round_trip,
        parquet_round_trip,
        table_round_trip,
        versioned_model_table,
        report_round_trip,
    )
}
