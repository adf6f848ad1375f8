"""Everything the credit analysis reports, from one table of installments."""

import datetime

from pyspark.sql import DataFrame

from duefold.functions.labels import DEFAULT_MIN, PAID_MAX
from duefold.operators import credits as C
from duefold.operators import maturity as M
from duefold.operators import profile as P
from duefold.operators import timing as T
from duefold.operators import worst as W


def credit_report(
    installments: DataFrame,
    credits: DataFrame | None = None,
    cutoff: DataFrame | datetime.datetime | None = None,
    paid_max: int = PAID_MAX,
    default_min: int = DEFAULT_MIN,
    min_rows: int = 50,
) -> dict[str, DataFrame]:
    """All reports by name, lazy.

    When several are wanted, write ``credit_table(installments)`` first and pass the table read
    back as ``credits``: then the detail is grouped once instead of once per report.
    """
    if credits is None:
        credits = C.credit_table(installments, paid_max, default_min)
    timing = T.first_due(credits)
    matured = M.maturity(
        credits, M.cutoff_date(installments) if cutoff is None else cutoff, default_min
    )
    by_installment = W.default_by_worst_installment(installments, paid_max, default_min)
    return {
        "shape": P.table_shape(installments),
        "missing_share": P.missing_share(installments),
        "schema": P.schema_profile(installments),
        "distinct_counts": P.distinct_counts(installments, ["credit_id", "client_id"]),
        "labels": credits.select("credit_id", "max_days_late", "label"),
        "class_distribution": C.class_distribution(credits),
        "first_due": timing,
        "timing_summary": T.timing_summary(timing),
        "gap_summary": T.gap_summary(timing),
        "valid_range_size": T.valid_range_size(timing),
        "gap_histogram": T.gap_histogram(timing),
        "gap_by_disbursement_day": T.gap_by_disbursement_day(timing),
        "maturity": matured,
        "maturity_report": M.maturity_report(matured),
        "default_by_installment": by_installment,
        "default_by_installment_supported": by_installment.where(f"n_credits >= {int(min_rows)}"),
    }
