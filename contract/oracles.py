"""Independent SQL for the registered queries, written for DuckDB over the given tables."""

INSTALLMENTS = """
installments AS (
  SELECT CASE WHEN l_suppkey % 97 = 0 THEN NULL ELSE l_orderkey END AS credit_id,
         CASE WHEN o_custkey % 89 = 0 THEN NULL ELSE o_custkey END AS client_id,
         o_orderdate + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS disbursed_at,
         CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE l_linenumber END AS installment_no,
         CAST(CASE WHEN l_partkey % 17 = 0 THEN NULL
              ELSE ((date_diff('day', o_orderdate, l_shipdate) % 120 + 120) % 120) - 45
              END AS INTEGER) AS days_late,
         CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE
           date_trunc('month', o_orderdate)
           + to_months(CAST(CASE WHEN day(o_orderdate) <= 20 THEN 1 ELSE 2 END
                            + l_linenumber - 1 AS INTEGER))
           + to_days(CAST(9 - CASE WHEN l_partkey % 331 = 0 THEN 400 ELSE 0 END AS INTEGER))
           END AS due_at,
         CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_shipdate END AS paid_at,
         CASE WHEN l_suppkey % 19 = 0 THEN NULL ELSE l_extendedprice END AS amount_paid
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


def _first(column: str) -> str:
    return (
        f"first({column} ORDER BY installment_no NULLS LAST, due_at NULLS LAST, {column})"
        f" FILTER (WHERE {column} IS NOT NULL)"
    )


def _label(days: str) -> str:
    return f"CAST(CASE WHEN {days} <= 30 THEN 1 WHEN {days} > 60 THEN 0 END AS INTEGER)"


def _days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS INTEGER)"


LABELS = f"""{INSTALLMENTS},
labels_ AS (
  SELECT credit_id, max(days_late) AS max_days_late, {_label("max(days_late)")} AS label
  FROM installments WHERE credit_id IS NOT NULL GROUP BY credit_id
)"""

TIMING = f"""{LABELS},
firsts AS (
  SELECT credit_id, {_first("disbursed_at")} AS disbursed_at, {_first("due_at")} AS due_at,
         {_first("days_late")} AS first_days_late
  FROM installments WHERE credit_id IS NOT NULL GROUP BY credit_id
),
timing AS (
  SELECT credit_id, disbursed_at, due_at, first_days_late,
         CAST(day(disbursed_at) AS INTEGER) AS disbursement_day,
         CAST(date_trunc('month', disbursed_at) AS DATE) AS disbursement_month,
         CAST(date_trunc('month', due_at) AS DATE) AS due_month,
         CAST(date_diff('month', disbursed_at, due_at) AS INTEGER) AS month_gap,
         {_days("due_at", "disbursed_at")} AS days_to_due
  FROM firsts
)"""

VALID = f"""{TIMING},
gap_limit AS (SELECT quantile_cont(days_to_due, 0.99) AS gap_limit FROM timing),
valid AS (SELECT * FROM timing, gap_limit WHERE days_to_due BETWEEN 0 AND gap_limit)"""

MATURITY = f"""{TIMING},
cutoff AS (SELECT max(disbursed_at) AS cutoff FROM installments),
observed AS (
  SELECT t.credit_id, l.max_days_late, l.label, t.days_to_due,
         {_days("cutoff", "t.disbursed_at")} AS days_observed,
         CAST(t.days_to_due + 60 AS INTEGER) AS days_needed
  FROM timing t JOIN labels_ l USING (credit_id), cutoff
),
matured AS (
  SELECT *, coalesce(days_observed >= days_needed, false) AS mature,
         CASE WHEN coalesce(days_observed >= days_needed, false) THEN label END AS clean_label
  FROM observed
)"""

WORST = f"""{LABELS},
worst AS (
  SELECT i.*, l.label FROM installments i JOIN labels_ l USING (credit_id)
  WHERE i.days_late = l.max_days_late AND l.label IS NOT NULL
),
rates AS (
  SELECT installment_no, count(credit_id) AS n_credits,
         count(*) FILTER (WHERE label = 0) AS n_default,
         round(100.0 * count(*) FILTER (WHERE label = 0) / nullif(count(credit_id), 0), 6)
           AS default_rate
  FROM worst WHERE installment_no IS NOT NULL GROUP BY installment_no
)"""

VEHICLES = """
vehicles AS (
  SELECT p_partkey AS id, p_type AS vehicle_type, p_size AS passenger_capacity,
         CAST(1 + p_partkey % 4 AS INTEGER) AS engines,
         CAST(1 + p_partkey % 7 AS INTEGER) AS crew,
         CASE WHEN p_partkey % 19 = 0 THEN NULL WHEN p_partkey % 3 = 0 THEN 't'
              ELSE 'f' END AS check_complete,
         CASE WHEN p_partkey % 5 < 2 THEN 't' ELSE 'f' END AS clearance_complete,
         CASE WHEN p_partkey % 23 = 0 THEN NULL
              ELSE concat('$', format('{:,.2f}', p_retailprice * 10)) END AS price,
         CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_partkey % 12 END AS operator_id
  FROM part
)"""

CLEAN_VEHICLES = f"""{VEHICLES},
clean_vehicles AS (
  SELECT id, vehicle_type, passenger_capacity, engines, crew,
         coalesce(check_complete = 't', false) AS check_complete,
         coalesce(clearance_complete = 't', false) AS clearance_complete,
         CAST(replace(replace(price, '$', ''), ',', '') AS DOUBLE) AS price, operator_id
  FROM vehicles
)"""

OPERATORS = """
operators AS (
  SELECT s_suppkey AS id,
         CASE WHEN s_suppkey % 11 = 7 THEN NULL
              ELSE concat(CAST((s_suppkey * 37) % 101 AS VARCHAR), '%') END AS rating,
         CASE WHEN s_suppkey % 7 = 3 THEN NULL WHEN s_suppkey % 2 = 0 THEN 't'
              ELSE 'f' END AS approved
  FROM supplier
)"""

CLEAN_OPERATORS = f"""{OPERATORS},
clean_operators AS (
  SELECT id, CAST(replace(rating, '%', '') AS DOUBLE) / 100 AS rating,
         coalesce(approved = 't', false) AS approved
  FROM operators
)"""

MODEL_TABLE = f"""{CLEAN_VEHICLES},{CLEAN_OPERATORS},
ratings AS (
  SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS review_id,
         CASE WHEN l_orderkey % 31 = 0 THEN NULL ELSE l_partkey END AS vehicle_id,
         CASE WHEN l_orderkey % 29 = 0 THEN NULL ELSE l_quantity * 2 END AS review_score
  FROM lineitem
),
model_table AS (
  SELECT v.vehicle_type, v.passenger_capacity, v.engines, v.crew, v.check_complete,
         v.clearance_complete, v.price, v.operator_id, r.review_id, r.vehicle_id,
         r.review_score, o.id, o.rating, o.approved
  FROM clean_vehicles v JOIN ratings r ON v.id = r.vehicle_id
       JOIN clean_operators o ON v.operator_id = o.id
  WHERE v.vehicle_type IS NOT NULL AND v.passenger_capacity IS NOT NULL
    AND v.price IS NOT NULL AND r.review_score IS NOT NULL AND o.rating IS NOT NULL
)"""

DIVIDED = f"""{MODEL_TABLE},
divided AS (
  SELECT *, row_number() OVER (ORDER BY md5(review_id || '|3'))
            <= ceil(CAST(0.2 AS DOUBLE) * count(*) OVER ()) AS is_test
  FROM model_table
)"""

FEATURES = (
    "engines",
    "passenger_capacity",
    "crew",
    "check_complete",
    "clearance_complete",
    "approved",
    "rating",
    "review_score",
)


def _least_squares() -> str:
    """Least squares by orthogonalising one feature after the other, in plain aggregates.

    Step i projects feature i out of the later features and of the target; the weights then
    follow from the last feature back to the first.
    """
    n = len(FEATURES)
    terms = range(1, n + 1)
    columns = ", ".join(f"CAST({f} AS DOUBLE) AS x{j}" for j, f in zip(terms, FEATURES))
    centred = ", ".join(f"x{j} - avg(x{j}) OVER () AS x{j}" for j in terms)
    parts = [
        f"raw AS (SELECT {columns}, price AS y FROM divided WHERE NOT is_test)",
        f"s0 AS (SELECT {centred}, y - avg(y) OVER () AS y FROM raw)",
    ]
    for i in terms:
        later = [j for j in terms if j > i]
        slopes = [f"sum(x{j} * x{i}) / sum(x{i} * x{i}) AS r{i}_{j}" for j in later]
        slopes.append(f"sum(y * x{i}) / sum(x{i} * x{i}) AS g{i}")
        parts.append(f"r{i} AS (SELECT {', '.join(slopes)} FROM s{i - 1})")
        rest = [f"x{j} - r{i}_{j} * x{i} AS x{j}" for j in later] + [f"y - g{i} * x{i} AS y"]
        parts.append(f"s{i} AS (SELECT {', '.join(rest)} FROM s{i - 1}, r{i})")
    back = []
    for j in reversed(terms):
        known = "".join(f" - r{j}_{k} * b{k}" for k in terms if k > j)
        back.append(f"g{j}{known} AS b{j}")
    parts.append(f"slopes AS (SELECT {', '.join(back)} FROM {', '.join(f'r{i}' for i in terms)})")
    means = ", ".join(f"avg(x{j}) AS m{j}" for j in terms)
    parts.append(f"means AS (SELECT {means}, avg(y) AS my FROM raw)")
    intercept = "my" + "".join(f" - b{j} * m{j}" for j in terms)
    parts.append(f"weights AS (SELECT slopes.*, {intercept} AS b0 FROM slopes, means)")
    predicted = "b0" + "".join(
        f" + b{j} * CAST({f} AS DOUBLE)" for j, f in zip(terms, FEATURES)
    )
    parts.append(
        f"predicted AS (SELECT review_id, price, {predicted} AS prediction"
        " FROM divided, weights WHERE is_test)"
    )
    return f"{DIVIDED},\n" + ",\n".join(parts)


FITTED = _least_squares()

# The shortest weights of w1 + 2 d = b1, w2 + s = b2 and w3 + s = b3: a fifth of b1 and twice that for
# the doubled feature; a third of b2 + b3 for the sum, the rest for its two parts.
_MIN_NORM = """shared AS (SELECT *, b1 / 5 AS fifth, (b2 + b3) / 3 AS third FROM weights)
SELECT 'intercept' AS term, round(b0, 3) AS weight FROM shared
UNION ALL SELECT 'doubled', round(2 * fifth, 3) FROM shared
UNION ALL SELECT 'summed', round(third, 3) FROM shared""" + "".join(
    f" UNION ALL SELECT '{f}', round({ {1: 'fifth', 2: 'b2 - third', 3: 'b3 - third'}.get(j, f'b{j}')}, 3) FROM shared"
    for j, f in enumerate(FEATURES, start=1)
)

_SCORES = f"""WITH {FITTED},
centre AS (SELECT avg(price) AS m FROM predicted)
SELECT count(*) AS n,
       round(1 - sum((price - prediction) ** 2) / nullif(sum((price - m) ** 2), 0), 4) AS r2,
       round(avg(abs(price - prediction)), 4) AS mae,
       round(max(abs(price - prediction)), 4) AS max_error
FROM predicted, centre"""

_MATURITY_REPORT = f"""WITH {MATURITY},
counts AS (
  SELECT count(*) AS n_credits, count(*) FILTER (WHERE mature) AS n_mature,
         count(*) FILTER (WHERE NOT mature) AS n_immature, count(label) AS n_labelled,
         count(clean_label) AS n_labelled_mature,
         count(*) FILTER (WHERE label = 0) AS n_default,
         count(*) FILTER (WHERE clean_label = 0) AS n_default_mature
  FROM matured
)
SELECT *, round(100.0 * n_mature / nullif(n_credits, 0), 6) AS pct_mature,
       round(100.0 * n_immature / nullif(n_credits, 0), 6) AS pct_immature,
       round(100.0 * n_default / nullif(n_labelled, 0), 6) AS default_rate,
       round(100.0 * n_default_mature / nullif(n_labelled_mature, 0), 6) AS default_rate_mature
FROM counts"""


def _describe(table: str, column: str, points: list[float], wrap: str) -> str:
    """Summary statistics of one column; ``wrap`` is the rounding, with ``{}`` as its place."""
    names = ["p" + f"{100 * p:g}" for p in points]
    measures = {"mean": f"avg({column})", "std": f"stddev_samp({column})", "min": f"min({column})"}
    measures |= {n: f"quantile_cont({column}, {p})" for n, p in zip(names, points)}
    measures["max"] = f"max({column})"
    listed = ", ".join(
        f"{wrap.format(f'CAST({m} AS DOUBLE)')} AS {name}" for name, m in measures.items()
    )
    return f"SELECT '{column}' AS \"column\", count({column}) AS count, {listed} FROM {table}"


_QUARTILES = [0.25, 0.5, 0.75]
_TAILS = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]

_COLUMNS = {
    "credit_id": "bigint",
    "client_id": "bigint",
    "disbursed_at": "timestamp_ntz",
    "installment_no": "int",
    "days_late": "int",
    "due_at": "timestamp_ntz",
    "paid_at": "timestamp_ntz",
    "amount_paid": "double",
}

_VEHICLE_ROWS = "SELECT id, vehicle_type, round(price, 6) AS price FROM clean_vehicles"

_MODEL_ROWS = f"""WITH {MODEL_TABLE}
SELECT vehicle_type, passenger_capacity, engines, crew, check_complete, clearance_complete,
       round(price, 6) AS price, operator_id, review_id, vehicle_id,
       round(review_score, 6) AS review_score, id, round(rating, 6) AS rating, approved
FROM model_table"""

_MEANS = """SELECT vehicle_type, round(avg(id), 6) AS id,
       round(avg(passenger_capacity), 6) AS passenger_capacity, round(avg(engines), 6) AS engines,
       round(avg(crew), 6) AS crew, round(avg(CAST(check_complete AS INTEGER)), 6) AS check_complete,
       round(avg(CAST(clearance_complete AS INTEGER)), 6) AS clearance_complete,
       round(avg(price), 6) AS price, round(avg(operator_id), 6) AS operator_id
FROM clean_vehicles GROUP BY vehicle_type"""

ORACLES: dict[str, str] = {
    "credit_labels": f"WITH {LABELS} SELECT * FROM labels_",
    "class_distribution": f"""WITH {LABELS}
SELECT count(*) AS n_credits, count(*) FILTER (WHERE label = 1) AS n_paid,
       count(*) FILTER (WHERE label = 0) AS n_default,
       count(*) FILTER (WHERE label IS NULL) AS n_grey,
       round(100.0 * count(*) FILTER (WHERE label = 1) / nullif(count(*), 0), 6) AS pct_paid,
       round(100.0 * count(*) FILTER (WHERE label = 0) / nullif(count(*), 0), 6) AS pct_default,
       round(100.0 * count(*) FILTER (WHERE label IS NULL) / nullif(count(*), 0), 6) AS pct_grey
FROM labels_""",
    "first_values": f"WITH {INSTALLMENTS} SELECT credit_id, "
    + ", ".join(f"{_first(c)} AS {c}" for c in _COLUMNS if c != "credit_id")
    + " FROM installments WHERE credit_id IS NOT NULL GROUP BY credit_id",
    "first_due": f"WITH {TIMING} SELECT * FROM timing",
    "timing_summary": f"WITH {TIMING}, both_ AS (SELECT * FROM timing JOIN labels_ USING (credit_id)) "
    + " UNION ALL ".join(
        _describe("both_", c, _QUARTILES, "round({}, 6)")
        for c in ("disbursement_day", "month_gap", "first_days_late", "label")
    ),
    "gap_summary": f"WITH {TIMING} SELECT d.*, n.n_negative FROM ("
    + _describe("timing", "days_to_due", _TAILS, "round_even({}, 0)")
    + ") d, (SELECT count(*) FILTER (WHERE days_to_due < 0) AS n_negative FROM timing) n",
    "negative_gaps": f"""WITH {TIMING}
SELECT credit_id, disbursed_at, due_at, days_to_due FROM timing WHERE days_to_due < 0""",
    "valid_range": f"""WITH {VALID}
SELECT credit_id, days_to_due, round(gap_limit, 6) AS gap_limit FROM valid""",
    "valid_range_size": f"""WITH {VALID}
SELECT (SELECT count(*) FROM timing) AS n_credits, (SELECT count(*) FROM valid) AS n_valid,
       (SELECT round(gap_limit, 6) FROM gap_limit) AS gap_limit""",
    "gap_histogram": f"""WITH {VALID},
limits AS (
  SELECT CAST(min(days_to_due) AS DOUBLE) AS low, CAST(max(days_to_due) AS DOUBLE) AS high FROM valid
),
bins AS (
  SELECT CAST(i AS INTEGER) AS bin, low + i * ((high - low) / 60) AS left_edge,
         CASE WHEN i = 59 THEN high ELSE low + (i + 1) * ((high - low) / 60) END AS right_edge
  FROM limits, generate_series(0, 59) AS g(i)
)
SELECT bin, round(left_edge, 6) AS left_edge, round(right_edge, 6) AS right_edge,
       count(days_to_due) AS n
FROM bins LEFT JOIN valid ON days_to_due >= left_edge
     AND (days_to_due < right_edge OR (bin = 59 AND days_to_due <= right_edge))
GROUP BY bin, left_edge, right_edge""",
    "gap_by_day": f"""WITH {VALID}
SELECT disbursement_day, round(quantile_cont(days_to_due, 0.5), 6) AS median,
       round(quantile_cont(days_to_due, 0.25), 6) AS q25,
       round(quantile_cont(days_to_due, 0.75), 6) AS q75, count(days_to_due) AS n
FROM valid GROUP BY disbursement_day""",
    "maturity": f"WITH {MATURITY} SELECT * FROM matured",
    "maturity_report": _MATURITY_REPORT,
    "worst_installments": f"WITH {WORST} SELECT * FROM worst",
    "worst_installments_in_one_scan": f"WITH {WORST} SELECT * FROM worst",
    "default_by_month_pair": f"""WITH {TIMING}, both_ AS (SELECT * FROM timing JOIN labels_ USING (credit_id)),
counts AS (
  SELECT disbursement_month, due_month, CAST(grouping(disbursement_month, due_month) AS INTEGER) AS level,
         count(*) AS n_credits, count(label) AS n_labelled, count(*) FILTER (WHERE label = 0) AS n_default
  FROM both_
  GROUP BY GROUPING SETS ((disbursement_month, due_month), (disbursement_month), (due_month), ())
)
SELECT *, round(100.0 * n_default / nullif(n_labelled, 0), 6) AS default_rate FROM counts""",
    "default_by_installment": f"WITH {WORST} SELECT * FROM rates",
    "default_by_installment_supported": f"WITH {WORST} SELECT * FROM rates WHERE n_credits >= 50",
    "missing_share": f"WITH {INSTALLMENTS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\","
        f" round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) AS share FROM installments"
        for c in _COLUMNS
    ),
    "schema_profile": f"WITH {INSTALLMENTS} "
    + " UNION ALL ".join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS \"column\", '{t}' AS type,"
        f" count({c}) AS non_missing FROM installments"
        for i, (c, t) in enumerate(_COLUMNS.items())
    ),
    "distinct_counts": f"WITH {INSTALLMENTS} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM installments"
        for c in ("credit_id", "client_id")
    ),
    "table_shape": f"""WITH {INSTALLMENTS}
SELECT count(*) AS n_rows, CAST(8 AS BIGINT) AS n_columns FROM installments""",
    "preview": f"""WITH {INSTALLMENTS}
SELECT * FROM installments
ORDER BY credit_id NULLS FIRST, client_id NULLS FIRST, disbursed_at NULLS FIRST,
         installment_no NULLS FIRST, days_late NULLS FIRST, due_at NULLS FIRST,
         paid_at NULLS FIRST, amount_paid NULLS FIRST LIMIT 3""",
    "amount_quantiles": f"WITH {INSTALLMENTS} SELECT installment_no, "
    + ", ".join(
        f"round(quantile_cont(amount_paid, {p}), 6) AS p{100 * p:g}"
        for p in (0.01, 0.25, 0.5, 0.75, 0.99)
    )
    + " FROM installments WHERE installment_no IS NOT NULL AND amount_paid IS NOT NULL"
    " GROUP BY installment_no",
    "amount_summary": f"WITH {INSTALLMENTS} "
    + " UNION ALL ".join(
        _describe("installments", c, _QUARTILES, "round({}, 4)")
        for c in ("amount_paid", "days_late")
    ),
    "clean_operators": f"""WITH {CLEAN_OPERATORS}
SELECT id, round(rating, 6) AS rating, approved FROM clean_operators""",
    "clean_vehicles": f"""WITH {CLEAN_VEHICLES}
SELECT id, vehicle_type, passenger_capacity, engines, crew, check_complete, clearance_complete,
       round(price, 6) AS price, operator_id FROM clean_vehicles""",
    "parsed_dates": "SELECT o_orderkey, o_orderdate AS ordered_at FROM orders",
    "model_table": _MODEL_ROWS,
    "mean_by_type": f"WITH {CLEAN_VEHICLES} {_MEANS}",
    "capacity_by_type": f"""WITH {CLEAN_VEHICLES}
SELECT vehicle_type, round(avg(passenger_capacity), 6) AS passenger_capacity
FROM clean_vehicles GROUP BY vehicle_type""",
    "crosstab": """SELECT quality AS actual, count(*) FILTER (WHERE toxic = 0) AS predicted_0,
       count(*) FILTER (WHERE toxic = 1) AS predicted_1
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY quality""",
    "crosstab_text": "SELECT source, "
    + ", ".join(f"count(*) FILTER (WHERE lang = '{x}') AS lang_{x}" for x in ("de", "en", "es", "fr"))
    + " FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY source",
    "split": f"""WITH {MODEL_TABLE}
SELECT review_id, substr(md5(review_id || '|3'), 1, 8) < '33333333' AS is_test FROM model_table""",
    "split_exact": f"WITH {DIVIDED} SELECT review_id, is_test FROM divided",
    "ols_fit": f"WITH {FITTED} SELECT 'intercept' AS term, round(b0, 3) AS weight FROM weights"
    + "".join(
        f" UNION ALL SELECT '{f}', round(b{j}, 3) FROM weights"
        for j, f in enumerate(FEATURES, start=1)
    ),
    "ols_min_norm": f"WITH {FITTED}, {_MIN_NORM}",
    "ols_predictions": f"""WITH {FITTED}
SELECT review_id, round(price, 3) AS price, round(prediction, 3) AS prediction FROM predicted""",
    "ols_scores": _SCORES,
    "model_round_trip": _SCORES,
    "csv_round_trip": f"WITH {VEHICLES} SELECT * FROM vehicles",
    "installments_csv_round_trip": _MATURITY_REPORT,
    "csv_text_round_trip": "SELECT doc_id, text, lang, source FROM documents",
    "raw_tables_model_table": _MODEL_ROWS,
    "credits_csv_round_trip": f"WITH {LABELS} SELECT * FROM labels_",
    "model_table_csv_round_trip": _MODEL_ROWS,
    "delimited_round_trip": f"WITH {OPERATORS} SELECT * FROM operators",
    "parquet_round_trip": _MODEL_ROWS,
    "table_round_trip": f"WITH {CLEAN_VEHICLES} {_VEHICLE_ROWS} UNION ALL {_VEHICLE_ROWS}",
    "versioned_model_table": _MODEL_ROWS,
    "report_round_trip": _MATURITY_REPORT,
}
