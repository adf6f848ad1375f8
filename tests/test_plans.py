"""Plans and skew: what matters on a large cluster."""

import re

import pytest
from pyspark.sql import functions as F

from contract.queries import QUERIES
from duefold.operators import credits as C
from duefold.operators import maturity as M
from duefold.operators import quantiles as Q
from duefold.operators import regression as R
from duefold.operators import timing as T
from duefold.operators import worst as W
from duefold.plans.price_model import prepare
from duefold.session import new_path
from duefold.sources import readers, stand_ins, writers

from .conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df):
    df.collect()
    return plan(df).split("Initial Plan")[0]


@pytest.fixture(scope="module")
def stored(spark):
    """The stand-in as one table, as a loan book would be stored."""
    path = new_path(spark, "installments")
    stand_ins.installments(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"model_round_trip", "ols_fit"}))
def test_no_python_in_any_plan(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    # The cluster's own fitted model is the only function that is not an expression.
    assert "Python" not in text and "ArrowEval" not in text and "MapInPandas" not in text
    if not name.startswith("ols"):
        assert "UDF" not in text


def test_label_scan_reads_two_columns(stored):
    text = plan(C.label_credits(stored))
    assert re.search(r"ReadSchema: struct<credit_id:bigint,days_late:int>", text)
    assert "IsNotNull(credit_id)" in text


def test_credit_table_groups_once(stored):
    text = plan(C.credit_table(stored))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1
    assert "partial_min_by" in text and "partial_max" in text


def test_maturity_scans_the_detail_and_one_date_column(stored):
    text = plan(M.maturity_report(M.maturity(C.credit_table(stored), M.cutoff_date(stored))))
    assert text.count("FileScan") == 2
    assert "ReadSchema: struct<disbursed_at:timestamp_ntz>" in text


@pytest.mark.parametrize("report", [T.gap_histogram, T.gap_by_disbursement_day, T.timing_summary])
def test_timing_reports_scan_once(stored, report):
    text = final_plan(report(T.first_due(C.credit_table(stored))))
    assert text.count("FileScan") == 1


def nodes(node):
    """All operators of a plan that ran, query stages opened."""
    name = node.getClass().getSimpleName()
    yield node
    if name == "AdaptiveSparkPlanExec":
        below = [node.executedPlan()]
    elif name.endswith("QueryStageExec"):
        below = [node.plan()]
    else:
        below = [node.children().apply(i) for i in range(node.children().size())]
    for child in below:
        yield from nodes(child)


def shuffled_rows(df):
    """Rows that each shuffle of the frame wrote."""
    df.collect()
    found = nodes(df._jdf.queryExecution().executedPlan())
    return [
        n.metrics().apply("shuffleRecordsWritten").value()
        for n in found
        if n.getClass().getSimpleName() == "ShuffleExchangeExec"
    ]


@pytest.mark.parametrize("by", [[], ["installment_no"]])
def test_ordered_quantiles_do_not_shuffle_the_column(stored, by):
    rows = stored.where("amount_paid IS NOT NULL")
    found = Q.exact_quantiles(rows, "amount_paid", [0.5], by)
    groups = rows.select(*by).distinct().count() if by else 1
    assert rows.count() > 5000
    assert max(shuffled_rows(found), default=0) <= 40 * groups
    for keys in re.findall(r"hashpartitioning\(([^)]*)\)", plan(found)):
        assert "value#" not in keys or "cut_0#" in keys


def test_worst_installment_report_has_no_join(stored):
    text = plan(W.default_by_worst_installment(stored))
    assert "Join" not in text and text.count("FileScan") == 1
    counted = text.index("partial_count")
    assert counted > text.index("Window"), "equal rows are counted before the window"


def test_null_filters_reach_the_scans_of_the_model_table(spark):
    tables = []
    for build in (stand_ins.vehicles, stand_ins.ratings, stand_ins.operators):
        path = new_path(spark, "input")
        build(spark, SMALL).write.parquet(path)
        tables.append(spark.read.parquet(path))
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    text = prepare(*tables)._jdf.queryExecution().explainString(mode)
    for column in ("review_id", "vehicle_id", "review_score", "vehicle_type", "operator_id"):
        assert f"IsNotNull({column})" in text


@pytest.fixture(scope="module")
def skewed(stored):
    """A third of the rows under one credit, disbursement day and amount."""
    hot = F.col("credit_id") % 3 == 0
    return stored.select(
        F.when(hot, F.lit(7)).otherwise(F.col("credit_id")).alias("credit_id"),
        "disbursed_at",
        "installment_no",
        F.when(hot, F.lit(40)).otherwise(F.col("days_late")).alias("days_late"),
        "due_at",
        F.when(hot, F.lit(5.0)).otherwise(F.col("amount_paid")).alias("amount_paid"),
    )


def test_skewed_answers_equal_pandas(skewed):
    pdf = skewed.toPandas()
    worst = pdf.groupby("credit_id").days_late.max()
    found = {r.credit_id: r.max_days_late for r in C.label_credits(skewed).collect()}
    assert {k: v for k, v in found.items() if v is not None} == worst.dropna().to_dict()
    expected = pdf.amount_paid.quantile([0.01, 0.3, 0.5, 0.99]).to_list()
    got = Q.exact_quantiles(skewed, "amount_paid", [0.01, 0.3, 0.5, 0.99]).collect()[0].quantiles
    assert got == pytest.approx(expected)
    joined = pdf.merge(worst.rename("peak"), left_on="credit_id", right_index=True)
    at_peak = joined[(joined.days_late == joined.peak) & ((joined.peak <= 30) | (joined.peak > 60))]
    counts = at_peak.groupby("installment_no").size().to_dict()
    report = W.default_by_worst_installment(skewed).collect()
    assert {r.installment_no: r.n_credits for r in report} == counts
    assert W.worst_installments(skewed).count() == len(at_peak)


def test_hot_rows_shrink_before_the_shuffle(skewed):
    """A hot credit's equal rows combine in their task: repeating them adds nothing to the shuffle."""
    hot = skewed.where("credit_id = 7")
    rows = hot.count()
    repeated = hot.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("copy")
    once = shuffled_rows(W.default_by_worst_installment(hot))
    assert rows > 1000 and max(once) < rows / 4
    assert max(shuffled_rows(W.default_by_worst_installment(repeated))) == max(once)


def test_rows_at_maximum_in_one_scan(spark, skewed):
    """A limit by rank below the shuffle; the hot credit leaves its tasks as little more than its ties."""
    path = new_path(spark, "detail")
    skewed.repartition(4).write.parquet(path)
    stored = spark.read.parquet(path)
    expected = sorted(map(str, W.rows_at_group_maximum(stored, "credit_id", "days_late").collect()))
    kept = []
    real = W.written
    W.written = lambda df, name: kept.append(df) or real(df, name)
    try:
        found = W.rows_at_group_maximum_in_one_scan(stored, "credit_id", "days_late")
    finally:
        W.written = real
    assert sorted(map(str, found.collect())) == expected
    text = final_plan(kept[0])
    limits = [text.index("WindowGroupLimit"), text.rindex("WindowGroupLimit")]
    assert text.count("FileScan") == 1 and limits[0] < text.index("Exchange") < limits[1]
    kept.clear()
    W.written = lambda df, name: kept.append(df) or real(df, name)
    try:
        late = F.pmod(F.hash("disbursed_at", "due_at", "installment_no"), F.lit(900))
        hot = stored.where("credit_id = 7").withColumn("days_late", late)
        W.rows_at_group_maximum_in_one_scan(hot, "credit_id", "days_late")
    finally:
        W.written = real
    assert max(shuffled_rows(kept[0])) < stored.where("credit_id = 7").count() / 4


def test_month_pairs_come_from_one_aggregation(stored):
    timing = T.first_due(C.credit_table(stored))
    text = plan(T.default_by_month_pair(timing))
    assert text.count("FileScan") == 1 and text.count("Expand") == 1


def test_moments_take_one_scan(stored):
    """All moments of money in one pass of the rows; those of day counts from one list of counts."""
    from duefold.operators import summary as S

    text = plan(S.summary(T.first_due(C.credit_table(stored)), ["days_to_due", "month_gap"], small_domain=True))
    assert text.count("FileScan") == 1


def test_adaptive_skew_join_keeps_all_rows(spark, skewed):
    """Forced to shuffle, the join is split at the hot credit and returns the same rows."""
    path = new_path(spark, "skewed")
    late = F.when(F.col("credit_id") == 7, F.lit(90)).otherwise(F.col("days_late"))
    skewed.withColumn("days_late", late).repartition(8).write.parquet(path)
    many = spark.read.parquet(path)
    expected = sorted(map(str, W.worst_installments(many).collect()))
    settings = {
        "spark.sql.shuffle.partitions": "64",
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
    }
    before = {key: spark.conf.get(key, None) for key in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        df = W.worst_installments(many)
        assert sorted(map(str, df.collect())) == expected
        assert "SortMergeJoin(skew=true)" in plan(df)
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def _compiled(df, capsys):
    """Bytes of the longest method of each compiled part of a plan without adaptive stages."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.select("*").explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_typed_cells_of_a_wide_file_are_compiled(spark, tmp_path, capsys):
    """The JVM runs methods of more than 8000 bytes uncompiled."""
    folder = "/root/testdata/sf0.001"
    table = prepare(*(getattr(stand_ins, n)(spark, folder) for n in ("vehicles", "ratings", "operators")))
    writers.write_csv(table, str(tmp_path / "csv"))
    sizes = _compiled(readers.read_typed_csv(spark, str(tmp_path / "csv"), table.schema), capsys)
    assert sizes and max(sizes) < 8000


def test_moments_are_summed_by_compiled_code(spark, monkeypatch, capsys):
    """Aggregates of more than a hundred buffers are not compiled: every sum of a fit with ten features is."""
    asked, frame = [], type(spark.range(0))
    agg = frame.agg
    monkeypatch.setattr(frame, "agg", lambda df, *exprs: asked.append(agg(df, *exprs)) or asked[-1])
    names = [f"c{k}" for k in range(11)]
    R.co_moments(spark.range(50).select(*[F.rand(k).alias(c) for k, c in enumerate(names)]), names)
    monkeypatch.undo()
    assert asked
    for sums in asked:
        # One part before the exchange and one behind it.
        sizes = _compiled(sums, capsys)
        assert len(sizes) == 2 and max(sizes) < 8000
