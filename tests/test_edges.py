"""Awkward files, names, shares and settings."""

import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from duefold import session
from duefold.functions import parse_money, parse_percentage, parse_timestamp
from duefold.operators import credits as C
from duefold.operators import features as FE
from duefold.operators import profile as P
from duefold.operators import regression as R
from duefold.operators import summary as S
from duefold.operators import tables as TA
from duefold.operators import timing as TI
from duefold.operators import worst as W
from duefold.operators.histogram import histogram
from duefold.sources import stand_ins
from duefold.sources.readers import read_delimited, read_parquet, read_typed_csv
from duefold.sources.writers import write_csv

from .conftest import SMALL

ODD = ['say "hi", ok', "ends in \\", 'a\nb "c"\n', "  blanks  ", "'", '"', "plain", "a,b;c|d", "\\\"x"]


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_csv_from_another_library(spark, tmp_path):
    (tmp_path / "in").mkdir()
    pd.DataFrame({"id": range(len(ODD)), "text": ODD}).to_csv(tmp_path / "in/x.csv", index=False)
    schema = spark.createDataFrame([], "id long, text string").schema
    back = read_typed_csv(spark, str(tmp_path / "in"), schema, multi_line=True)
    assert [r.text for r in back.orderBy("id").collect()] == ODD


def test_own_csv_is_standard(spark, tmp_path):
    df = spark.createDataFrame(list(enumerate(ODD)), "id long, text string").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.csv"))
    assert pd.read_csv(files[0])["text"].tolist() == ODD
    back = read_typed_csv(spark, str(tmp_path / "out"), df.schema, multi_line=True)
    assert [r.text for r in back.orderBy("id").collect()] == ODD


@pytest.mark.parametrize("line", ["1|2|3", "4"])
def test_lines_with_other_cell_counts_raise(spark, tmp_path, line):
    (tmp_path / "x.csv").write_text(f"a|b\n1|2\n{line}\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        read_delimited(spark, str(tmp_path / "x.csv"), sep="|").collect()


def test_files_with_other_headers_raise(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a|b\n1|2\n")
    (tmp_path / "y.csv").write_text("b|a\n3|4\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(tmp_path / "*.csv"), sep="|").collect()


def test_inferred_types_and_missing_texts(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b,c,d,e\n1,NA,2.5,t,true\nNULL,NA,3,f,false\n")
    df = read_delimited(spark, str(tmp_path / "x.csv"))
    assert [t for _, t in df.dtypes] == ["int", "string", "double", "string", "boolean"]
    assert [tuple(r) for r in df.collect()] == [(1, None, 2.5, "t", True), (None, None, 3.0, "f", False)]


def test_crosstab_keeps_every_pair(spark):
    df = spark.createDataFrame([(0, 1.5), (1, 2.0), (2, 7.0), (2, float("nan"))], "r int, `c.x` double")
    found = TA.crosstab(df, "r", "c.x")
    assert found.columns == ["r", "c.x_1.5", "c.x_2.0", "c.x_7.0"]
    assert [tuple(r) for r in found.collect()] == [(0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1)]
    with pytest.raises(Exception, match="not listed"):
        TA.crosstab(df, "r", "c.x", [1.5]).collect()


@pytest.mark.parametrize("exact", [True, False])
def test_shares_at_and_beyond_the_ends(spark, exact):
    df = spark.range(500)
    for share, size in ((0, 0), (1, 500), (1.0, 500)):
        assert R.split(df, ["id"], share, exact=exact).where("is_test").count() == size
    for share in (-0.1, 1.5):
        with pytest.raises(ValueError):
            R.split(df, ["id"], share, exact=exact)


def test_both_levels_of_the_exact_split(spark, monkeypatch):
    """With short prefixes hundreds of hashes are left for each level."""
    monkeypatch.setattr(R, "_PREFIX", 1)
    df = spark.range(3000)
    hashes = sorted(r._hash for r in R._with_hash(df, ["id"], 3).collect())
    for share in (0.001, 0.2, 0.777, 1.0):
        cut = R.split_point(df, ["id"], share).first().cut
        assert cut == hashes[math.ceil(share * 3000) - 1]


def test_scores_leave_out_rows_without_a_prediction(spark):
    rows = [(1.0, 1.0), (100.0, None), (3.0, 2.0), (None, 9.0), (float("nan"), 1.0)]
    got = R.score(spark.createDataFrame(rows, "price double, prediction double")).first()
    assert (got.n, got.r2, got.mae, got.max_error) == (2, 0.5, 0.5, 1.0)


def test_distinct_counts_leave_out_nan(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (1.0,), (1.0,)], "`a.x` double")
    for error in (None, 0.01):
        assert P.distinct_counts(df, ["a.x"], error).first().n_distinct == 2


def test_names_with_dots(spark):
    df = spark.createDataFrame([("k", 1.0, 2), ("k", 3.0, None)], "`k.k` string, `a.x` double, `n.o` int")
    assert P.missing_share(df).first()["column"] == "n.o"
    assert [r.non_missing for r in P.schema_profile(df).collect()] == [2, 2, 1]
    assert TA.mean_by(df, "k.k").first()["a.x"] == 2.0
    assert S.summary(df, ["a.x"]).first()["mean"] == 2.0
    assert C.first_values(df, "k.k", ["a.x"]).first()["n.o"] == 2


@pytest.mark.parametrize("ansi", [True, False])
def test_bad_text_raises_under_either_setting(spark, tmp_path, ansi):
    text = spark.createDataFrame([("cheap",)], "t string")
    (tmp_path / "x.csv").write_text("id\n99999999999999999999\n")
    schema = spark.createDataFrame([], "id int").schema
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        for value in (parse_money(F.col("t")), parse_percentage(F.col("t")),
                      parse_timestamp(F.col("t")), parse_timestamp(F.col("t"), "yyyy/MM/dd")):
            with pytest.raises(Exception):
                text.select(value).collect()
        with pytest.raises(Exception):
            read_typed_csv(spark, str(tmp_path / "x.csv"), schema).collect()
        assert text.select(parse_money(F.lit(None).cast("string"))).first()[0] is None
        assert text.select(parse_money(F.lit("$1,234.50"))).first()[0] == 1234.5
    finally:
        spark.conf.unset("spark.sql.ansi.enabled")


def test_an_unset_shared_folder_is_an_error():
    class Conf:
        def get(self, key, default=None):
            return default

    class Session:
        conf = Conf()

    with pytest.raises(ValueError):
        session.shared_folder(Session())


def test_valid_range_groups_the_detail_once(spark, tmp_path):
    stand_ins.installments(spark, SMALL).write.parquet(str(tmp_path / "detail"))
    stored = spark.read.parquet(str(tmp_path / "detail"))
    text = final_plan(TI.valid_range(TI.first_due(C.credit_table(stored))))
    final = text.split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1


def test_the_label_test_reaches_the_scan(spark, tmp_path):
    stand_ins.installments(spark, SMALL).write.parquet(str(tmp_path / "detail"))
    worst = W.worst_installments(spark.read.parquet(str(tmp_path / "detail")))
    text = worst._jdf.queryExecution().executedPlan().toString()
    assert "Or(LessThanOrEqual(days_late,30),GreaterThan(days_late,60))" in text


def test_no_table_name_is_left(spark):
    from contract.queries import QUERIES

    found = QUERIES["table_round_trip"](spark, SMALL)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("vehicles_")]
    assert found.count() > 0


NAMES = ["k.k", "a.x", "t.t", "_hash", "cut", "peak", "peak_key", "part", "rank", "x", "value", "column"]


def odd_names(spark):
    rows = [("k", 1.0, "5%", "mine", 1, 2, 3, 4, 5, 6, 7, 8), ("k", 3.0, "10%", "own", 1, 2, 3, 4, 5, 6, 7, 8)]
    types = ["string", "double", "string", "string", *["int"] * 8]
    return spark.createDataFrame(rows, ", ".join(f"`{n}` {t}" for n, t in zip(NAMES, types)))


def test_operators_on_names_of_all_kinds(spark, tmp_path):
    df = odd_names(spark)
    for find in (W.rows_at_group_maximum, W.rows_at_group_maximum_in_one_scan):
        assert [tuple(r) for r in find(df, "k.k", "a.x").collect()] == [tuple(df.collect()[1])]
    for options in ({}, {"exact": False}, {"cut": "f" * 32}):
        back = R.split(df, ["a.x"], 0.5, **options)
        assert back.columns == [*NAMES, "is_test"]
        assert sorted(r._hash for r in back.collect()) == ["mine", "own"]
    assert P.preview(df, ["a.x", "_hash"], ["a.x"], 1).first() == (1.0, "mine")
    assert histogram(df, "a.x", 2).agg(F.sum("n")).first()[0] == 2
    cleaned = FE.clean_operators(df, flags=["_hash"], percentages=["t.t"]).collect()
    assert sorted(r["t.t"] for r in cleaned) == [0.05, 0.1]
    prices = spark.createDataFrame([("$1,234.0", "t")], "`p.p` string, `f.f` string")
    assert tuple(FE.clean_vehicles(prices, flags=["f.f"], money=["p.p"]).first()) == (1234.0, True)
    df.write.parquet(str(tmp_path / "p"))
    assert read_parquet(spark, str(tmp_path / "p"), ["k.k", "cut"]).columns == ["k.k", "cut"]
    options = R.ModelOptions(target="a.x", features=("x", "cut"))
    fitted = R.fit_min_norm(df, options)
    assert fitted.rank == 0 and fitted.intercept == 2.0 and fitted.n == 2
    assert {r.prediction for r in R.predict_linear(fitted, df).collect()} == {2.0}
