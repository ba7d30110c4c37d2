import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditlens.functions import payload as P
from auditlens.functions import scalars as S
from auditlens.functions import texts as X
from auditlens.functions.features import FeatureRule, apply_features, safe_name
from auditlens.functions.scalars import c


def values(spark, rows, ddl, *columns):
    df = spark.createDataFrame(rows, ddl)
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize("text, number", [
    ("12.", 12.0), (" 7 ", 7.0), ("-.5", -0.5), ("+3", 3.0), ("1e5", None), ("nan", None), ("", None),
    ("<NA>", None), ("1,000", None), (None, None), ("\t5", None),
])
def test_safe_num(spark, text, number):
    assert values(spark, [(text,)], "v string", S.safe_num(c("v"))) == [(number,)]


def test_typed_numbers_keep_exponents_and_lose_nan(spark):
    rows = values(spark, [(1e20,), (float("nan"),), (float("inf"),)], "v double",
                  S.safe_num(c("v"), spark.createDataFrame([], "v double").schema["v"].dataType))
    assert rows == [(1e20,), (None,), (None,)]


@pytest.mark.parametrize("text, stamp, day", [
    ("2024-02-29T10:11:12Z", "2024-02-29 10:11:12", "2024-02-29"),
    ("2024-02-29 10:11:12.5+05:30", "2024-02-29 10:11:12.5", "2024-02-29"),
    ("2024-02-29 noon", "2024-02-29 00:00:00", "2024-02-29"),
    ("2023-02-29", None, None),
    ("29/02/2024", None, None),
    ("2024-02", None, None),
])
def test_safe_dates(spark, text, stamp, day):
    got = values(spark, [(text,)], "v string", S.safe_ts(c("v")).cast("string"),
                 S.safe_date(c("v")).cast("string"))
    assert got == [(stamp, day)]


@pytest.mark.parametrize("clock, night", [
    ("00:00:00", False), ("20:59:00", False), ("21:00:00", True), ("05:59:59", True),
    ("06:00:00", False), ("00:00:01", True),
])
def test_night_boundaries(spark, clock, night):
    assert values(spark, [(f"2024-01-01 {clock}", clock)], "v string, k string", S.at_night(c("v")),
                  S.at_night(c("k"), clock_text=True)) == [(night, night)]


def test_business_days_match_numpy(spark):
    rng = np.random.default_rng(7)
    start = date(2000, 1, 1)
    days = rng.integers(-4000, 4000, size=(2000, 2))
    rows = [(start + timedelta(days=int(a)), start + timedelta(days=int(b))) for a, b in days]
    got = [r[0] for r in values(spark, rows, "a date, b date", S.busday_gap(c("a"), c("b")))]
    want = [float(np.busday_count(a, b)) for a, b in rows]
    assert got == want
    assert values(spark, [(date(2025, 1, 3), None)], "a date, b date",
                  S.busday_gap(c("a"), c("b"))) == [(None,)]


def test_text_of_whole_numbers(spark):
    kind = spark.createDataFrame([], "v double").schema["v"].dataType
    rows = values(spark, [(100.0,), (0.5,), (12345678.5,), (None,)], "v double", S.text_of(c("v"), kind))
    assert rows == [("100",), ("0.5",), ("12345678.5",), (None,)]


def test_feature_names_and_warnings(spark):
    assert safe_name("2nd rule!", "x") == "col_2nd_rule_"
    assert safe_name("  ", "Feature 3") == "Feature 3"
    assert len(safe_name("a" * 90, "x")) == 63
    df = spark.createDataFrame([(1, None)], "`t.a` int, `t.b` string")
    out, names, warnings = apply_features(df, [
        FeatureRule("f", "ratio", "a", "b"), FeatureRule("f", "missingflag", "t.b"),
        FeatureRule("bad", "cube", "a")])
    assert names == ["f", "f_2"] and len(warnings) == 1
    assert out.select("f", "f_2").first() == (None, 1.0)


def test_presentable_reason(spark):
    rows = [("RULE::Large__amount ",), ("  ",), (None,), ("OUTLIER::a  b",)]
    assert values(spark, rows, "v string", X.presentable(c("v"))) == [
        ("Large amount",), (None,), (None,), ("a b",)]


def test_risk_and_labels(spark):
    rows = [(True, None), (False, 0.1), (False, 0.845), (False, 0.6)]
    points = X.risk_score(c("r"), c("s"))
    assert values(spark, rows, "r boolean, s double", points, X.risk_label(points)) == [
        (95, "High"), (35, "Low"), (85, "High"), (60, "Medium")]


def test_value_and_percent_text(spark):
    rows = [("1234.5",), ("0.25",), ("0",), ("12",), (None,), ("x" * 50,)]
    assert [r[0] for r in values(spark, rows, "v string", X.value_text(c("v")))] == [
        "1,234", "0.2500", "0.00", "12.00", "unknown", "x" * 37 + "..."]
    assert [r[0] for r in values(spark, [(0.5,), (0.015,), (0.0001,)], "v double",
                                 X.percent_text(c("v")))] == ["50.0%", "1.50%", "0.010%"]


def test_payload_lookup_order(spark):
    df = spark.range(1).select(F.expr(
        "map('dak.amount', '0', 'bill.Amount_Passed', '7.5', 'amount', '')").alias("p"))
    assert df.select(P.payload_amount(c("p")), P.payload_value(c("p"), ["amount"]),
                     P.stored_amount(c("p")), P.page_amount(c("p"))).first() == (7.5, "0", 0.0, 0.0)


def test_review_payload_names_and_exclusions(spark):
    df = spark.createDataFrame([(1, "A", 2.0, True)],
                               "dak_amount int, `bill.invoice_no` string, derived double, user_rule boolean")
    got = df.select(P.review_payload(df.schema, ["dak", "bill"], ["derived"])).first()[0]
    assert got == {"dak.amount": "1", "bill.invoice_no": "A"}


def test_rarity(spark):
    got = values(spark, [(0.01,), (0.0,)], "v double", X.rarity(c("v")))
    assert math.isclose(got[0][0], 2.0) and math.isclose(got[1][0], 6.0)


def test_stateless_expressions_work_on_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 23:00:00",), ("2024-01-01 12:00:00",)], "v string").write.parquet(
        str(tmp_path / "in"))
    stream = spark.readStream.schema("v string").parquet(str(tmp_path / "in"))
    query = (stream.select(S.at_night(c("v")).alias("night")).writeStream.format("memory")
             .queryName("nights").trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert spark.table("nights").where(F.col("night")).count() == 1


def test_decimals_are_those_of_the_binary_value(spark):
    import random

    rng = random.Random(6)
    values = [1000.5, 2500.5, 2.675, 1.005, 0.125, 0.00005, 0.00015, 999.995, -2.675, -1000.5, 0.0, 10.25, 0.1025]
    values += [round(rng.uniform(0, 900), 3) for _ in range(3000)] + [rng.randrange(10**6) / 10**5 for _ in range(3000)]
    values += [rng.randrange(10**7) + 0.5 for _ in range(50)] + [k + j / 8 for k in range(5) for j in range(8)]

    def plain(v):
        return f"{v:,.0f}" if abs(v) >= 1000 else f"{v:.4f}" if v and abs(v) < 1 else f"{v:.2f}"

    def percent(v):
        p = v * 100
        return f"{p:.1f}%" if p >= 10 else f"{p:.2f}%" if p >= 1 else f"{p:.3f}%"

    rows = spark.createDataFrame([(v,) for v in values], "v double").select(
        "v", X.number_text(F.col("v")).alias("n"), X.percent_text(F.col("v")).alias("p")).collect()
    assert [(r["v"], r["n"], r["p"]) for r in rows] == [(v, plain(v), percent(v)) for v in values]


def test_texts_are_computed_once_per_row(spark):
    """A look-up that is read as a number or put into words stands in the plan once."""
    from auditlens.functions.scalars import float_of
    from auditlens.functions.texts import readable, readable_category

    df = spark.createDataFrame([(" 1.5 ",), ("1e999",), ("n/a",), (None,)], "x string")
    for step in (float_of, readable, readable_category):
        plan = df.select(step(F.upper("x")).alias("y"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("upper(") == 1, step
    assert [r[0] for r in df.select(float_of(F.col("x"))).collect()] == [1.5, None, None, None]
