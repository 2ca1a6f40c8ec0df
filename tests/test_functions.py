"""Scalar helpers against the JavaScript rules they stand for."""
import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from matflow.functions import exprs as X


def _eval(spark, col, values, schema="v string"):
    df = spark.createDataFrame([(v,) for v in values], schema)
    return [r[0] for r in df.select(col).collect()]


def test_lenient_int(spark):
    vals = ["12abc", "abc", "0", "", None, "-5", "  7", "+3x", "0012"]
    assert _eval(spark, X.lenient_int(F.col("v"), 1), vals) == [12, 1, 1, 1, 1, -5, 7, 3, 12]


def test_lenient_decimal(spark):
    vals = ["12.345", "abc", ".5", "-2", None, "3.", "1e3"]
    out = _eval(spark, X.lenient_decimal(F.col("v")), vals)
    assert out == [Decimal("12.35"), Decimal("0.00"), Decimal("0.50"), Decimal("-2.00"), Decimal("0.00"),
                   Decimal("3.00"), Decimal("1000.00")]


def test_clean_text(spark):
    assert _eval(spark, X.clean_text(F.col("v")), ["  a b ", "   ", None, "\tx\n"]) == ["a b", None, None, "x"]


def test_format_mad(spark):
    out = _eval(spark, X.format_mad(F.col("v")), [Decimal("1234567.891"), None, Decimal("5")],
                "v decimal(12,3)")
    assert out == ["1 234 567,89 MAD", "—", "5,00 MAD"]
    out0 = _eval(spark, X.format_mad0(F.col("v")), [Decimal("33400.5")], "v decimal(12,2)")
    assert out0 == ["33 401 MAD"]


def test_format_date_fr(spark):
    assert _eval(spark, X.format_date_fr(F.col("v")), [dt.date(2024, 1, 5), None], "v date") == \
        ["05/01/2024", "—"]


def test_audit_json_drops_nulls(spark):
    df = spark.createDataFrame([("x", 3, None)], "a string, b int, c long")
    assert df.select(X.audit_json("a", "b", "c")).first()[0] == '{"a":"x","b":3}'


def test_div_half_up(spark):
    df = spark.createDataFrame([(Decimal("12.34"), 8), (Decimal("1.00"), 3)], "t decimal(20,2), n long")
    out = [r[0] for r in df.select(X.div_half_up(F.col("t"), F.col("n"), 3)).collect()]
    assert out == [Decimal("1.543"), Decimal("0.333")]
