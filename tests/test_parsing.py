"""Table-driven cases for the typed parsers and text cleaning (FIXTURES section 5)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storelens.functions import parsing as P
from storelens.functions.text import clean_text


def _one(spark, expr, values, dtype="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {dtype}")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_parse_rating(spark):
    assert _one(spark, P.parse_rating, ["4.1", "NaN", "", "-1", None]) == [
        Decimal("4.10"), None, None, None, None]


def test_parse_count(spark):
    assert _one(spark, P.parse_count, ["159", "3.0M", None]) == [159, 0, 0]


def test_parse_size(spark):
    got = _one(spark, P.parse_size_mb, ["19M", "512k", "8.7m", "Varies with device", "1,000+"])
    assert got == [Decimal("19"), Decimal("0.5"), Decimal("8.7"), None, None]


def test_parse_installs(spark):
    assert _one(spark, P.parse_installs, ["10,000+", "0", "Free", "0+"]) == [10000, 0, 0, 0]


def test_parse_price(spark):
    assert _one(spark, P.parse_price, ["$4.99", "0", "Everyone", None]) == [
        Decimal("4.99"), Decimal("0"), Decimal("0"), Decimal("0")]


def test_parse_date(spark):
    got = _one(spark, P.parse_long_date, ["January 7, 2018", "January 07, 2018", "1.0.19"])
    assert got == [dt.date(2018, 1, 7), dt.date(2018, 1, 7), None]


def test_parse_polarity(spark):
    got = _one(spark, P.parse_polarity, ["-0.5", "0.533333335", "5.55E-17", "nan"])
    assert got == [Decimal("-0.50000"), Decimal("0.53333"), None, None]
    assert _one(spark, P.parse_subjectivity, ["-0.1"]) == [None]


@pytest.mark.parametrize("raw,expected", [
    ("see HTTPS://x.y/z?a=1 now", "see now"),
    ("<b>bold</b> x", "bold x"),
    ("100% good :)", "100 good"),
    ("a b http://x tail", "a b tail"),
    ("<a b>z", "z"),
    ("www.a.b,c d", "d"),
    ("<a\rb>z", "z"),
    ("<a\nb>z", "a b z"),
    (None, ""),
])
def test_clean_text(spark, raw, expected):
    assert _one(spark, clean_text, [raw]) == [expected]


def test_loose_dashboard_parse(spark):
    assert _one(spark, P.loose_installs, ["1,000+", "Free"]) == [1000.0, None]
    assert _one(spark, P.loose_price, ["$4.99", "Everyone", None]) == [4.99, 0.0, 0.0]
