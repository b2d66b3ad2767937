from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import parsing as p


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0][0]


@pytest.mark.parametrize(
    "text, value",
    [("1,234.5", 1234.5), (" 7 ", 7.0), ("", None), ("n/a", None), ("NaN", None), ("12d", None), ("1e3", 1000.0), ("-0", 0.0)],
)
def test_number(spark, text, value):
    assert one(spark, p.number(F.lit(text))) == value


def test_percent(spark):
    assert one(spark, p.percent(F.lit("1,012.5%"))) == 1012.5


@pytest.mark.parametrize(
    "text, fmt, value",
    [
        ("2024/03", "%Y/%m", date(2024, 3, 1)), ("2024/3", "%Y/%m", date(2024, 3, 1)), ("202403", "%Y%m", date(2024, 3, 1)),
        ("2024-03-17", "%Y-%m-%d", date(2024, 3, 1)), ("총계", "%Y/%m", None),
    ],
)
def test_to_month(spark, text, fmt, value):
    assert one(spark, p.to_month(F.lit(text), fmt)) == value


def test_strict_month_raises(spark):
    with pytest.raises(Exception):
        one(spark, p.to_month(F.lit("total"), "%Y/%m", strict=True))


def test_trade_date(spark):
    assert one(spark, p.to_trade_date(F.lit(" 3/7/2024 "), "%m/%d/%Y")) == date(2024, 3, 7)
    assert one(spark, p.to_trade_date(F.lit('"24 May 2026"'), "%d %b %Y")) == date(2026, 5, 24)
    assert one(spark, p.to_trade_date(F.lit("2/30/2024"), "%m/%d/%Y")) is None


def test_hour_24_is_the_next_midnight(spark):
    day = F.lit("2024-01-31").cast("date")
    assert one(spark, p.interval_end(day, F.lit(24))) == datetime(2024, 2, 1)
    assert one(spark, p.interval_start(day, F.lit(1))) == datetime(2024, 1, 31)
    with pytest.raises(Exception, match="out of 1..24"):
        one(spark, p.interval_end(day, F.lit(25)))


@pytest.mark.parametrize(
    "label, code, expected",
    [
        ("JUL 2026", None, date(2026, 7, 1)), ("", "JKMN6", date(2026, 7, 1)), ("", "JKMN4", date(2034, 7, 1)),
        ("", "JKM?4", None), ("", "ABCN6", None), ("", "JKMNx", None), (None, None, None),
    ],
)
def test_contract_month(spark, label, code, expected):
    quote = F.lit("2026-05-24").cast("date")
    assert one(spark, p.contract_month(F.lit(label), F.lit(code), quote)) == expected


@pytest.mark.parametrize(
    "now, day, slot",
    [
        ("2026-05-24 05:10:00", date(2026, 5, 24), "0500"), ("2026-05-24 05:09:00", date(2026, 5, 24), "0200"),
        ("2026-05-24 02:05:00", date(2026, 5, 23), "2300"),
    ],
)
def test_latest_slot(spark, now, day, slot):
    slots = ["0200", "0500", "0800", "1100", "1400", "1700", "2000", "2300"]
    d, s = p.latest_slot(F.lit(now).cast("timestamp_ntz"), slots, 10)
    assert (one(spark, d), one(spark, s)) == (day, slot)


def test_year_from_file_name(spark):
    assert one(spark, p.from_filename(F.lit("capacity (2021).csv"))) == "2021"
    with pytest.raises(Exception, match="does not match"):
        one(spark, p.from_filename(F.lit("capacity.csv")))
