from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import aggregates as a
from tidemark.operators import checks as ck
from tidemark.operators import joins as j
from tidemark.operators.serving import hourly_profile
from tidemark.plans import hourly, monthly
from tidemark.plans.backtests import ModelSet, backtest_matrix
from tidemark.operators.models import Ridge
from tidemark.operators.splits import Version


def test_hour_24_of_the_last_day_stays_in_its_month(spark, rows):
    df = spark.createDataFrame(
        [(date(2024, 1, 31), "lng", 500.0), (date(2024, 1, 31), "lng", 700.0), (date(2024, 2, 1), "lng", 999.0)],
        "trade_date date, fuel string, v double",
    )
    mix = a.trade_mix(a.to_monthly(df, ["v"], ["fuel"]), "v", "fuel", "volume", "mwh")
    got = {r.period_month: r.volume_lng_mwh_lag_1m for r in mix.collect()}
    assert got == {date(2024, 1, 1): None, date(2024, 2, 1): 1200.0, date(2024, 3, 1): 999.0}
    assert {r.volume_renewable_total_mwh_lag_1m for r in mix.collect()} == {None, 0.0}


def test_daily_prices_appear_one_month_later(spark):
    days = [(date(2024, 1, d), 10.0) for d in range(1, 29)] + [(date(2024, 2, d), 20.0) for d in range(1, 29)]
    out = a.daily_price_lags(spark.createDataFrame(days, "trade_date date, close double"), "close")
    got = {r.period_month: r.daily_mean_lag_1m for r in out.collect()}
    assert got == {date(2024, 1, 1): None, date(2024, 2, 1): 10.0, date(2024, 3, 1): 20.0}


def test_a_snapshot_is_unseen_before_its_date(spark):
    curve = spark.createDataFrame(
        [(date(2026, 5, 24), date(2026, 7, 1), 18.81), (date(2026, 5, 24), date(2026, 8, 1), 18.37)],
        "quote_date date, contract_month date, settle double",
    )
    months = spark.createDataFrame([(date(2026, m, 1),) for m in (3, 4, 5, 6)], "period_month date")
    asof = j.asof_latest(months, curve)
    got = {r[0]: (r[1], r[2]) for r in j.curve_points(asof, curve, "settle").collect()}
    assert got == {date(2026, 5, 1): (None, 18.81), date(2026, 6, 1): (18.81, 18.37)}


def hours(spark, n=24 * 30, skip=()):
    return spark.range(n).where(~F.col("id").isin(*skip) if skip else F.lit(True)).select(
        F.lit("mainland").alias("area"),
        F.timestamp_add("HOUR", F.col("id").cast("int"), F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")).alias("interval_end"),
        (100 + 10 * F.sin(F.col("id") / 24.0) + F.rand(7)).alias("price"),
        (F.col("id") + 0.5).alias("demand"),
    )


def test_hourly_table(spark):
    out = hourly.hourly_feature_table(hours(spark), check=True)
    table = out.table
    assert table.count() == 24 * 30 - 168 - 24
    assert out.missing_hours().isEmpty()
    assert not out.canary().where("suspect").collect()
    first = table.orderBy("interval_end").first()
    raw = {r.interval_end: r.price for r in hours(spark).collect()}
    assert first.interval_end == datetime(2024, 1, 8, 1)
    assert first.price_lag_168h == raw[datetime(2024, 1, 1, 1)]
    assert first[hourly.TARGET] == raw[datetime(2024, 1, 9, 1)]


def test_hourly_gaps_stop_a_checked_build(spark):
    with pytest.raises(AssertionError, match="gap"):
        hourly.hourly_feature_table(hours(spark, skip=(50,)), check=True)
    assert ck.daily_missing_hours(hours(spark, skip=(50,)), ["area"]).where("missing_hours = 1").count() >= 1


def test_a_feature_equal_to_the_target_is_found(spark):
    df = hours(spark, 48).withColumn("leak", F.col("price"))
    ck.assert_no_leakage(df, "price", ["demand"])
    with pytest.raises(AssertionError, match="leak"):
        ck.assert_no_leakage(df, "price", ["demand", "leak"])
    ck.assert_no_leakage(df.limit(5), "price", ["leak"])


def price_revisions(spark, n=120):
    return spark.range(n).select(
        F.lit("mainland").alias("area"), F.expr("add_months(date'2015-01-01', cast(id as int))").alias("period_month"),
        (100 + 20 * F.sin(F.col("id") / 6.0) + F.rand(11)).alias("price"), F.lit(1).alias("source_priority"),
        F.lit(datetime(2025, 1, 1)).cast("timestamp_ntz").alias("collected_at"), F.lit("s").alias("source_file_sha256"),
        F.lit("p").alias("parsed_path"),
    )


def test_optional_blocks_keep_the_row_count(spark):
    block = spark.createDataFrame(
        [(date(2016, 5, 1), 1.0), (date(2016, 5, 1), 2.0), (date(1990, 1, 1), 3.0)], "period_month date, x_lag_1m double"
    )
    plain = monthly.monthly_feature_table(monthly.MonthlyInputs(price_revisions(spark)))
    joined = monthly.monthly_feature_table(
        monthly.MonthlyInputs(price_revisions(spark), blocks={"x": block}), check=True
    )
    assert plain.table.count() == joined.table.count() == 120 - 12 - 1
    ck.assert_row_count(plain.table, joined.table)
    info = joined.block_info().first()
    assert (info.block, info.missing_periods) == ("x", 106)
    row = joined.table.where("period_month = date'2016-05-01'").first()
    assert (row.target_month, row.information_cutoff, row.horizon) == (date(2016, 6, 1), datetime(2016, 5, 31, 23, 59, 59), "1M")
    assert row.x_lag_1m is not None and joined.dedup_log().isEmpty()


def test_price_block_without_common_months_is_empty(spark):
    volume = spark.createDataFrame([(date(2024, 1, 1), 10.0), (date(2024, 2, 1), None)], "period_month date, v double")
    amount = spark.createDataFrame([(date(2024, 1, 1), None), (date(2024, 2, 1), 5000.0)], "period_month date, a double")
    pairs = {"price": ("a", "v")}
    assert monthly.price_block(volume, amount, pairs).isEmpty()
    assert monthly.overlap_info(volume, amount).first().warning is not None
    both = amount.withColumn("a", F.lit(5000.0))
    got = {r[0]: r[1] for r in monthly.price_block(volume, both, pairs).collect()}
    assert got == {date(2024, 1, 1): 0.5, date(2024, 2, 1): None}


def test_a_short_cell_is_skipped_with_a_reason(spark):
    panel = spark.range(60).select(
        F.lit("a").alias("area"), F.expr("add_months(date'2010-01-01', cast(id as int))").alias("period_month"),
        (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 7 + F.rand(3)).alias("target"),
    )
    models = ModelSet({"persistence_monthly": "x"}, {"ridge": Ridge(("x",))}, {"ridge": 36})
    versions = [
        Version("early", "2011-01-01", "2011-01-01", "2011-02-01", "2011-06-01"),
        Version("late", "2014-01-01", "2014-01-01", "2014-02-01", "2014-06-01"),
        Version("none", "2014-01-01", "2014-01-01", "2030-01-01", "2030-06-01"),
    ]
    got = {(r.version, r.model): r for r in backtest_matrix(panel, ["area"], versions, models, "target").collect()}
    assert len(got) == 6
    assert got["early", "ridge"].skip_reason == "n_train=12 < min_train_rows=36" and got["early", "ridge"].mae is None
    assert got["early", "persistence_monthly"].n_test == 5
    assert got["late", "ridge"].mae > 0 and not got["late", "ridge"].skipped
    assert got["none", "ridge"].skip_reason == "no rows to evaluate"


def test_profile_keeps_the_mean(spark):
    month = spark.createDataFrame([(240.0,)], "v double")
    out = hourly_profile(month, "v")
    assert out.count() == 24
    assert out.agg(F.avg("predicted")).first()[0] == pytest.approx(240.0)


def test_blocks_keep_whole_rows(spark):
    import datetime

    from tidemark.plans.monthly import _merge_blocks

    month = datetime.date(2024, 1, 1)
    one = spark.createDataFrame([(month, 1.0, 9.0), (month, 2.0, 3.0)], "period_month date, a double, b double")
    two = spark.createDataFrame([(month, None)], "period_month date, c double")
    assert [tuple(r) for r in _merge_blocks([one, two]).collect()] == [(month, 2.0, 3.0, None)]
    with pytest.raises(ValueError, match="share"):
        _merge_blocks([one, one])
