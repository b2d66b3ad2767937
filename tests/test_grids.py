from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.grids import (
    LagSpec, RollSpec, add_lags, add_rolls, exogenous_lag, hourly_grid, lead_target, monthly_grid, price_lags,
)


def months(spark, values, name="v"):
    return spark.createDataFrame(
        [(date(2024, m, 1), float(v)) for m, v in values], f"period_month date, {name} double"
    )


def test_gap_gives_null_and_newest_month_appears_one_later(spark, rows):
    out = exogenous_lag(months(spark, [(1, 100), (2, 110), (4, 130)]), ["v"])
    assert [r[1] for r in rows(out, "period_month")] == [None, 100.0, 110.0, None, 130.0]
    assert rows(out, "period_month")[-1][0] == date(2024, 5, 1)


@pytest.mark.parametrize("order", [[2, 1, 3, 2], [1, 2, 3, 2], [3, 2, 2, 1]])
def test_duplicates_are_averaged_in_any_order(spark, rows, order):
    values = {1: [10], 2: [99, 21], 3: [30]}
    picked = [(m, values[m].pop()) for m in order]
    out = rows(exogenous_lag(months(spark, picked), ["v"]), "period_month")
    assert out == [
        (date(2024, 1, 1), None), (date(2024, 2, 1), 10.0), (date(2024, 3, 1), 60.0), (date(2024, 4, 1), 30.0),
    ]


def test_no_change_is_made_up_over_a_gap(spark, rows):
    out = rows(price_lags(months(spark, [(1, 10), (2, 20), (4, 40)], "gas"), "gas"), "period_month")
    changes = {r[0].month: r[3] for r in out}
    assert changes == {1: None, 2: None, 3: 1.0, 4: None, 5: None, 6: None}
    assert "gas" not in price_lags(months(spark, [(1, 10)], "gas"), "gas").columns


def test_rolling_leaves_out_the_current_row_and_needs_a_full_window(spark, rows):
    grid = monthly_grid(months(spark, [(m, m) for m in range(1, 7)]), [])
    out = rows(add_rolls(grid, [], "period_month", [RollSpec("v", 3, "mean", "r")]), "period_month")
    assert [r[2] for r in out] == [None, None, None, 2.0, 3.0, 4.0]


def test_lag_is_a_step_in_time_per_group(spark, rows):
    df = spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 0), 1.0), ("a", datetime(2024, 1, 1, 2), 3.0), ("b", datetime(2024, 1, 1, 1), 9.0)],
        "area string, interval_end timestamp_ntz, v double",
    )
    out = add_lags(hourly_grid(df, ["area"]), ["area"], "interval_end", [LagSpec("v", 1, "l1"), LagSpec("v", 2, "l2")])
    assert [(r[0], r[1].hour, r[3], r[4]) for r in rows(out, "area", "interval_end")] == [
        ("a", 0, None, None), ("a", 1, 1.0, None), ("a", 2, None, 1.0), ("b", 1, None, None),
    ]


def test_specs_that_look_ahead_are_refused(spark):
    grid = monthly_grid(months(spark, [(1, 1)]), [])
    with pytest.raises(ValueError):
        add_lags(grid, [], "period_month", [LagSpec("v", 0, "x")])
    with pytest.raises(ValueError):
        lead_target(grid, [], "period_month", "v", 0)
    with pytest.raises(ValueError):
        add_rolls(grid, [], "period_month", [RollSpec("v", 3, "median", "x")])
    with pytest.raises(KeyError):
        add_lags(grid, [], "period_month", [LagSpec("w", 1, "x")])


def test_two_rows_for_one_slot_stop_the_grid(spark):
    with pytest.raises(Exception, match="more than one row per"):
        monthly_grid(months(spark, [(1, 1), (1, 2)]), []).collect()


def test_grid_and_lags_need_one_shuffle(spark):
    df = spark.range(1000).select(
        (F.col("id") % 5).cast("string").alias("area"),
        F.expr("add_months(date'2000-01-01', cast(id div 5 as int))").alias("period_month"),
        F.col("id").cast("double").alias("v"),
    )
    grid = monthly_grid(df, ["area"])
    out = add_lags(grid, ["area"], "period_month", [LagSpec("v", 1, "l")])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
