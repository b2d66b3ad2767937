"""Validation and leakage control on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks as ck
from tidemark.operators.grids import lead_target, monthly_grid
from tidemark.operators.joins import join_blocks
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.queries.scalars import MONTHLY_FUEL, monthly_fuel


@query(
    "v1_duplicate_keys",
    """WITH T AS (SELECT o_orderkey, o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month FROM orders)
SELECT * FROM T WHERE (o_custkey, period_month) IN (
  SELECT (o_custkey, period_month) FROM T GROUP BY o_custkey, period_month HAVING count(*) > 1)""",
)
def duplicate_keys(spark, d):
    keyed = read_table(spark, d, "orders").select(
        "o_orderkey", "o_custkey", shapes.month_of("o_orderdate").alias("period_month")
    )
    return ck.duplicate_keys(keyed, ["o_custkey", "period_month"])


@query(
    "v2_hourly_gaps",
    with_shapes("H")
    + """, S AS (SELECT area, interval_end, date_diff('second', lag(interval_end) OVER (
  PARTITION BY area ORDER BY interval_end), interval_end) AS step_seconds FROM H)
SELECT * FROM S WHERE step_seconds > 3600 + 1800""",
)
def hourly_gaps(spark, d):
    hours = shapes.hourly_price(spark, d).select("area", "interval_end")
    return ck.hourly_gaps(hours, ["area"], slack_minutes=30)


@query(
    "v3_daily_missing_hours",
    with_shapes("H")
    + """ SELECT area, CAST(interval_end - INTERVAL 1 HOUR AS DATE) AS trade_date, count(*) AS hour_count,
  24 - count(*) AS missing_hours FROM H GROUP BY 1, 2""",
)
def daily_missing_hours(spark, d):
    return ck.daily_missing_hours(shapes.hourly_price(spark, d), ["area"])


@query(
    "v4_leakage_canary",
    with_shapes("PANEL")
    + """, F AS (SELECT *, target AS leaked, CASE WHEN month(period_month) = 1 THEN target END AS partly FROM PANEL)
SELECT feature, pairs, equal_pairs, pairs >= 6 AND pairs = equal_pairs AS suspect FROM (
  SELECT unnest(['observed', 'lag_1m', 'leaked', 'partly']) AS feature,
    unnest([count(*) FILTER (observed IS NOT NULL AND target IS NOT NULL),
      count(*) FILTER (lag_1m IS NOT NULL AND target IS NOT NULL),
      count(*) FILTER (leaked IS NOT NULL AND target IS NOT NULL),
      count(*) FILTER (partly IS NOT NULL AND target IS NOT NULL)]) AS pairs,
    unnest([count(*) FILTER (observed = target), count(*) FILTER (lag_1m = target),
      count(*) FILTER (leaked = target), count(*) FILTER (partly = target)]) AS equal_pairs
  FROM F)""",
)
def leakage_canary(spark, d):
    panel = shapes.backtest_panel(spark, d).withColumns(
        {"leaked": F.col("target"), "partly": F.when(F.month("period_month") == 1, F.col("target"))}
    )
    return ck.leakage_canary(panel, "target", ["observed", "lag_1m", "leaked", "partly"])


@query(
    "v5_row_count",
    with_shapes("M") + " SELECT count(*) AS before, count(*) AS after, true AS same FROM M",
)
def row_count(spark, d):
    base = shapes.monthly_price(spark, d)
    joined = join_blocks(base, [monthly_fuel(spark, d)], ["period_month"], [["fuel"]])
    return ck.row_count_change(base, joined)


@query(
    "v6_drop_warmup",
    with_shapes("PANEL")
    + """ SELECT * FROM PANEL WHERE observed IS NOT NULL AND lag_1m IS NOT NULL AND lag_12m IS NOT NULL AND target IS NOT NULL""",
)
def drop_warmup(spark, d):
    return ck.drop_warmup(shapes.backtest_panel(spark, d), ["observed", "lag_1m", "lag_12m"], "target")


@query(
    "v8_observable_only",
    with_shapes("PANEL")
    + """ SELECT area, period_month, target FROM PANEL WHERE CAST(period_month + INTERVAL 1 MONTH AS DATE) <= DATE '1999-06-01'""",
)
def observable_only(spark, d):
    panel = shapes.backtest_panel(spark, d).select("area", "period_month", "target")
    return ck.observable_only(panel, "1999-06-01", 1)
