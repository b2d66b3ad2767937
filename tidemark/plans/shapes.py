"""Stand-in series built from the order, item and event tables.

Money in these tables has whole cents, so averages are taken over exact integer sums: the
result does not depend on the order in which partial sums are merged or a task is retried.
Each shape has its SQL twin in ``SHAPE_SQL``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.grids import LagSpec, add_lags, lead_target, monthly_grid

MODEL_COLUMNS = {
    "persistence_monthly": "observed",
    "naive_lag_1m": "lag_1m",
    "seasonal_naive_lag_12m": "lag_12m",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def exact_mean(value: str) -> Column:
    """Mean of a two-decimal amount, from an exact sum of cents."""
    cents = F.sum(F.round(F.col(value) * 100).cast("bigint")).cast("double")
    return cents / (F.count(F.col(value)) * 100).cast("double")


def exact_sum(value: str) -> Column:
    return F.sum(F.round(F.col(value) * 100).cast("bigint")).cast("double") / 100


def month_of(col: str) -> Column:
    return F.trunc(F.col(col), "month")


def monthly_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, period_month, price: one cell per order priority and month."""
    orders = read_table(spark, sf_dir, "orders")
    return orders.groupBy(
        F.col("o_orderpriority").alias("area"), month_of("o_orderdate").alias("period_month")
    ).agg(exact_mean("o_totalprice").alias("price"))


def monthly_price_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the orders of March booked in April: a gap each year, as the gap rules need, and no order lost."""
    orders = read_table(spark, sf_dir, "orders")
    month = month_of("o_orderdate")
    booked = F.when(F.month(month) == 3, F.add_months(month, 1)).otherwise(month)
    return orders.groupBy(F.col("o_orderpriority").alias("area"), booked.alias("period_month")).agg(
        exact_mean("o_totalprice").alias("price")
    )


def hourly_price(spark: SparkSession, sf_dir: str, by_area: bool = True) -> DataFrame:
    """area, interval_end, price, demand from the event stream."""
    events = read_table(spark, sf_dir, "events")
    area = F.col("event_type") if by_area else F.lit("all")
    hour = (F.date_trunc("hour", "ts") + F.expr("interval 1 hour")).cast("timestamp_ntz")
    return events.groupBy(area.alias("area"), hour.alias("interval_end")).agg(
        exact_mean("value").alias("price"), F.count("*").alias("demand")
    )


def fuel_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trade_date, fuel, volume, amount: one row per item."""
    items = read_table(spark, sf_dir, "lineitem")
    parts = read_table(spark, sf_dir, "part")
    return items.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_shipdate").cast("date").alias("trade_date"),
        F.col("p_type").alias("fuel"),
        F.col("l_quantity").alias("volume"),
        F.col("l_extendedprice").alias("amount"),
    )


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many restatements per (period_month, area) with revision metadata."""
    return read_table(spark, sf_dir, "orders").select(
        month_of("o_orderdate").alias("period_month"),
        F.col("o_orderpriority").alias("area"),
        F.col("o_totalprice").alias("price"),
        (1 + F.col("o_orderkey") % 2).cast("int").alias("source_priority"),
        F.expr("timestampadd(MICROSECOND, o_orderkey, o_orderdate)").alias("collected_at"),
        F.md5(F.col("o_orderkey").cast("string")).alias("source_file_sha256"),
        F.col("o_orderkey").cast("string").alias("parsed_path"),
    )


def futures_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quote_date, contract_month, settle with one row per quote and contract."""
    return (
        read_table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderdate").cast("date").alias("quote_date"),
            F.expr("add_months(trunc(o_orderdate, 'month'), cast(1 + o_orderkey % 3 as int))").alias(
                "contract_month"
            ),
        )
        .agg(exact_mean("o_totalprice").alias("settle"))
    )


def backtest_panel(spark: SparkSession, sf_dir: str, horizon: int = 1) -> DataFrame:
    """area, period_month, observed, lag_1m, lag_12m, target on the monthly grid."""
    grid = monthly_grid(monthly_price(spark, sf_dir), ["area"], "period_month")
    lagged = add_lags(
        grid, ["area"], "period_month",
        [LagSpec("price", 1, "lag_1m"), LagSpec("price", 12, "lag_12m")],
    )
    return lead_target(lagged, ["area"], "period_month", "price", horizon, "target").withColumnRenamed(
        "price", "observed"
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """area, period_month, version, observed, y_true, model, y_pred: three naive models."""
    panel = backtest_panel(spark, sf_dir).na.drop(
        subset=["target", *MODEL_COLUMNS.values()]
    )
    wide = panel.select(
        "area",
        "period_month",
        F.year("period_month").alias("version"),
        F.col("observed").alias("base"),
        F.col("target").alias("y_true"),
        *[F.col(column).alias(model) for model, column in MODEL_COLUMNS.items()],
    )
    return wide.unpivot(
        ["area", "period_month", "version", "base", "y_true"], list(MODEL_COLUMNS), "model", "y_pred"
    )


SHAPE_SQL = {
    "M": """
M AS (
  SELECT o_orderpriority AS area, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) * 100 AS DOUBLE) AS price
  FROM orders GROUP BY 1, 2)""",
    "MG": """
MG AS (
  SELECT o_orderpriority AS area, CAST(CASE WHEN month(o_orderdate) = 3 THEN date_trunc('month', o_orderdate) + INTERVAL 1 MONTH
           ELSE date_trunc('month', o_orderdate) END AS DATE) AS period_month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) * 100 AS DOUBLE) AS price
  FROM orders GROUP BY 1, 2)""",
    "H": """
H AS (
  SELECT event_type AS area, date_trunc('hour', ts) + INTERVAL 1 HOUR AS interval_end,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) * 100 AS DOUBLE) AS price,
         count(*) AS demand
  FROM events GROUP BY 1, 2)""",
    "H0": """
H0 AS (
  SELECT 'all' AS area, date_trunc('hour', ts) + INTERVAL 1 HOUR AS interval_end,
         CAST(sum(CAST(round(value * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) * 100 AS DOUBLE) AS price,
         count(*) AS demand
  FROM events GROUP BY 1, 2)""",
    "FUEL": """
FUEL AS (
  SELECT CAST(l_shipdate AS DATE) AS trade_date, p_type AS fuel, l_quantity AS volume,
         l_extendedprice AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "SNAP": """
SNAP AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month, o_orderpriority AS area,
         o_totalprice AS price, CAST(1 + o_orderkey % 2 AS INTEGER) AS source_priority,
         o_orderdate + to_microseconds(o_orderkey) AS collected_at,
         md5(CAST(o_orderkey AS VARCHAR)) AS source_file_sha256,
         CAST(o_orderkey AS VARCHAR) AS parsed_path
  FROM orders)""",
    "CURVE": """
CURVE AS (
  SELECT CAST(o_orderdate AS DATE) AS quote_date,
         CAST(date_trunc('month', o_orderdate) + to_months(CAST(1 + o_orderkey % 3 AS INTEGER)) AS DATE)
           AS contract_month,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE)
           / CAST(count(*) * 100 AS DOUBLE) AS settle
  FROM orders GROUP BY 1, 2)""",
    "MGRID": """
MSPAN AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM M GROUP BY 1),
MGRID AS (
  SELECT s.area, CAST(g.t AS DATE) AS period_month, M.price
  FROM (SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t
        FROM MSPAN) g
  JOIN MSPAN s ON s.area = g.area
  LEFT JOIN M ON M.area = g.area AND M.period_month = CAST(g.t AS DATE))""",
    "PANEL": """
PANEL AS (
  SELECT area, period_month, price AS observed,
         lag(price, 1) OVER w AS lag_1m, lag(price, 12) OVER w AS lag_12m,
         lead(price, 1) OVER w AS target
  FROM MGRID WINDOW w AS (PARTITION BY area ORDER BY period_month))""",
    "PRED": """
PRED0 AS (
  SELECT area, period_month, CAST(year(period_month) AS INTEGER) AS version, observed AS base,
         target AS y_true, observed, lag_1m, lag_12m
  FROM PANEL WHERE observed IS NOT NULL AND lag_1m IS NOT NULL AND lag_12m IS NOT NULL
    AND target IS NOT NULL),
PRED AS (
  SELECT area, period_month, version, base, y_true, 'persistence_monthly' AS model, observed AS y_pred FROM PRED0
  UNION ALL
  SELECT area, period_month, version, base, y_true, 'naive_lag_1m', lag_1m FROM PRED0
  UNION ALL
  SELECT area, period_month, version, base, y_true, 'seasonal_naive_lag_12m', lag_12m FROM PRED0)""",
}

_NEEDS = {
    "MGRID": ["M"], "PANEL": ["M", "MGRID"], "PRED": ["M", "MGRID", "PANEL"],
}


def with_shapes(*names: str) -> str:
    """``WITH`` clause holding the named shapes and what they need, in order."""
    ordered: list[str] = []
    for name in names:
        for part in [*_NEEDS.get(name, []), name]:
            if part not in ordered:
                ordered.append(part)
    return "WITH" + ",".join(SHAPE_SQL[n] for n in ordered)
