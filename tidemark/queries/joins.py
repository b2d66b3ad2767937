"""Joins on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.arithmetic import unit_price
from tidemark.operators import joins as j
from tidemark.operators.grids import exogenous_lag
from tidemark.plans import shapes
from tidemark.plans.monthly import price_block
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.queries.scalars import MONTHLY_FUEL, monthly_fuel
from tidemark.queries.tools import rounded
from tidemark.queries.windows import PANEL_SERIES, panel_series

_LAST_FUEL = """, B AS (SELECT * FROM MF QUALIFY row_number() OVER (
  PARTITION BY period_month ORDER BY fuel DESC) = 1)"""


@query(
    "j1_join_blocks",
    with_shapes("M", "FUEL")
    + MONTHLY_FUEL
    + _LAST_FUEL
    + " SELECT area, period_month, price, fuel, volume, amount FROM M LEFT JOIN B USING (period_month)",
)
def join_blocks(spark, d):
    return j.join_blocks(
        shapes.monthly_price(spark, d), [monthly_fuel(spark, d)], ["period_month"], [["fuel"]]
    )


#: short names of all fuels
NAMES = {"ECONOMY": "coal", "LARGE": "nuclear", "MEDIUM": "hydro", "PROMO": "lng", "SMALL": "solar", "STANDARD": "wind"}


def _lagged_sql(value: str) -> str:
    cells = ", ".join(f"max(CASE WHEN fuel = '{f}' THEN {value} END) AS {n}" for f, n in NAMES.items())
    lags = ", ".join(f"lag({n}) OVER (ORDER BY period_month) AS {n}" for n in NAMES.values())
    return f"""
{value}_w AS (SELECT period_month, {cells} FROM MF GROUP BY 1),
{value}_s AS (SELECT min(period_month) AS lo, max(period_month) AS hi FROM {value}_w),
{value}_g AS (
  SELECT CAST(g.t AS DATE) AS period_month, {value}_w.* EXCLUDE (period_month)
  FROM (SELECT unnest(generate_series(CAST(lo AS TIMESTAMP), hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS t FROM {value}_s) g
  LEFT JOIN {value}_w ON {value}_w.period_month = CAST(g.t AS DATE)),
{value}_l AS (SELECT period_month, {lags} FROM {value}_g)"""


def lagged_block(spark, d, value):
    monthly = monthly_fuel(spark, d)
    wide = monthly.groupBy("period_month").agg(
        *[F.max(F.when(F.col("fuel") == f, F.col(value))).alias(f"{value}_{n}") for f, n in NAMES.items()]
    )
    return exogenous_lag(wide, [f"{value}_{n}" for n in NAMES.values()])


@query(
    "j2_price_block",
    with_shapes("FUEL")
    + MONTHLY_FUEL
    + ","
    + _lagged_sql("volume")
    + ","
    + _lagged_sql("amount")
    + " SELECT period_month, "
    + ", ".join(f"round(CASE WHEN v.{n} > 0 THEN a.{n} / v.{n} END / 1000, 9) AS trade_price_{n}_lag_1m" for n in NAMES.values())
    + " FROM volume_l v JOIN amount_l a USING (period_month)",
)
def price_block_query(spark, d):
    pairs = {f"trade_price_{n}_lag_1m": (f"amount_{n}_lag_1m", f"volume_{n}_lag_1m") for n in NAMES.values()}
    block = price_block(lagged_block(spark, d, "volume"), lagged_block(spark, d, "amount"), pairs)
    return rounded(block, 9)


@query(
    "j3_broadcast_yearly",
    with_shapes("M")
    + """, Y AS (SELECT year(l_shipdate) AS y, sum(l_quantity) AS quantity,
  CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS revenue FROM lineitem GROUP BY 1)
SELECT area, period_month, quantity AS quantity_lag_1y, revenue AS revenue_lag_1y
FROM M LEFT JOIN Y ON Y.y = year(period_month) - 1""",
)
def broadcast_yearly(spark, d):
    yearly = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("period_year")).agg(
        F.sum("l_quantity").alias("quantity"), shapes.exact_sum("l_extendedprice").alias("revenue")
    )
    months = shapes.monthly_price(spark, d).drop("price")
    return j.broadcast_yearly(months, yearly, ["quantity", "revenue"])


ASOF = """, MONTHS AS (SELECT DISTINCT period_month FROM M),
LATEST_Q AS (SELECT period_month, max(quote_date) AS quote_date FROM MONTHS JOIN CURVE ON quote_date <= last_day(period_month) GROUP BY 1)"""


@query("j4_asof_latest", with_shapes("M", "CURVE") + ASOF + " SELECT * FROM LATEST_Q")
def asof_latest(spark, d):
    return j.asof_latest(shapes.monthly_price(spark, d), shapes.futures_curve(spark, d))


@query(
    "j5_curve_points",
    with_shapes("M", "CURVE")
    + ASOF
    + """, P AS (SELECT a.period_month,
  max(CASE WHEN contract_month = CAST(a.period_month + INTERVAL 1 MONTH AS DATE) THEN settle END) AS p1,
  max(CASE WHEN contract_month = CAST(a.period_month + INTERVAL 2 MONTH AS DATE) THEN settle END) AS p2
  FROM LATEST_Q a LEFT JOIN CURVE USING (quote_date) GROUP BY 1)
SELECT period_month, p1 AS forward_1m, p2 AS forward_2m,
  round(CASE WHEN p1 <> 0 AND p2 <> 0 THEN (p2 - p1) / p1 END, 9) AS forward_slope_1_2 FROM P""",
)
def curve_points(spark, d):
    curve = shapes.futures_curve(spark, d)
    asof = j.asof_latest(shapes.monthly_price(spark, d), curve)
    return j.curve_points(asof, curve, "settle").withColumn("forward_slope_1_2", F.round("forward_slope_1_2", 9))


@query(
    "j6_align_outer",
    with_shapes("M")
    + " SELECT period_month, "
    + ", ".join(f"max(CASE WHEN area = '{a}' THEN price END) AS {n}" for n, a in PANEL_SERIES.items())
    + " FROM M WHERE area IN ('" + "', '".join(PANEL_SERIES.values()) + "') GROUP BY 1",
)
def align_outer(spark, d):
    return j.align_outer(list(panel_series(spark, d).values()))


@query(
    "j7_common_keys",
    with_shapes("FUEL")
    + MONTHLY_FUEL
    + ","
    + _lagged_sql("volume")
    + ","
    + _lagged_sql("amount")
    + f""" SELECT period_month FROM volume_l WHERE coalesce({', '.join(NAMES.values())}) IS NOT NULL
INTERSECT SELECT period_month FROM amount_l WHERE coalesce({', '.join(NAMES.values())}) IS NOT NULL""",
)
def common_keys(spark, d):
    return j.common_keys(lagged_block(spark, d, "volume"), lagged_block(spark, d, "amount"), ["period_month"])


@query(
    "j8_missing_keys",
    with_shapes("FUEL", "M")
    + " SELECT DISTINCT CAST(date_trunc('month', trade_date) AS DATE) AS period_month FROM FUEL WHERE "
    "CAST(date_trunc('month', trade_date) AS DATE) NOT IN (SELECT period_month FROM M)",
)
def missing_keys(spark, d):
    return j.missing_keys(monthly_fuel(spark, d), shapes.monthly_price(spark, d), ["period_month"])


SCORES = """, SC AS (SELECT model, version, avg(abs(y_true - y_pred)) AS mae FROM PRED GROUP BY 1, 2)"""


def scores(spark, d):
    return shapes.predictions(spark, d).groupBy("model", "version").agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")
    )


@query(
    "j9_vs_baseline",
    with_shapes("PRED")
    + SCORES
    + """ SELECT model, version, round(mae, 4) AS mae, round(b, 4) AS baseline_mae, round(b - mae, 4) AS improvement_vs_baseline
FROM SC LEFT JOIN (SELECT version, mae AS b FROM SC WHERE model = 'persistence_monthly') USING (version)""",
)
def vs_baseline(spark, d):
    return rounded(j.vs_baseline(scores(spark, d), "mae", "persistence_monthly"), 4)


@query(
    "j10_stability",
    with_shapes("PRED")
    + SCORES
    + """ SELECT model, round(a.mae, 4) AS mae_a, round(b.mae, 4) AS mae_b, round(b.mae - a.mae, 3) AS delta_b_minus_a,
  round((a.mae + b.mae) / 2, 3) AS mean_mae
FROM (SELECT * FROM SC WHERE version = 1999) a JOIN (SELECT * FROM SC WHERE version = 2000) b USING (model)""",
)
def stability(spark, d):
    out = j.stability(scores(spark, d), 1999, 2000)
    return out.withColumns({c: F.round(c, 4) for c in ("mae_a", "mae_b")})


@query(
    "j11_compare_tags",
    with_shapes("PRED")
    + SCORES
    + """, T AS (SELECT a.model, a.mae AS before, m.mae AS middle, b.mae AS after
  FROM (SELECT * FROM SC WHERE version = 1998) a JOIN (SELECT * FROM SC WHERE version = 2000) b USING (model)
  LEFT JOIN (SELECT * FROM SC WHERE version = 1999 AND model <> 'naive_lag_1m') m USING (model))
SELECT model, round(before, 4) AS before, round(middle, 4) AS middle, round(after, 4) AS after,
  round(after - before, 3) AS change, round(round(after - before, 3) / before * 100, 2) AS change_pct FROM T""",
)
def compare_tags(spark, d):
    s = scores(spark, d)
    middle = s.where("version = 1999 AND model <> 'naive_lag_1m'")
    out = j.compare_tags(s.where("version = 1998"), s.where("version = 2000"), middle)
    return out.withColumns({c: F.round(c, 4) for c in ("before", "middle", "after")})


@query(
    "j12_lookup_region",
    """SELECT c_custkey, n_name, n_regionkey AS cell FROM customer
LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup_region(spark, d):
    grid = read_table(spark, d, "nation").select(
        "n_nationkey", "n_name", F.col("n_regionkey").alias("cell")
    )
    customers = read_table(spark, d, "customer").select("c_custkey", "c_nationkey")
    return j.lookup_region(customers, "c_nationkey", grid, "n_nationkey").drop("c_nationkey")
