"""Grids, lags, rolling statistics and revisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import grids as g
from tidemark.operators import revisions as r
from tidemark.plans import shapes
from tidemark.plans.panel import panel_features
from tidemark.plans.shapes import with_shapes
from tidemark.queries.registry import query
from tidemark.queries.tools import rounded

HGRID = """
HSPAN AS (SELECT area, min(interval_end) AS lo, max(interval_end) AS hi FROM H GROUP BY 1),
HG AS (
  SELECT g.area, g.t AS interval_end, H.price, H.demand
  FROM (SELECT area, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS t FROM HSPAN) g
  LEFT JOIN H ON H.area = g.area AND H.interval_end = g.t)"""

H0GRID = HGRID.replace("HSPAN", "H0SPAN").replace("HG AS", "H0G AS").replace("H.", "H0.").replace(
    "FROM H ", "FROM H0 ").replace("JOIN H ", "JOIN H0 ")

MGGRID = """
MGSPAN AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM MG GROUP BY 1),
MGG AS (
  SELECT g.area, CAST(g.t AS DATE) AS period_month, MG.price
  FROM (SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t
        FROM MGSPAN) g
  LEFT JOIN MG ON MG.area = g.area AND MG.period_month = CAST(g.t AS DATE))"""


def full_window(agg: str, n: int, name: str, order: str, column: str = "price", digits: int = 4) -> str:
    frame = f"(PARTITION BY area ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    if agg in ("min", "max"):
        # an observed value comes through as it is
        return f"CASE WHEN count({column}) OVER {frame} = {n} THEN {agg}({column}) OVER {frame} END AS {name}"
    return (
        f"round(CASE WHEN count({column}) OVER {frame} = {n} THEN {agg}({column}) OVER {frame} END, "
        f"{digits}) AS {name}"
    )


@query("w1_hourly_grid", with_shapes("H") + "," + HGRID + " SELECT * FROM HG")
def hourly_grid(spark, d):
    return g.hourly_grid(shapes.hourly_price(spark, d), ["area"])


@query(
    "w2_monthly_grid",
    with_shapes("MG")
    + """, SPAN AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM MG GROUP BY 1)
SELECT g.area, CAST(g.t AS DATE) AS period_month, MG.price
FROM (SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), hi + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS t
      FROM SPAN) g
LEFT JOIN MG ON MG.area = g.area AND MG.period_month = CAST(g.t AS DATE)""",
)
def monthly_grid(spark, d):
    return g.monthly_grid(shapes.monthly_price_with_gaps(spark, d), ["area"], extend=2)


@query(
    "w3_expected_hours",
    with_shapes("H")
    + """, D AS (SELECT DISTINCT CAST(interval_end - INTERVAL 1 HOUR AS DATE) AS trade_date FROM H)
SELECT trade_date, CAST(trade_date AS TIMESTAMP) + to_hours(CAST(h AS INTEGER)) AS interval_end
FROM D, range(1, 25) r(h)""",
)
def expected_hours(spark, d):
    hours = shapes.hourly_price(spark, d)
    dated = hours.withColumn("trade_date", (F.col("interval_end") - F.expr("interval 1 hour")).cast("date"))
    return g.expected_hours(dated, "trade_date")


@query(
    "w4_lag_hourly",
    with_shapes("H")
    + ","
    + HGRID
    + " SELECT area, interval_end, "
    + ", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}h" for k in g.HOURLY_PRICE_LAGS)
    + ", "
    + ", ".join(f"lag(demand, {k}) OVER w AS demand_lag_{k}h" for k in g.HOURLY_DEMAND_LAGS)
    + " FROM HG WINDOW w AS (PARTITION BY area ORDER BY interval_end)",
)
def lag_hourly(spark, d):
    grid = g.hourly_grid(shapes.hourly_price(spark, d), ["area"])
    specs = g.lag_specs("price", g.HOURLY_PRICE_LAGS, "h") + g.lag_specs("demand", g.HOURLY_DEMAND_LAGS, "h")
    return g.add_lags(grid, ["area"], "interval_end", specs).drop("price", "demand")


@query(
    "w5_lag_monthly",
    with_shapes("MG")
    + ","
    + MGGRID
    + " SELECT area, period_month, "
    + ", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}m" for k in g.MONTHLY_LAGS)
    + " FROM MGG WINDOW w AS (PARTITION BY area ORDER BY period_month)",
)
def lag_monthly(spark, d):
    grid = g.monthly_grid(shapes.monthly_price_with_gaps(spark, d), ["area"])
    specs = g.lag_specs("price", g.MONTHLY_LAGS, "m")
    return g.add_lags(grid, ["area"], "period_month", specs).drop("price")


@query(
    "w6_roll_hourly",
    with_shapes("H")
    + ","
    + HGRID
    + " SELECT area, interval_end, "
    + ", ".join(
        full_window(a, 24, f"price_rolling_24h_{n}", "interval_end")
        for a, n in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))
    )
    + " FROM HG",
)
def roll_hourly(spark, d):
    grid = g.hourly_grid(shapes.hourly_price(spark, d), ["area"])
    specs = g.roll_specs("price", [(24, a) for a in ("mean", "std", "min", "max")], "h")
    out = g.add_rolls(grid, ["area"], "interval_end", specs).drop("price", "demand")
    return rounded(out, 4, ("price_rolling_24h_min", "price_rolling_24h_max"))


@query(
    "w6_roll_hourly_week",
    with_shapes("H0")
    + ","
    + H0GRID
    + " SELECT area, interval_end, "
    + ", ".join(
        full_window(a, 168, f"price_rolling_168h_{n}", "interval_end")
        for a, n in (("avg", "mean"), ("stddev_samp", "std"))
    )
    + " FROM H0G",
)
def roll_hourly_week(spark, d):
    grid = g.hourly_grid(shapes.hourly_price(spark, d, by_area=False), ["area"])
    specs = g.roll_specs("price", [(168, "mean"), (168, "std")], "h")
    return rounded(g.add_rolls(grid, ["area"], "interval_end", specs).drop("price", "demand"), 4)


@query(
    "w7_roll_monthly",
    with_shapes("M", "MGRID")
    + " SELECT area, period_month, "
    + ", ".join(
        full_window({"mean": "avg", "std": "stddev_samp"}[a], n, f"price_rolling_{n}m_{a}", "period_month")
        for n, a in g.MONTHLY_ROLLS
    )
    + " FROM MGRID",
)
def roll_monthly(spark, d):
    grid = g.monthly_grid(shapes.monthly_price(spark, d), ["area"])
    specs = g.roll_specs("price", g.MONTHLY_ROLLS, "m")
    return rounded(g.add_rolls(grid, ["area"], "period_month", specs).drop("price"), 4)


@query(
    "w8_lead_target",
    with_shapes("MG")
    + ","
    + MGGRID
    + """ SELECT area, period_month, price, lead(price, 1) OVER w AS target_1m, lead(price, 3) OVER w AS target_3m
FROM MGG WINDOW w AS (PARTITION BY area ORDER BY period_month)""",
)
def lead_target(spark, d):
    grid = g.monthly_grid(shapes.monthly_price_with_gaps(spark, d), ["area"])
    one = g.lead_target(grid, ["area"], "period_month", "price", 1, "target_1m")
    return g.lead_target(one, ["area"], "period_month", "price", 3, "target_3m")


@query(
    "w8_lead_target_hourly",
    with_shapes("H")
    + ","
    + HGRID
    + """ SELECT area, interval_end, price, lead(price, 24) OVER w AS target
FROM HG WINDOW w AS (PARTITION BY area ORDER BY interval_end)""",
)
def lead_target_hourly(spark, d):
    grid = g.hourly_grid(shapes.hourly_price(spark, d).drop("demand"), ["area"])
    return g.lead_target(grid, ["area"], "interval_end", "price", 24)


@query(
    "w9_exogenous_lag",
    with_shapes("FUEL")
    + """, A AS (
  SELECT fuel, CAST(date_trunc('month', trade_date) AS DATE) AS period_month,
         avg(volume) AS volume, avg(amount) AS amount FROM FUEL GROUP BY 1, 2),
S AS (SELECT fuel, min(period_month) AS lo, max(period_month) AS hi FROM A GROUP BY 1),
G AS (
  SELECT g.fuel, CAST(g.t AS DATE) AS period_month, volume, amount
  FROM (SELECT fuel, unnest(generate_series(CAST(lo AS TIMESTAMP), hi + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS t
        FROM S) g
  LEFT JOIN A ON A.fuel = g.fuel AND A.period_month = CAST(g.t AS DATE))
SELECT fuel, period_month, round(lag(volume) OVER w, 6) AS volume_lag_1m, round(lag(amount) OVER w, 4) AS amount_lag_1m
FROM G WINDOW w AS (PARTITION BY fuel ORDER BY period_month)""",
)
def exogenous_lag(spark, d):
    monthly = shapes.fuel_trades(spark, d).withColumn("period_month", shapes.month_of("trade_date"))
    out = g.exogenous_lag(monthly, ["volume", "amount"], ["fuel"])
    return out.select(
        "fuel", "period_month", F.round("volume_lag_1m", 6).alias("volume_lag_1m"),
        F.round("amount_lag_1m", 4).alias("amount_lag_1m"),
    )


@query(
    "w10_price_lags",
    with_shapes("MG")
    + """, SPAN AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM MG GROUP BY 1),
G AS (
  SELECT g.area, CAST(g.t AS DATE) AS period_month, MG.price
  FROM (SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), hi + INTERVAL 2 MONTH, INTERVAL 1 MONTH)) AS t
        FROM SPAN) g
  LEFT JOIN MG ON MG.area = g.area AND MG.period_month = CAST(g.t AS DATE)),
L AS (
  SELECT area, period_month, lag(price, 1) OVER w AS l1, lag(price, 2) OVER w AS l2
  FROM G WINDOW w AS (PARTITION BY area ORDER BY period_month))
SELECT area, period_month, l1 AS price_lag_1m, l2 AS price_lag_2m,
       round((l1 - l2) / nullif(l2, 0), 9) AS price_chg_1m_lag_1m FROM L""",
)
def price_lags(spark, d):
    out = g.price_lags(shapes.monthly_price_with_gaps(spark, d), "price", ["area"])
    return out.withColumn("price_chg_1m_lag_1m", F.round("price_chg_1m_lag_1m", 9))


PANEL_SERIES = {"gas": "1-URGENT", "oil": "2-HIGH", "fx": "3-MEDIUM", "coal": "4-NOT SPECIFIED", "power": "5-LOW"}


def panel_series(spark, d):
    prices = shapes.monthly_price(spark, d)
    return {
        name: prices.where(F.col("area") == area).select("period_month", F.col("price").alias(name))
        for name, area in PANEL_SERIES.items()
    }


def _panel_sql() -> str:
    series = ", ".join(
        f"max(CASE WHEN area = '{area}' THEN price END) AS {name}" for name, area in PANEL_SERIES.items()
    )
    areas = ", ".join(f"'{a}'" for a in PANEL_SERIES.values())
    parts = []
    for name in PANEL_SERIES:
        parts += [f"lag({name}, {k}) OVER w AS {name}_lag{k}" for k in (1, 2, 3, 6, 12)]
        for n, agg, label in ((3, "avg", "mean"), (6, "avg", "mean"), (6, "stddev_samp", "std")):
            frame = f"(ORDER BY period_month ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
            parts.append(
                f"round(CASE WHEN count({name}) OVER {frame} = {n} THEN {agg}({name}) OVER {frame} END, 4) "
                f"AS {name}_roll{n}_{label}"
            )
        parts.append(
            f"round((lag({name}, 1) OVER w - lag({name}, 2) OVER w) / lag({name}, 2) OVER w, 9) AS {name}_ret1_lag1"
        )
    features = ",\n".join(parts)
    return (
        with_shapes("M")
        + f""", P AS (
  SELECT period_month, {series} FROM M WHERE area IN ({areas}) GROUP BY 1),
F AS (SELECT period_month, {features},
  CAST(month(period_month) AS INTEGER) AS month,
  round(sin(2 * pi() * month(period_month) / 12), 9) AS month_sin,
  round(cos(2 * pi() * month(period_month) / 12), 9) AS month_cos,
  CAST(quarter(period_month) AS INTEGER) AS quarter,
  round(lag(gas, 1) OVER w / lag(oil, 1) OVER w, 9) AS ratio_lag1,
  lead(gas, 1) OVER w AS target
FROM P WINDOW w AS (ORDER BY period_month))
SELECT * FROM F WHERE NOT (F IS NULL) AND """
        + " AND ".join(
            f"{c} IS NOT NULL"
            for c in ["target", "ratio_lag1"]
            + [f"{n}_lag12" for n in PANEL_SERIES]
            + [f"{n}_roll6_std" for n in PANEL_SERIES]
            + [f"{n}_lag{k}" for n in PANEL_SERIES for k in (1, 2, 3, 6)]
        )
    )


@query("w11_panel_features", _panel_sql())
def panel(spark, d):
    out = panel_features(panel_series(spark, d), target="gas", ratio=("gas", "oil"), horizon=1).table
    digits = {
        c: 9 if c.startswith("month_") or c.endswith("_ret1_lag1") or c == "ratio_lag1" else 4
        for c in out.columns
        if "_roll" in c or c.startswith("month_") or c.endswith("_ret1_lag1") or c == "ratio_lag1"
    }
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


RANKED = """, R AS (
  SELECT *, row_number() OVER (PARTITION BY period_month, area
    ORDER BY source_priority, collected_at DESC NULLS LAST, source_file_sha256, parsed_path) AS rn
  FROM SNAP)"""


@query(
    "w12_dedup_revisions",
    with_shapes("SNAP") + RANKED + " SELECT * EXCLUDE (rn) FROM R WHERE rn = 1",
)
def dedup_revisions(spark, d):
    return r.dedup_revisions(shapes.revisions(spark, d), ["period_month", "area"])


@query(
    "w13_dedup_log",
    with_shapes("SNAP")
    + RANKED
    + """, L AS (
  SELECT *, count(*) OVER (PARTITION BY period_month, area) AS n,
         min(source_priority) OVER (PARTITION BY period_month, area) AS best
  FROM R)
SELECT period_month, area, price, source_priority, collected_at, source_file_sha256, parsed_path,
       CASE WHEN rn = 1 THEN 'selected' ELSE 'dropped' END AS role,
       CASE WHEN rn = 1 THEN '' WHEN source_priority > best THEN 'lower_priority'
            ELSE 'older_revision' END AS reason
FROM L WHERE n > 1""",
)
def dedup_log(spark, d):
    return r.dedup_log(shapes.revisions(spark, d), ["period_month", "area"])


@query(
    "w14_keep_last",
    with_shapes("SNAP")
    + """, R AS (SELECT *, row_number() OVER (PARTITION BY period_month, area
  ORDER BY collected_at DESC NULLS LAST, parsed_path DESC NULLS LAST) AS rn FROM SNAP)
SELECT * EXCLUDE (rn) FROM R WHERE rn = 1""",
)
def keep_last(spark, d):
    return r.keep_last(shapes.revisions(spark, d), ["period_month", "area"], ["collected_at", "parsed_path"])


@query(
    "w15_step_diff",
    with_shapes("H")
    + """ SELECT area, interval_end,
  date_diff('second', lag(interval_end) OVER (PARTITION BY area ORDER BY interval_end), interval_end) AS step_seconds
FROM H""",
)
def step_diff(spark, d):
    return g.step_diff(shapes.hourly_price(spark, d).select("area", "interval_end"), ["area"], "interval_end")


@query(
    "w16_top_k_per_group",
    """WITH R AS (SELECT o_custkey, o_orderkey, o_totalprice, CAST(row_number() OVER (
  PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders)
SELECT * FROM R WHERE rank <= 3""",
)
def top_k(spark, d):
    orders = shapes.read_table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return r.top_k_per_group(
        orders, ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 3
    )


@query(
    "w17_best_row",
    with_shapes("PRED")
    + """, S AS (SELECT model, version, avg(abs(y_true - y_pred)) AS mae FROM PRED GROUP BY 1, 2)
SELECT model, version, round(mae, 4) AS mae FROM S ORDER BY mae, model, version LIMIT 1""",
)
def best_row(spark, d):
    scores = shapes.predictions(spark, d).groupBy("model", "version").agg(
        F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae")
    )
    return r.best_row(scores, "mae", ties=["model", "version"]).withColumn("mae", F.round("mae", 4))


@query(
    "w18_expanding_stats",
    with_shapes("PANEL")
    + """, B AS (SELECT area, period_month, observed AS x, target AS y FROM PANEL WHERE observed IS NOT NULL AND target IS NOT NULL)
SELECT area, period_month, x, y, count(*) OVER w AS n_past, round(avg(x) OVER w, 5) AS mean_x, round(avg(y) OVER w, 5) AS mean_y,
  round(covar_pop(x, x) OVER w, 1) AS cov_x_x, round(covar_pop(x, y) OVER w, 1) AS cov_x_y, round(covar_pop(y, y) OVER w, 1) AS cov_y_y
FROM B WINDOW w AS (PARTITION BY area ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
)
def expanding_stats(spark, d):
    panel = shapes.backtest_panel(spark, d).na.drop(subset=["observed", "target"]).select(
        "area", "period_month", F.col("observed").alias("x"), F.col("target").alias("y")
    )
    out = g.expanding_stats(panel, ["x", "y"], ["area"], "period_month")
    digits = {"mean_x": 5, "mean_y": 5, "cov_x_x": 1, "cov_x_y": 1, "cov_y_y": 1}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})
