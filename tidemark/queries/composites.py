"""The two feature tables as a whole."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import aggregates as a
from tidemark.operators import joins as j
from tidemark.operators.grids import MONTHLY_LAGS, MONTHLY_ROLLS, price_lags
from tidemark.operators.models import features_by_name
from tidemark.plans import hourly, monthly, shapes
from tidemark.plans.leaderboard import NAIVE, naive_leaderboard
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries import aggregates as qa
from tidemark.queries.registry import ORACLES, query
from tidemark.queries.tools import rounded
from tidemark.queries.windows import H0GRID, RANKED, full_window

SETTLED = ["nuclear", "lng"]


def monthly_inputs(spark, d) -> monthly.MonthlyInputs:
    # the blocks share the aggregated months: their exchange is planned once and reused
    named = qa.named_fuel(spark, d)
    volume = a.trade_mix(named, "volume", "fuel", "transaction_volume", "mwh", qa.RENEWABLE, single_renewable=None)
    amount = a.trade_mix(named, "amount", "fuel", "transaction_amount", "krw", qa.RENEWABLE, single_renewable=None)
    total = qa.with_total(named)
    yearly = read_table(spark, d, "lineitem").groupBy(F.year("l_shipdate").alias("period_year")).agg(
        F.sum("l_quantity").alias("capacity_yearly_total_mw")
    )
    prices = shapes.monthly_price(spark, d)
    months = prices.select("period_month").distinct()
    gas = prices.where("area = '1-URGENT'").select("period_month", F.col("price").alias("gas_price"))
    curve = shapes.futures_curve(spark, d)
    trade_prices = {
        f"trade_price_{n}_lag_1m": (f"transaction_amount_{n}_krw_lag_1m", f"transaction_volume_{n}_mwh_lag_1m")
        for n in ("lng", "nuclear", "coal_total", "renewable_total")
    }
    return monthly.MonthlyInputs(
        revisions=shapes.revisions(spark, d),
        settlement=named.select("period_month", "fuel", (F.col("amount") / F.col("volume")).alias("price")),
        settlement_categories=SETTLED,
        blocks={
            "capacity_fuel": a.capacity_mix(total, "volume", "fuel", ["nuclear", "lng", "total"], qa.RENEWABLE),
            "capacity_type": a.capacity_type_mix(
                total, "volume", "fuel", qa.TYPE_GROUPS, qa.TYPE_SINGLES, "total", qa.TYPE_SHARES
            ),
            "capacity_yearly": j.broadcast_yearly(months, yearly, ["capacity_yearly_total_mw"]),
            "transaction_volume": volume,
            "transaction_amount": amount,
            "transaction_price": monthly.price_block(volume, amount, trade_prices),
            "gas_price": price_lags(gas, "gas_price"),
            "forward": j.curve_points(j.asof_latest(months, curve), curve, "settle"),
            "daily": a.daily_price_lags(qa.daily_close(spark, d), "close"),
        },
    )


def _lagged(prefix: str, current: str, columns: list[str], extend: int = 1) -> str:
    """CTEs that put CTE ``current`` on its month grid and lag every column by one month."""
    cells = ", ".join(f"lag({c}) OVER (ORDER BY period_month) AS {c}_lag_1m" for c in columns)
    return f"""
{prefix}_s AS (SELECT min(period_month) AS a, max(period_month) AS b FROM {current}),
{prefix}_g AS (SELECT CAST(g.t AS DATE) AS period_month, c.* EXCLUDE (period_month) FROM (
  SELECT unnest(generate_series(CAST(a AS TIMESTAMP), b + INTERVAL {extend} MONTH, INTERVAL 1 MONTH)) AS t FROM {prefix}_s) g
  LEFT JOIN {current} c ON c.period_month = CAST(g.t AS DATE)),
{prefix} AS (SELECT period_month, {cells} FROM {prefix}_g)"""


def _current(prefix: str, columns: dict[str, str], wide: str) -> str:
    return f"{prefix}_c AS (SELECT period_month, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + f" FROM {wide})"


_VALUES = list(qa.FUEL_NAMES.values())


def _wide(name: str, value: str) -> str:
    cells = ", ".join(f"sum(CASE WHEN fuel = '{v}' THEN {value} END) AS {v}" for v in _VALUES)
    return f"{name} AS (SELECT period_month, {cells}, sum({value}) AS total FROM NF GROUP BY 1)"


_CAL = """CAST(year(period_month) AS INTEGER) AS year, CAST(month(period_month) AS INTEGER) AS month,
  CAST(quarter(period_month) AS INTEGER) AS quarter, month(period_month) IN (6, 7, 8) AS is_summer,
  month(period_month) IN (12, 1, 2) AS is_winter, month(period_month) IN (6, 7, 8, 12, 1, 2) AS is_peak_season,
  sin(2 * pi() * month(period_month) / 12) AS month_sin, cos(2 * pi() * month(period_month) / 12) AS month_cos"""

_PRICE_PAIRS = ("lng", "nuclear", "coal_total", "renewable_total")


def _monthly_ctes() -> str:
    """Up to T: the table before anything is rounded."""
    lags = ", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}m" for k in MONTHLY_LAGS)
    rolls = ", ".join(
        full_window({"mean": "avg", "std": "stddev_samp"}[g], n, f"price_rolling_{n}m_{g}", "period_month", digits=9)
        for n, g in MONTHLY_ROLLS
    )
    settle = ", ".join(f"avg(CASE WHEN fuel = '{f}' THEN amount / volume END) AS settlement_unit_price_{f}" for f in SETTLED)
    trade = ", ".join(
        f"CASE WHEN transaction_volume_{n}_mwh_lag_1m > 0 THEN transaction_amount_{n}_krw_lag_1m / "
        f"transaction_volume_{n}_mwh_lag_1m END / 1000 AS trade_price_{n}_lag_1m"
        for n in _PRICE_PAIRS
    )
    parts = [
        """B AS (SELECT period_month, area, price FROM R WHERE rn = 1),
BS AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM B GROUP BY 1),
BG AS (SELECT g.area, CAST(g.t AS DATE) AS period_month, B.price FROM (
  SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t FROM BS) g
  LEFT JOIN B ON B.area = g.area AND B.period_month = CAST(g.t AS DATE))""",
        f"""FE AS (SELECT area, period_month, price, {lags}, {rolls}, lead(price) OVER w AS {monthly.TARGET},
  price AS {monthly.OBSERVED}, {_CAL} FROM BG WINDOW w AS (PARTITION BY area ORDER BY period_month))""",
        f"ST_c AS (SELECT period_month, {settle} FROM NF GROUP BY 1)",
        _lagged("ST", "ST_c", [f"settlement_unit_price_{f}" for f in SETTLED]),
        _wide("WV", "volume"),
        _wide("WA", "amount"),
        _current("CF", qa.CAPACITY_SQL, "WV"),
        _lagged("CF", "CF_c", list(qa.CAPACITY_SQL)),
        _current("CT", qa.TYPE_SQL, "WV"),
        _lagged("CT", "CT_c", list(qa.TYPE_SQL)),
        _current("TV", qa.VOLUME_SQL, "WV"),
        _lagged("TV", "TV_c", list(qa.VOLUME_SQL)),
        _current("TA", qa.AMOUNT_SQL, "WA"),
        _lagged("TA", "TA_c", list(qa.AMOUNT_SQL)),
        f"TP AS (SELECT period_month, {trade} FROM TV JOIN TA USING (period_month))",
        "CY AS (SELECT year(l_shipdate) + 1 AS y, sum(l_quantity) AS capacity_yearly_total_mw_lag_1y FROM lineitem GROUP BY 1)",
        "GP_c AS (SELECT period_month, price AS gas_price FROM M WHERE area = '1-URGENT')",
        _lagged("GP1", "GP_c", ["gas_price"], extend=2),
        """GP AS (SELECT period_month, gas_price_lag_1m, lag(gas_price_lag_1m) OVER (ORDER BY period_month) AS gas_price_lag_2m,
  (gas_price_lag_1m - lag(gas_price_lag_1m) OVER (ORDER BY period_month)) / lag(gas_price_lag_1m) OVER (ORDER BY period_month)
    AS gas_price_chg_1m_lag_1m FROM GP1)""",
        """LQ AS (SELECT m.period_month, max(quote_date) AS quote_date FROM (SELECT DISTINCT period_month FROM M) m
  JOIN CURVE ON quote_date <= last_day(m.period_month) GROUP BY 1),
FW0 AS (SELECT a.period_month,
  max(CASE WHEN contract_month = CAST(a.period_month + INTERVAL 1 MONTH AS DATE) THEN settle END) AS forward_1m,
  max(CASE WHEN contract_month = CAST(a.period_month + INTERVAL 2 MONTH AS DATE) THEN settle END) AS forward_2m
  FROM LQ a LEFT JOIN CURVE USING (quote_date) GROUP BY 1),
FW AS (SELECT *, CASE WHEN forward_1m <> 0 AND forward_2m <> 0 THEN (forward_2m - forward_1m) / forward_1m END AS forward_slope_1_2 FROM FW0)""",
        """DY AS (SELECT CAST(o_orderdate AS DATE) AS trade_date,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS close
  FROM orders GROUP BY 1),
DA_c AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period_month, avg(close) AS daily_mean, stddev_samp(close) AS daily_std,
  max(close) - min(close) AS daily_range, arg_max(close, trade_date) AS daily_last FROM DY GROUP BY 1)""",
        _lagged("DA", "DA_c", ["daily_mean", "daily_std", "daily_range", "daily_last"]),
    ]
    baseline = [f"price_lag_{k}m" for k in MONTHLY_LAGS] + [f"price_rolling_{n}m_{g}" for n, g in MONTHLY_ROLLS]
    baseline += [f"settlement_unit_price_{f}_lag_1m" for f in SETTLED] + ["price", monthly.TARGET]
    keep = " AND ".join(f"{c} IS NOT NULL" for c in baseline)
    parts.append(
        f"""T AS (SELECT FE.*, ST.* EXCLUDE (period_month), CF.* EXCLUDE (period_month), CT.* EXCLUDE (period_month),
  capacity_yearly_total_mw_lag_1y, TV.* EXCLUDE (period_month), TA.* EXCLUDE (period_month), TP.* EXCLUDE (period_month),
  GP.* EXCLUDE (period_month), FW.* EXCLUDE (period_month), DA.* EXCLUDE (period_month),
  period_month AS forecast_origin_month, CAST(period_month + INTERVAL 1 MONTH AS DATE) AS target_month,
  CAST(last_day(period_month) AS TIMESTAMP) + INTERVAL 86399 SECOND AS information_cutoff, '1M' AS horizon
  FROM FE LEFT JOIN ST USING (period_month) LEFT JOIN CF USING (period_month) LEFT JOIN CT USING (period_month)
  LEFT JOIN CY ON CY.y = year(FE.period_month) LEFT JOIN TV USING (period_month) LEFT JOIN TA USING (period_month)
  LEFT JOIN TP USING (period_month) LEFT JOIN GP USING (period_month) LEFT JOIN FW USING (period_month)
  LEFT JOIN DA USING (period_month) WHERE {keep})"""
    )
    return with_shapes("SNAP", "M", "FUEL", "CURVE") + RANKED + qa.NAMED + ", " + ",\n".join(parts)


def _monthly_sql() -> str:
    doubles = ["month_sin", "month_cos"] + [f"price_rolling_{n}m_{g}" for n, g in MONTHLY_ROLLS]
    doubles += [f"settlement_unit_price_{f}_lag_1m" for f in SETTLED]
    doubles += [f"{c}_lag_1m" for c in (*qa.CAPACITY_SQL, *qa.TYPE_SQL, *qa.VOLUME_SQL, *qa.AMOUNT_SQL)]
    doubles += [f"trade_price_{n}_lag_1m" for n in _PRICE_PAIRS]
    doubles += ["gas_price_chg_1m_lag_1m", "forward_slope_1_2", "capacity_yearly_total_mw_lag_1y"]
    doubles += [f"daily_{c}_lag_1m" for c in ("mean", "std")]
    replaced = ", ".join(f"round({c}, 4) AS {c}" for c in doubles)
    return _monthly_ctes() + f" SELECT * REPLACE ({replaced}) FROM T"


# values that are only looked up come through unchanged and are compared as they are
_LOOKED_UP = (
    "price", monthly.TARGET, monthly.OBSERVED, "gas_price_lag_1m", "gas_price_lag_2m", "forward_1m", "forward_2m",
    "daily_range_lag_1m", "daily_last_lag_1m", *[f"price_lag_{k}m" for k in MONTHLY_LAGS],
)


@query("f5_monthly_feature_table", _monthly_sql())
def monthly_feature_table(spark, d):
    return rounded(monthly.monthly_feature_table(monthly_inputs(spark, d)).table, 4, _LOOKED_UP)


#: the months of each block in the twin
_BLOCK_MONTHS = {
    "capacity_fuel": "CF", "capacity_type": "CT", "capacity_yearly": "M", "transaction_volume": "TV", "transaction_amount": "TA",
    "transaction_price": "TP", "gas_price": "GP", "forward": "FW", "daily": "DA",
}


@query(
    "f5_block_info",
    _monthly_ctes() + " " + " UNION ALL ".join(
        f"SELECT '{name}' AS block, min(period_month) AS period_min, max(period_month) AS period_max, "
        f"(SELECT count(DISTINCT period_month) FROM T WHERE period_month NOT IN (SELECT period_month FROM {cte})) AS missing_periods FROM {cte}"
        for name, cte in _BLOCK_MONTHS.items()
    ),
)
def monthly_block_info(spark, d):
    return monthly.monthly_feature_table(monthly_inputs(spark, d)).block_info()


_BASELINE = (
    [f"price_lag_{k}m" for k in MONTHLY_LAGS] + [f"price_rolling_{n}m_{g}" for n, g in MONTHLY_ROLLS]
    + [monthly.OBSERVED, "year", "month", "quarter", "is_summer", "is_winter", "is_peak_season", "month_sin", "month_cos"]
    + [f"settlement_unit_price_{f}_lag_1m" for f in SETTLED]
)


@query(
    "f5_leakage_canary",
    _monthly_ctes() + " SELECT *, pairs >= 6 AND pairs = equal_pairs AS suspect FROM ("
    + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, count({f}) FILTER ({monthly.TARGET} IS NOT NULL) AS pairs, "
        f"count(*) FILTER (CAST({f} AS DOUBLE) = {monthly.TARGET}) AS equal_pairs FROM T"
        for f in _BASELINE
    )
    + ")",
)
def monthly_canary(spark, d):
    return monthly.monthly_feature_table(monthly_inputs(spark, d)).canary()


@query("f5_dedup_log", ORACLES["w13_dedup_log"])
def monthly_dedup_log(spark, d):
    return monthly.monthly_feature_table(monthly_inputs(spark, d)).dedup_log()


@query(
    "f5_overlap_info",
    _monthly_ctes() + f""", SHARED AS (
  SELECT period_month FROM TV WHERE coalesce({", ".join(f"{c}_lag_1m" for c in qa.VOLUME_SQL)}) IS NOT NULL
  INTERSECT SELECT period_month FROM TA WHERE coalesce({", ".join(f"{c}_lag_1m" for c in qa.AMOUNT_SQL)}) IS NOT NULL)
SELECT 'as loaded' AS case, count(*) AS overlap_months, CAST(NULL AS VARCHAR) AS warning FROM SHARED
UNION ALL SELECT 'amounts a century later', 0, 'no overlap of volume and amount: no price features'""",
)
def monthly_overlap(spark, d):
    """The months that volumes and amounts share, and what a shift of one of them would be answered with."""
    blocks = monthly_inputs(spark, d).blocks
    volume, amount = blocks["transaction_volume"], blocks["transaction_amount"]
    late = amount.withColumn(monthly.PERIOD, F.add_months(monthly.PERIOD, 1200))
    cases = {"as loaded": amount, "amounts a century later": late}
    first, second = (monthly.overlap_info(volume, a).withColumn("case", F.lit(n)) for n, a in cases.items())
    return first.unionByName(second)


@query(
    "m2_feature_pool_monthly",
    f"WITH F5 AS ({_monthly_sql()})" + r""" UNPIVOT (
  SELECT area, period_month, CAST(COLUMNS('(_lag_\d+[hdmy]|_rolling_\d+[hdm]_[a-z]+)$|^(is_[a-z_]+|forward_[a-z0-9_]+|month_sin|month_cos|year|quarter|month|t_observed)$') AS DOUBLE)
  FROM F5)
ON COLUMNS(* EXCLUDE (area, period_month)) INTO NAME feature VALUE value""",
)
def monthly_feature_pool(spark, d):
    """Every value of the pool that a linear model would use on the monthly table."""
    table = rounded(monthly.monthly_feature_table(monthly_inputs(spark, d)).table, 4, _LOOKED_UP)
    pool = features_by_name(table.columns, [monthly.OBSERVED])
    doubles = table.select("area", monthly.PERIOD, *[F.col(c).cast("double").alias(c) for c in pool])
    return doubles.unpivot(["area", monthly.PERIOD], pool, "feature", "value").where("value IS NOT NULL")


def _hourly_sql(grid: str, table: str, group_check: str) -> str:
    price = ", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}h" for k in hourly.PRICE_LAGS)
    demand = ", ".join(f"lag(demand, {k}) OVER w AS demand_lag_{k}h" for k in hourly.DEMAND_LAGS)
    names = {"mean": "avg", "std": "stddev_samp"}
    rolls = ", ".join(
        [full_window(names[g], n, f"price_rolling_{label}_{g}", "interval_end") for n, g, label in hourly.PRICE_ROLLS]
        + [
            full_window(names[g], n, f"demand_rolling_{label}_{g}", "interval_end", "demand")
            for n, g, label in hourly.DEMAND_ROLLS
        ]
    )
    required = (
        [f"price_lag_{k}h" for k in hourly.PRICE_LAGS] + [f"demand_lag_{k}h" for k in hourly.DEMAND_LAGS]
        + [f"price_rolling_{label}_{g}" for _, g, label in hourly.PRICE_ROLLS] + ["price", "demand", hourly.TARGET]
    )
    return f"""{grid}, X AS (SELECT *, month(interval_end) AS mo,
  CASE WHEN hour(interval_end) = 0 THEN 24 ELSE hour(interval_end) END AS hr, isodow(interval_end) - 1 AS dow FROM {table}),
FE AS (SELECT area, interval_end, price, demand, {price}, {demand}, {rolls}, lead(price, 24) OVER w AS {hourly.TARGET},
  CAST(year(interval_end) AS INTEGER) AS year, CAST(mo AS INTEGER) AS month, CAST(day(interval_end) AS INTEGER) AS day,
  CAST(hr AS INTEGER) AS hour, CAST(dow AS INTEGER) AS day_of_week, dow IN (5, 6) AS is_weekend,
  CASE WHEN mo IN (3, 4, 5) THEN 'spring' WHEN mo IN (6, 7, 8) THEN 'summer' WHEN mo IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season,
  mo IN (6, 7, 8) AS is_summer, mo IN (12, 1, 2) AS is_winter, mo IN (6, 7, 8, 12, 1, 2) AS is_peak_load_season,
  round(sin(2 * pi() * hr / 24), 4) AS hour_sin, round(cos(2 * pi() * hr / 24), 4) AS hour_cos,
  round(sin(2 * pi() * dow / 7), 4) AS dow_sin, round(cos(2 * pi() * dow / 7), 4) AS dow_cos,
  CAST(interval_end AS DATE) IN (DATE '2024-01-08', DATE '2024-01-15') AS is_holiday
  FROM X WINDOW w AS (PARTITION BY area ORDER BY interval_end))
SELECT * FROM FE WHERE {" AND ".join(f"{c} IS NOT NULL" for c in required)} {group_check}"""


@query("f6_hourly_feature_table", with_shapes("H0") + "," + _hourly_sql(H0GRID, "H0G", ""))
def hourly_feature_table(spark, d):
    holidays = spark.createDataFrame([("2024-01-08",), ("2024-01-15",)], "holiday_date string")
    rows = shapes.hourly_price(spark, d, by_area=False)
    looked_up = ("price", hourly.TARGET, *[f"price_lag_{k}h" for k in hourly.PRICE_LAGS])
    return rounded(hourly.hourly_feature_table(rows, holidays=holidays).table, 4, looked_up)


def _leaderboard_sql() -> str:
    lags = ", ".join(f"lag(price, {k}) OVER w AS price_lag_{k}m" for k in MONTHLY_LAGS)
    rolls = ", ".join(
        full_window({"mean": "avg", "std": "stddev_samp"}[g], n, f"price_rolling_{n}m_{g}", "period_month")
        for n, g in MONTHLY_ROLLS
    )
    needed = [f"price_lag_{k}m" for k in MONTHLY_LAGS] + [f"price_rolling_{n}m_{g}" for n, g in MONTHLY_ROLLS]
    keep = " AND ".join(f"{c} IS NOT NULL" for c in [*needed, "price", "y_true"])
    union = " UNION ALL ".join(
        f"SELECT area, period_month, y_true, '{m}' AS model, {c} AS y_pred FROM U" for m, c in NAIVE.items()
    )
    return (
        with_shapes("SNAP") + RANKED + f""", B AS (SELECT period_month, area, price FROM R WHERE rn = 1),
BS AS (SELECT area, min(period_month) AS lo, max(period_month) AS hi FROM B GROUP BY 1),
BG AS (SELECT g.area, CAST(g.t AS DATE) AS period_month, B.price FROM (
  SELECT area, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS t FROM BS) g
  LEFT JOIN B ON B.area = g.area AND B.period_month = CAST(g.t AS DATE)),
FE AS (SELECT area, period_month, price, {lags}, {rolls}, lead(price) OVER w AS y_true FROM BG
  WINDOW w AS (PARTITION BY area ORDER BY period_month)),
U AS (SELECT * FROM FE WHERE {keep}), L AS ({union}),
ST AS (SELECT *, CAST(sign(y_true - lag(y_true) OVER w) = sign(y_pred - lag(y_pred) OVER w) AS DOUBLE) AS same
  FROM L WINDOW w AS (PARTITION BY model, area ORDER BY period_month))
SELECT area AS split, model, round(avg(abs(y_true - y_pred)), 4) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse,
  round(avg(abs((y_true - y_pred) / y_true)) * 100, 4) AS mape,
  round(avg(abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2)) * 100, 4) AS smape,
  round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 4) AS r2, count(*) AS n,
  round(avg(same), 4) AS directional_accuracy FROM ST GROUP BY 1, 2"""
    )


@query("flagship_leaderboard", _leaderboard_sql())
def leaderboard(spark, d):
    return rounded(naive_leaderboard(shapes.revisions(spark, d)), 4)
