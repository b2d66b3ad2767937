"""Aggregations on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.parsing import lookup
from tidemark.operators import aggregates as a
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.revisions import dedup_log
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.queries.scalars import FUELS, MONTHLY_FUEL, monthly_fuel
from tidemark.queries.sources import run_log_rows
from tidemark.queries.tools import rounded
from tidemark.queries.windows import RANKED


@query(
    "a1_hourly_to_monthly",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_month, p_type AS fuel, sum(l_quantity) AS volume
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2""",
)
def hourly_to_monthly(spark, d):
    return a.to_monthly(shapes.fuel_trades(spark, d), ["volume"], ["fuel"])


@query(
    "a2_daily_to_monthly",
    """WITH D AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, p_type AS fuel, sum(l_extendedprice) AS amount
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)
SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period_month, fuel, round(sum(amount), 2) AS amount
FROM D GROUP BY 1, 2""",
)
def daily_to_monthly(spark, d):
    daily = shapes.fuel_trades(spark, d).groupBy("trade_date", "fuel").agg(F.sum("amount").alias("amount"))
    return rounded(a.to_monthly(daily, ["amount"], ["fuel"]), 2)


DAILY = """WITH DAY AS (SELECT CAST(o_orderdate AS DATE) AS trade_date,
  CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / CAST(count(*) * 100 AS DOUBLE) AS close
  FROM orders GROUP BY 1),
MO AS (SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period_month, avg(close) AS m, stddev_samp(close) AS s,
  max(close) AS hi, min(close) AS lo, arg_max(close, trade_date) AS last, max(close) - min(close) AS r FROM DAY GROUP BY 1)"""


def daily_close(spark, d):
    orders = read_table(spark, d, "orders")
    return orders.groupBy(F.col("o_orderdate").cast("date").alias("trade_date")).agg(
        shapes.exact_mean("o_totalprice").alias("close")
    )


@query(
    "a3_daily_price_stats",
    DAILY
    + """ SELECT period_month, round(m, 4) AS daily_mean, round(s, 4) AS daily_std, hi AS daily_max,
  lo AS daily_min, last AS daily_last, r AS daily_range FROM MO""",
)
def daily_price_stats(spark, d):
    exact = ("daily_max", "daily_min", "daily_last", "daily_range")
    return rounded(a.daily_price_stats(daily_close(spark, d), "close"), 4, exact)


@query(
    "a3_daily_price_lags",
    DAILY
    + """, S AS (SELECT min(period_month) AS a, max(period_month) AS b FROM MO),
G AS (SELECT CAST(g.t AS DATE) AS period_month, m, s, r, last FROM (
  SELECT unnest(generate_series(CAST(a AS TIMESTAMP), b + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS t FROM S) g
  LEFT JOIN MO ON MO.period_month = CAST(g.t AS DATE))
SELECT period_month, round(lag(m) OVER w, 4) AS daily_mean_lag_1m, round(lag(s) OVER w, 4) AS daily_std_lag_1m,
  lag(r) OVER w AS daily_range_lag_1m, lag(last) OVER w AS daily_last_lag_1m
FROM G WINDOW w AS (ORDER BY period_month)""",
)
def daily_price_lags(spark, d):
    exact = ("daily_range_lag_1m", "daily_last_lag_1m")
    return rounded(a.daily_price_lags(daily_close(spark, d), "close"), 4, exact)


@query(
    "a4_pivot_sum",
    with_shapes("FUEL") + MONTHLY_FUEL + " SELECT period_month, "
    + ", ".join(f"sum(CASE WHEN fuel = '{f}' THEN volume END) AS \"{f}\"" for f in FUELS)
    + " FROM MF GROUP BY 1",
)
def pivot_sum(spark, d):
    return a.pivot_sum(monthly_fuel(spark, d), ["period_month"], "fuel", "volume", FUELS)


@query(
    "a5_pivot_mean",
    with_shapes("FUEL") + " SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period_month, "
    + ", ".join(f"round(avg(CASE WHEN fuel = '{f}' THEN amount END), 4) AS \"{f}\"" for f in FUELS)
    + " FROM FUEL GROUP BY 1",
)
def pivot_mean(spark, d):
    trades = shapes.fuel_trades(spark, d).withColumn("period_month", shapes.month_of("trade_date"))
    return rounded(a.pivot_mean(trades, ["period_month"], "fuel", "amount", FUELS), 4)


# the six part types stand for fuels; "total" is the sum over all of them
FUEL_NAMES = {
    "ECONOMY": "nuclear", "LARGE": "lng", "MEDIUM": "coal_bituminous", "PROMO": "coal_anthracite",
    "SMALL": "renewable_solar", "STANDARD": "renewable_wind",
}
_NAME_CASE = "CASE fuel " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FUEL_NAMES.items()) + " END"
# April reports no renewables and May no anthracite, so that nulls show
_UNREPORTED = (
    "(month(period_month) = 4 AND fuel IN ('SMALL', 'STANDARD')) OR (month(period_month) = 5 AND fuel = 'PROMO')"
)


def named_fuel(spark, d):
    hidden = F.expr(_UNREPORTED)
    return monthly_fuel(spark, d).select(
        "period_month", lookup(F.col("fuel"), FUEL_NAMES).alias("fuel"),
        F.when(~hidden, F.col("volume")).alias("volume"), F.when(~hidden, F.col("amount")).alias("amount"),
    )


def with_total(named):
    long = named.select("period_month", "fuel", "volume")
    total = long.groupBy("period_month").agg(F.sum("volume").alias("volume")).withColumn("fuel", F.lit("total"))
    return long.unionByName(total)


NAMED = MONTHLY_FUEL + f""", NF AS (SELECT period_month, {_NAME_CASE} AS fuel,
  CASE WHEN NOT ({_UNREPORTED}) THEN volume END AS volume, CASE WHEN NOT ({_UNREPORTED}) THEN amount END AS amount FROM MF)"""


def _wide_sql(value: str) -> str:
    cells = ", ".join(f"sum(CASE WHEN fuel = '{v}' THEN {value} END) AS {v}" for v in FUEL_NAMES.values())
    return f"W AS (SELECT period_month, {cells}, sum({value}) AS total FROM NF GROUP BY 1)"


def _lag_sql(columns: dict[str, str], digits: int = 6) -> str:
    """Lag one month every column of CTE ``CUR`` on its grid."""
    span = "SPAN AS (SELECT min(period_month) AS a, max(period_month) AS b FROM CUR)"
    grid = (
        "GRID AS (SELECT CAST(g.t AS DATE) AS period_month, CUR.* EXCLUDE (period_month) FROM ("
        "SELECT unnest(generate_series(CAST(a AS TIMESTAMP), b + INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS t FROM SPAN) g "
        "LEFT JOIN CUR ON CUR.period_month = CAST(g.t AS DATE))"
    )
    cells = ", ".join(f"round(lag({c}) OVER w, {digits}) AS {c}_lag_1m" for c in columns)
    return f"{span}, {grid} SELECT period_month, {cells} FROM GRID WINDOW w AS (ORDER BY period_month)"


def _current_sql(columns: dict[str, str]) -> str:
    return "CUR AS (SELECT period_month, " + ", ".join(f"{e} AS {n}" for n, e in columns.items()) + " FROM W)"


def _share(part: str, total: str = "total") -> str:
    return f"CASE WHEN {total} > 0 THEN ({part}) / {total} END"


_REN = "coalesce(renewable_solar, 0) + coalesce(renewable_wind, 0)"
CAPACITY_SQL = {
    "capacity_fuel_nuclear_mw": "nuclear",
    "capacity_fuel_lng_mw": "lng",
    "capacity_fuel_total_mw": "total",
    "capacity_fuel_renewable_total_mw": _REN,
    "capacity_fuel_nuclear_share": _share("nuclear"),
    "capacity_fuel_lng_share": _share("lng"),
    "capacity_fuel_coal_total_mw": "coal_bituminous + coal_anthracite",
    "capacity_fuel_coal_total_share": _share("coal_bituminous + coal_anthracite"),
    "capacity_fuel_renewable_total_share": _share(_REN),
}
RENEWABLE = ["renewable_solar", "renewable_wind"]


@query(
    "a6_capacity_mix",
    with_shapes("FUEL") + NAMED + "," + _wide_sql("volume") + "," + _current_sql(CAPACITY_SQL) + "," + _lag_sql(CAPACITY_SQL),
)
def capacity_mix(spark, d):
    out = a.capacity_mix(with_total(named_fuel(spark, d)), "volume", "fuel", ["nuclear", "lng", "total"], RENEWABLE)
    return rounded(out, 6)


TYPE_GROUPS = {
    "steam_total": ["coal_bituminous", "coal_anthracite"],
    "combined_cycle_total": ["lng"],
    "internal_combustion_total": ["renewable_wind"],
}
TYPE_SINGLES = {"nuclear": "nuclear", "renewable": "renewable_solar", "total": "total"}
TYPE_SHARES = {"nuclear": "nuclear", "combined_cycle": "combined_cycle_total", "renewable": "renewable"}
TYPE_SQL = {
    "capacity_type_steam_total_mw": "coalesce(coal_bituminous, 0) + coalesce(coal_anthracite, 0)",
    "capacity_type_combined_cycle_total_mw": "coalesce(lng, 0)",
    "capacity_type_internal_combustion_total_mw": "coalesce(renewable_wind, 0)",
    "capacity_type_nuclear_mw": "nuclear",
    "capacity_type_renewable_mw": "renewable_solar",
    "capacity_type_total_mw": "total",
    "capacity_type_nuclear_share": _share("nuclear"),
    "capacity_type_combined_cycle_share": _share("coalesce(lng, 0)"),
    "capacity_type_renewable_share": _share("renewable_solar"),
}


@query(
    "a7_capacity_type_mix",
    with_shapes("FUEL") + NAMED + "," + _wide_sql("volume") + "," + _current_sql(TYPE_SQL) + "," + _lag_sql(TYPE_SQL),
)
def capacity_type_mix(spark, d):
    out = a.capacity_type_mix(
        with_total(named_fuel(spark, d)), "volume", "fuel", TYPE_GROUPS, TYPE_SINGLES, "total", TYPE_SHARES
    )
    return rounded(out, 6)


def _trade_sql(prefix: str, unit: str) -> dict[str, str]:
    parts = {n: n for n in ("nuclear", "lng", "coal_bituminous", "coal_anthracite")}
    total = " + ".join(f"coalesce({p}, 0)" for p in [*parts, "renewable_solar", "renewable_wind"])
    return {
        **{f"{prefix}_{n}_{unit}": e for n, e in parts.items()},
        f"{prefix}_oil_{unit}": "CAST(NULL AS DOUBLE)",
        f"{prefix}_renewable_total_{unit}": _REN,
        f"{prefix}_total_{unit}": total,
        f"{prefix}_nuclear_share": _share("nuclear", f"({total})"),
        f"{prefix}_lng_share": _share("lng", f"({total})"),
        f"{prefix}_renewable_share": _share(_REN, f"({total})"),
        f"{prefix}_coal_total_{unit}": "coal_bituminous + coal_anthracite",
        f"{prefix}_coal_total_share": _share("coal_bituminous + coal_anthracite", f"({total})"),
    }


VOLUME_SQL = _trade_sql("transaction_volume", "mwh")
AMOUNT_SQL = _trade_sql("transaction_amount", "krw")


@query(
    "a8_volume_mix",
    with_shapes("FUEL") + NAMED + "," + _wide_sql("volume") + "," + _current_sql(VOLUME_SQL) + "," + _lag_sql(VOLUME_SQL),
)
def volume_mix(spark, d):
    out = a.trade_mix(
        named_fuel(spark, d), "volume", "fuel", "transaction_volume", "mwh", RENEWABLE, single_renewable=None
    )
    return rounded(out, 6)


@query(
    "a9_amount_mix",
    with_shapes("FUEL") + NAMED + "," + _wide_sql("amount") + "," + _current_sql(AMOUNT_SQL) + "," + _lag_sql(AMOUNT_SQL, 4),
)
def amount_mix(spark, d):
    out = a.trade_mix(
        named_fuel(spark, d), "amount", "fuel", "transaction_amount", "krw", RENEWABLE, single_renewable=None
    )
    return rounded(out, 4)


@query(
    "a10_yearly_totals",
    """SELECT CAST(year(l_shipdate) AS INTEGER) AS period_year,
  sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a_total_mw,
  sum(CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN l_quantity END) AS r_f_mw
FROM lineitem WHERE l_linenumber = 1 GROUP BY 1""",
)
def yearly_totals(spark, d):
    items = read_table(spark, d, "lineitem").select(
        F.year("l_shipdate").alias("period_year"),
        F.when(F.col("l_linenumber") == 1, "all").otherwise("part").alias("row_category"),
        F.col("l_returnflag").alias("level1"),
        F.when(F.col("l_returnflag") != "A", F.col("l_linestatus")).otherwise("").alias("level2"),
        F.col("l_quantity").alias("capacity_mw"),
    )
    return a.yearly_totals(items, "capacity_mw", {"A": "a_total_mw", "R|F": "r_f_mw"}, "row_category", "all")


@query(
    "a11_mean_duplicates",
    with_shapes("SNAP") + " SELECT period_month, area, round(avg(price), 4) AS price FROM SNAP GROUP BY 1, 2",
)
def mean_duplicates(spark, d):
    return rounded(a.mean_duplicates(shapes.revisions(spark, d), ["period_month", "area"], ["price"]), 4)


@query(
    "a12_coverage",
    with_shapes("M")
    + " SELECT area, count(*) AS rows, min(period_month) AS period_min, max(period_month) AS period_max FROM M GROUP BY 1",
)
def coverage(spark, d):
    return a.coverage(shapes.monthly_price(spark, d), "period_month", ["area"])


@query(
    "a13_source_inventory",
    with_shapes("SNAP")
    + """ SELECT 'p' || source_priority AS source_id, count(DISTINCT parsed_path) AS snapshots, count(*) AS rows,
  min(period_month) AS period_min, max(period_month) AS period_max FROM SNAP GROUP BY 1""",
)
def source_inventory(spark, d):
    snap = shapes.revisions(spark, d).withColumn(
        "source_id", F.concat(F.lit("p"), F.col("source_priority").cast("string"))
    )
    return a.source_inventory(snap)


@query(
    "a14_null_coverage",
    with_shapes("PANEL")
    + """ SELECT 'lags' AS feature_group, 2 AS n_cols, round((count(lag_1m) + count(lag_12m)) * 100.0 / (count(*) * 2), 6) AS non_null_pct FROM PANEL
UNION ALL SELECT 'target', 1, round(count(target) * 100.0 / count(*), 6) FROM PANEL""",
)
def null_coverage(spark, d):
    out = a.null_coverage(shapes.backtest_panel(spark, d), {"lags": ["lag_1m", "lag_12m"], "target": ["target"]})
    return rounded(out, 6)


@query(
    "a14_column_counts",
    with_shapes("PANEL")
    + """ SELECT unnest(['observed', 'lag_1m', 'lag_12m', 'target']) AS "column",
  unnest([count(observed), count(lag_1m), count(lag_12m), count(target)]) AS non_null FROM PANEL""",
)
def column_counts(spark, d):
    return a.column_counts(shapes.backtest_panel(spark, d), ["observed", "lag_1m", "lag_12m", "target"])


@query(
    "a15_value_counts",
    with_shapes("SNAP")
    + RANKED
    + """, L AS (SELECT rn, source_priority, count(*) OVER (PARTITION BY period_month, area) AS n,
  min(source_priority) OVER (PARTITION BY period_month, area) AS best FROM R)
SELECT CASE WHEN rn = 1 THEN '' WHEN source_priority > best THEN 'lower_priority' ELSE 'older_revision' END AS reason,
  count(*) AS rows FROM L WHERE n > 1 GROUP BY 1""",
)
def value_counts(spark, d):
    log = dedup_log(shapes.revisions(spark, d), ["period_month", "area"])
    return a.value_counts(log, ["reason"])


@query(
    "a16_histogram",
    """WITH S AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
B AS (SELECT lo, hi, least(CAST(floor((o_totalprice - lo) / ((hi - lo) / 30)) AS INTEGER), 29) AS bin FROM orders, S)
SELECT bin, round(lo + bin * ((hi - lo) / 30), 4) AS bin_start, count(*) AS rows FROM B GROUP BY lo, hi, bin""",
)
def histogram(spark, d):
    return rounded(a.histogram(read_table(spark, d, "orders"), "o_totalprice", 30), 4)


@query(
    "a17_seasonal_quartiles",
    """SELECT CAST(month(o_orderdate) AS INTEGER) AS month, CAST(p AS DOUBLE) AS prob, round(CASE p WHEN 0 THEN min(o_totalprice)
  WHEN 0.25 THEN quantile_cont(o_totalprice, 0.25) WHEN 0.5 THEN quantile_cont(o_totalprice, 0.5)
  WHEN 0.75 THEN quantile_cont(o_totalprice, 0.75) ELSE max(o_totalprice) END, 3) AS quantile
FROM orders, (SELECT unnest([0, 0.25, 0.5, 0.75, 1]) AS p) GROUP BY 1, p""",
)
def seasonal_quartiles(spark, d):
    orders = read_table(spark, d, "orders").select(F.month("o_orderdate").alias("month"), "o_totalprice")
    return rounded(exact_quantiles(orders, ["month"], "o_totalprice", [0, 0.25, 0.5, 0.75, 1]), 3, ("prob",))


@query(
    "a18_fold_summary",
    with_shapes("PRED")
    + """, S AS (SELECT model, version, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse
  FROM PRED GROUP BY 1, 2)
SELECT model, count(*) AS n_folds, round(avg(mae), 4) AS mae_mean, round(stddev_pop(mae), 4) AS mae_std,
  round(avg(rmse), 4) AS rmse_mean, round(stddev_pop(rmse), 4) AS rmse_std FROM S GROUP BY 1""",
)
def fold_summary(spark, d):
    gap = F.col("y_true") - F.col("y_pred")
    per_fold = shapes.predictions(spark, d).groupBy("model", "version").agg(
        F.avg(F.abs(gap)).alias("mae"), F.sqrt(F.avg(gap * gap)).alias("rmse")
    )
    return rounded(a.fold_summary(per_fold, ["mae", "rmse"]), 4)


@query(
    "a19_quality_report",
    """WITH LOADED AS (SELECT 'source_' || l_returnflag AS source_id, 'file_' || l_linestatus AS source_file,
  max(l_shipdate) AS last_at, count(*) FILTER (l_discount = 0) AS zeros FROM lineitem GROUP BY l_returnflag, l_linestatus),
T AS (SELECT * FROM LOADED UNION ALL SELECT replace(source_id, 'source_', 'announced_'), source_file, last_at, zeros FROM LOADED),
L AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY last_at DESC, source_file) AS rn,
  count(*) OVER (PARTITION BY source_id) AS runs FROM T),
C AS (SELECT 'source_' || l_returnflag AS source_id, count(*) AS rows, CAST(min(l_shipdate) AS DATE) AS period_min,
  CAST(max(l_shipdate) AS DATE) AS period_max FROM lineitem GROUP BY 1)
SELECT source_id, source_file AS latest_source_file, runs, coalesce(rows, 0) AS rows, period_min, period_max,
  source_id || CASE WHEN rows IS NULL THEN ': no parsed rows yet' ELSE ': dropped vendor columns sub_b, sub_a' END
    || CASE WHEN zeros > 0 THEN '; ' || source_id || ': dropped ' || zeros || ' rows with zero for not published' ELSE '' END AS notes
FROM L LEFT JOIN C USING (source_id) WHERE rn = 1
UNION ALL
SELECT 'pages', url, 0, 0, NULL, NULL, 'quarantine: ' || url || ' (misnamed)' FROM pages WHERE contains(url, '/fr/')""",
)
def quality_report(spark, d):
    """Every source as loaded, and once more as announced: with runs in the log but without parsed rows."""
    covered = a.coverage(
        read_table(spark, d, "lineitem").select(
            F.concat(F.lit("source_"), "l_returnflag").alias("source_id"), F.col("l_shipdate").cast("date").alias("day")
        ),
        "day", ["source_id"],
    )
    held = read_table(spark, d, "pages").where(F.contains("url", F.lit("/fr/"))).select(
        F.lit("pages").alias("source_id"), F.col("url").alias("original_path"), F.lit("misnamed").alias("reason")
    )
    loaded = run_log_rows(spark, d)
    announced = loaded.withColumn("source_id", F.replace("source_id", F.lit("source_"), F.lit("announced_")))
    return a.quality_report(loaded.unionByName(announced), covered, held)


@query(
    "a20_ablation_matrix",
    with_shapes("PRED")
    + """, S AS (SELECT 'year_' || version AS feature_group, model, avg(abs(y_true - y_pred)) AS mae FROM PRED GROUP BY 1, 2)
SELECT feature_group, round(avg(CASE WHEN model = 'persistence_monthly' THEN mae END), 4) AS persistence_monthly,
  round(avg(CASE WHEN model = 'naive_lag_1m' THEN mae END), 4) AS naive_lag_1m,
  round(avg(CASE WHEN model = 'seasonal_naive_lag_12m' THEN mae END), 4) AS seasonal_naive_lag_12m FROM S GROUP BY 1""",
)
def ablation_matrix(spark, d):
    scores = shapes.predictions(spark, d).groupBy(
        F.concat(F.lit("year_"), F.col("version").cast("string")).alias("feature_group"), "model"
    ).agg(F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"))
    return rounded(a.ablation_matrix(scores, list(shapes.MODEL_COLUMNS)), 4)
