"""Serving tables and the registry on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import serving as sv
from tidemark.operators.models import Ridge
from tidemark.plans import shapes
from tidemark.plans.shapes import with_shapes
from tidemark.queries.backtests import AR_SQL, FEATURES, ar_panel
from tidemark.queries.linear import gram_sql, predict_sql, ridge_sql
from tidemark.queries.registry import query
from tidemark.queries.scores import ANNOTATED, SCORED, annotated
from tidemark.queries.tools import rounded
from tidemark.session import scratch_path


@query(
    "f1_next_forecast",
    with_shapes("M", "MGRID")
    + AR_SQL
    + f", G AS (SELECT area, {gram_sql([*FEATURES, 'target'])} FROM ARC GROUP BY area),\n"
    + ridge_sql("G", "rx", [0, 1, 2, 3], 4)
    + f""", NEW AS (SELECT * FROM ARP WHERE observed IS NOT NULL AND lag_1m IS NOT NULL AND lag_12m IS NOT NULL AND roll_3m IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY area ORDER BY period_month DESC) = 1)
SELECT area, period_month AS forecast_origin_month, CAST(period_month + INTERVAL 1 MONTH AS DATE) AS target_month,
  round({predict_sql('rx', FEATURES)}, 3) AS predicted, round(observed, 3) AS most_recent_actual FROM NEW JOIN rx USING (area)""",
)
def next_forecast(spark, d):
    return sv.next_forecast(ar_panel(spark, d), ["area"], Ridge(tuple(FEATURES)), "target", "observed")


@query(
    "f2_pick_model",
    with_shapes("PRED") + SCORED + ANNOTATED + """ SELECT version, model, registry_status,
  CAST(CASE WHEN registry_status = 'latest_candidate' THEN 0 ELSE 1 END AS INTEGER) AS tier, round(mae, 5) AS mae
FROM AN WHERE NOT skipped AND model <> 'persistence_monthly' ORDER BY tier, AN.mae, version, model LIMIT 1""",
)
def pick_model(spark, d):
    cells = annotated(spark, d)
    usable = cells.where("model <> 'persistence_monthly'").select("version", "model")
    return sv.pick_model(cells, usable).select(
        "version", "model", "registry_status", "tier", F.round("mae", 5).alias("mae")
    )


def _profile_sql() -> str:
    cf = ", ".join(str(c) for c in sv.SOLAR_CF)
    return with_shapes("M") + f""", C AS (SELECT unnest([{cf}]) AS cf, unnest(range(24)) AS h),
RAW AS (SELECT h, CAST(cf AS DOUBLE) AS cf, CASE WHEN h BETWEEN 17 AND 21 THEN 1.25 ELSE 1.0 END / (1.0 + 0.45 * cf) AS raw FROM C),
P AS (SELECT h, cf, raw / avg(raw) OVER () AS mult, CASE WHEN cf > 0.30 THEN '{sv.BAND_DAYTIME}'
  WHEN h BETWEEN 17 AND 21 THEN '{sv.BAND_EVENING}' WHEN cf = 0 THEN '{sv.BAND_NIGHT}' ELSE '{sv.BAND_BETWEEN}' END AS band FROM RAW)
SELECT area, period_month, CAST(h AS INTEGER) AS hour, cf AS solar_capacity_factor, round(mult, 8) AS multiplier, band,
  round(price * mult, 3) AS predicted FROM M, P"""


@query("f3_hourly_profile", _profile_sql())
def hourly_profile(spark, d):
    out = sv.hourly_profile(shapes.monthly_price(spark, d), "price").drop("price")
    return out.withColumns({"multiplier": F.round("multiplier", 8), "predicted": F.round("predicted", 3)})


@query(
    "f4_registry",
    with_shapes("PRED") + SCORED + ANNOTATED
    + " SELECT model, CAST(2 * count(*) AS BIGINT) AS records FROM AN GROUP BY 1",
)
def registry(spark, d):
    path = scratch_path(spark, "registry")
    records = annotated(spark, d).select("version", "model", "registry_status", "mae", "skipped")
    sv.append_registry(records, path)
    sv.append_registry(records, path)
    return sv.registry_counts(sv.registry_history(spark, path))


@query(
    "f4_registry_history",
    with_shapes("PRED") + SCORED + ANNOTATED
    + " SELECT version, model, registry_status, round(mae, 5) AS mae, skipped FROM AN WHERE model = 'naive_lag_1m'",
)
def registry_history(spark, d):
    path = scratch_path(spark, "registry")
    sv.append_registry(annotated(spark, d).select("version", "model", "registry_status", "mae", "skipped"), path)
    return rounded(sv.registry_history(spark, path, "naive_lag_1m"), 5)
