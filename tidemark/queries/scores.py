"""Evaluation and ranking on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import scores as s
from tidemark.plans import shapes
from tidemark.plans.shapes import with_shapes
from tidemark.queries.registry import query
from tidemark.queries.tools import rounded

BY = ["model", "version"]
# every ninth prediction is missing, so that the pair rule shows
HOLES = """, PH AS (SELECT area, period_month, version, model, base, y_true,
  CASE WHEN (month(period_month) + version) % 9 <> 0 THEN y_pred END AS y_pred FROM PRED)"""


def holed(spark, d):
    keep = (F.month("period_month") + F.col("version")) % 9 != 0
    return shapes.predictions(spark, d).withColumn("y_pred", F.when(keep, F.col("y_pred")))


@query(
    "e1_regression_metrics",
    with_shapes("PRED")
    + HOLES
    + """ SELECT model, version, round(avg(abs(y_true - y_pred)), 4) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse,
  count(*) AS n FROM PH WHERE y_pred IS NOT NULL GROUP BY 1, 2""",
)
def regression_metrics(spark, d):
    return rounded(s.regression_metrics(holed(spark, d), BY, check=True), 4)


@query(
    "e2_mape_smape",
    with_shapes("PRED")
    + """ SELECT model, version, round(avg(abs((y_true - y_pred) / y_true)) FILTER (abs(y_true) > 1e-9) * 100, 6) AS mape,
  round(avg(abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2)) FILTER ((abs(y_true) + abs(y_pred)) / 2 > 1e-9) * 100, 6) AS smape
FROM PRED GROUP BY 1, 2""",
)
def mape_smape(spark, d):
    out = shapes.predictions(spark, d).groupBy(*BY).agg(s.mape().alias("mape"), s.smape().alias("smape"))
    return rounded(out, 6)


@query(
    "e3_r2",
    with_shapes("PRED")
    + """ SELECT model, version, round(CASE WHEN var_pop(y_true) * count(*) >= 1e-12
  THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END, 6) AS r2 FROM PRED GROUP BY 1, 2""",
)
def r2(spark, d):
    return rounded(shapes.predictions(spark, d).groupBy(*BY).agg(s.r2().alias("r2")), 6)


STEPS = """, ST AS (SELECT *, CAST(sign(y_true - lag(y_true) OVER w) = sign(y_pred - lag(y_pred) OVER w) AS DOUBLE) AS same
  FROM PRED WINDOW w AS (PARTITION BY model, version, area ORDER BY period_month))"""


@query(
    "e4_directional_accuracy",
    with_shapes("PRED") + STEPS + " SELECT model, version, round(avg(same), 6) AS directional_accuracy FROM ST GROUP BY 1, 2",
)
def directional_accuracy(spark, d):
    return rounded(s.directional_accuracy(shapes.predictions(spark, d), BY, ["area"], "period_month"), 6)


@query(
    "e5_peak_scores",
    with_shapes("PRED")
    + """, TH AS (SELECT model, version, quantile_cont(y_true, 0.9) AS t FROM PRED GROUP BY 1, 2),
C AS (SELECT model, version, t, CAST(count(*) FILTER (y_true >= t AND y_pred >= t) AS DOUBLE) AS tp,
  CAST(count(*) FILTER (y_true < t AND y_pred >= t) AS DOUBLE) AS fp, CAST(count(*) FILTER (y_true >= t AND y_pred < t) AS DOUBLE) AS fn
  FROM PRED JOIN TH USING (model, version) GROUP BY 1, 2, 3),
R AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r FROM C)
SELECT model, version, round(p, 6) AS peak_precision, round(r, 6) AS peak_recall,
  round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS peak_f1, round(t, 4) AS peak_threshold FROM R""",
)
def peak_scores(spark, d):
    out = s.peak_scores(shapes.predictions(spark, d), BY)
    return rounded(rounded(out, 6, ("peak_threshold",)), 4, ("peak_precision", "peak_recall", "peak_f1"))


@query(
    "e6_rmse_mape",
    with_shapes("PRED")
    + """ SELECT model, version, round(sqrt(avg((y_true - y_pred) ** 2)), 4) AS rmse,
  round(avg(abs((y_true - y_pred) / greatest(abs(y_true), 1e-8))) * 100, 6) AS mape,
  round(avg(abs(y_true - y_pred)), 4) AS mae, count(*) AS valid_n FROM PRED GROUP BY 1, 2""",
)
def rmse_mape(spark, d):
    out = s.rmse_mape(shapes.predictions(spark, d), BY)
    return rounded(rounded(out, 4, ("mape",)), 6, ("rmse", "mae"))


@query(
    "e7_delta_metrics",
    with_shapes("PRED")
    + """ SELECT model, version, round(avg(abs((y_true - base) - (y_pred - base))), 4) AS delta_mae,
  round(avg(CAST(sign(y_true - base) = sign(y_pred - base) AS DOUBLE)) FILTER (y_true <> base), 6) AS delta_direction_accuracy
FROM PRED GROUP BY 1, 2""",
)
def delta_metrics(spark, d):
    return rounded(rounded(s.delta_metrics(shapes.predictions(spark, d), BY, "base"), 4, ("delta_direction_accuracy",)), 6, ("delta_mae",))


@query(
    "e8_residual_summary",
    with_shapes("PRED")
    + """ SELECT model, version, count(*) AS n, round(avg(y_pred - y_true), 4) AS mean_residual,
  round(avg(abs(y_pred - y_true)), 4) AS mean_abs_residual, count(*) FILTER (y_pred < y_true) AS n_underpred,
  count(*) FILTER (y_pred > y_true) AS n_overpred, round(avg(abs((y_true - base) - (y_pred - base))), 4) AS delta_mae,
  round(avg(CAST((y_true > base) = (y_pred > base) AS DOUBLE)) FILTER (y_true <> base), 4) AS delta_direction_accuracy
FROM PRED GROUP BY 1, 2""",
)
def residual_summary(spark, d):
    return rounded(s.residual_summary(shapes.predictions(spark, d), BY, "base"), 4)


SCORED = STEPS + """, SC AS (SELECT model, version, avg(abs(y_true - y_pred)) AS mae, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
  avg(abs((y_true - y_pred) / y_true)) * 100 AS mape, 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2,
  avg(same) AS directional_accuracy, count(*) AS n FROM ST GROUP BY 1, 2)"""


def scored(spark, d):
    rows = s.with_steps(s.pairs(shapes.predictions(spark, d)), BY, ["area"], "period_month")
    return rows.groupBy(*BY).agg(*s.error_aggs(), s.direction_agg())


@query(
    "e9_leaderboard",
    with_shapes("PRED")
    + SCORED
    + """ SELECT CAST(version AS VARCHAR) AS split, model, round(mae, 4) AS mae, round(rmse, 4) AS rmse, n FROM SC""",
)
def leaderboard(spark, d):
    table = scored(spark, d).select(
        F.col("version").cast("string").alias("split"), "model", F.round("mae", 4).alias("mae"),
        F.round("rmse", 4).alias("rmse"), "n",
    )
    return s.leaderboard(table)


# the plan holds one year and one model the data cannot fill
PLANNED = """, PLAN AS (SELECT v.version, m.model FROM (SELECT DISTINCT version FROM PRED UNION SELECT 2031) v
  CROSS JOIN (SELECT DISTINCT model FROM PRED UNION SELECT 'ridge') m),
VT AS (SELECT PLAN.*, mae, rmse, mape, r2, directional_accuracy FROM PLAN LEFT JOIN SC USING (version, model))"""

ANNOTATED = PLANNED + """, BEST AS (SELECT version, model FROM VT WHERE mae IS NOT NULL AND version BETWEEN 1996 AND 1999
  ORDER BY mae, version, model LIMIT 1),
AN AS (SELECT VT.*, mae IS NULL AS skipped, (SELECT max(mae) FROM VT b WHERE b.version = VT.version AND b.model = 'persistence_monthly') AS baseline_mae,
  CASE WHEN (version, model) IN (SELECT (version, model) FROM BEST) THEN 'recommended_historical'
    WHEN mae IS NULL THEN 'skipped' WHEN version = 2000 THEN 'latest_candidate' ELSE 'historical_backtest' END AS registry_status FROM VT)"""


def version_table(spark, d):
    table = scored(spark, d)
    years = table.select("version").distinct().unionByName(spark.createDataFrame([(2031,)], "version int"))
    names = F.explode(F.array(*[F.lit(m) for m in [*shapes.MODEL_COLUMNS, "ridge"]])).alias("model")
    return s.version_table(years.select("version", names), table)


def annotated(spark, d):
    cells = version_table(spark, d).withColumn("skipped", F.col("mae").isNull())
    return s.annotate_status(cells, [1996, 1997, 1998, 1999], 2000)


METRIC_ROUNDS = ", ".join(f"round({m}, 5) AS {m}" for m in s.METRICS)


@query("e10_version_table", with_shapes("PRED") + SCORED + PLANNED + f" SELECT version, model, {METRIC_ROUNDS} FROM VT")
def version_table_query(spark, d):
    return rounded(version_table(spark, d), 5)


@query(
    "e11_annotate_status",
    with_shapes("PRED") + SCORED + ANNOTATED
    + f""" SELECT version, model, {METRIC_ROUNDS}, skipped, round(baseline_mae, 5) AS baseline_mae,
  round(baseline_mae - mae, 5) AS improvement_vs_baseline, registry_status FROM AN""",
)
def annotate_status(spark, d):
    return rounded(annotated(spark, d), 5)


@query(
    "e12_recommendation",
    with_shapes("PRED") + SCORED + ANNOTATED
    + """, R AS (SELECT version, model, mae FROM AN WHERE registry_status = 'recommended_historical'),
L AS (SELECT model, mae FROM AN WHERE registry_status = 'latest_candidate' ORDER BY mae, model LIMIT 1),
B AS (SELECT mae FROM AN WHERE registry_status = 'latest_candidate' AND model = 'persistence_monthly')
SELECT R.version AS recommended_version, R.model AS recommended_model, round(R.mae, 5) AS recommended_mae,
  L.model AS latest_model, round(L.mae, 5) AS latest_mae, round(B.mae, 5) AS baseline_mae,
  round(B.mae - L.mae, 5) AS improvement_mae, R.model = L.model AS views_agree FROM R, L, B""",
)
def recommendation(spark, d):
    return rounded(s.recommendation(annotated(spark, d)), 5)


@query(
    "e13_metric_series",
    with_shapes("PRED") + SCORED + PLANNED + f""", U AS (SELECT version, model, {METRIC_ROUNDS} FROM VT)
SELECT * FROM (UNPIVOT U ON mae, rmse, mape, r2, directional_accuracy INTO NAME metric VALUE value) WHERE value IS NOT NULL""",
)
def metric_series(spark, d):
    cells = version_table(spark, d).withColumn("skipped", F.col("mae").isNull())
    return rounded(s.metric_series(cells), 5)
