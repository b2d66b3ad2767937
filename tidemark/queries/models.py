"""Models as table operators on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import models as m
from tidemark.operators.aggregates import fold_summary
from tidemark.operators.grids import add_lags, hourly_grid, lag_specs, lead_target
from tidemark.operators.splits import inner_validation, split_chronological, ts_folds
from tidemark.operators.trees import tree_gains, tree_predictions
from tidemark.plans import backtests as bt
from tidemark.plans import shapes
from tidemark.plans.shapes import with_shapes
from tidemark.queries.backtests import (
    AR_SQL, FEATURES, MEDIANS, MODELS, POSITIONS, STUMPS, _holed, _linear_predictions, ar_panel, filled_sql,
)
from tidemark.queries.backtests import holed_panel as gapped_panel
from tidemark.queries.linear import gram_sql, predict_sql, ridge_sql, stump_sql, stump_value
from tidemark.queries.registry import query
from tidemark.queries.tools import rounded
from tidemark.queries.windows import HGRID


@query("m1_predict_column", with_shapes("PRED") + " SELECT area, period_month, y_true, model, y_pred FROM PRED")
def predict_column(spark, d):
    panel = shapes.backtest_panel(spark, d).withColumnRenamed("target", "y_true")
    complete = panel.na.drop(subset=["y_true", *shapes.MODEL_COLUMNS.values()])
    return m.predict_columns(complete, shapes.MODEL_COLUMNS, ["area", "period_month", "y_true"])


@query(
    "m1_predict_column_hourly",
    with_shapes("H")
    + ","
    + HGRID
    + """, L AS (SELECT area, interval_end, lag(price, 24) OVER w AS d, lag(price, 168) OVER w AS k FROM HG
  WINDOW w AS (PARTITION BY area ORDER BY interval_end))
SELECT area, interval_end, 'naive' AS model, d AS y_pred FROM L
UNION ALL SELECT area, interval_end, 'seasonal_naive', k FROM L""",
)
def predict_column_hourly(spark, d):
    grid = hourly_grid(shapes.hourly_price(spark, d).drop("demand"), ["area"])
    lagged = add_lags(grid, ["area"], "interval_end", lag_specs("price", (24, 168), "h"))
    names = {"naive": "price_lag_24h", "seasonal_naive": "price_lag_168h"}
    return m.predict_columns(lagged, names, ["area", "interval_end"])


@query(
    "m2_feature_pool",
    with_shapes("PANEL")
    + """ SELECT area, period_month, observed AS smp_t_observed, lag_1m AS smp_lag_1m, lag_12m AS smp_lag_12m FROM PANEL""",
)
def feature_pool(spark, d):
    panel = shapes.backtest_panel(spark, d).withColumnsRenamed(
        {"observed": "smp_t_observed", "lag_1m": "smp_lag_1m", "lag_12m": "smp_lag_12m"}
    )
    return panel.select("area", "period_month", *m.feature_pool(panel.columns))


HOLED = """, S AS (SELECT area, period_month, CASE WHEN month(period_month) % 4 <> 0 THEN observed END AS observed,
  CASE WHEN area <> '2-HIGH' THEN lag_1m END AS lag_1m, period_month < DATE '1999-01-01' AS is_train FROM PANEL)"""


def holed_panel(spark, d):
    return shapes.backtest_panel(spark, d).select(
        "area", "period_month",
        F.when(F.month("period_month") % 4 != 0, F.col("observed")).alias("observed"),
        F.when(F.col("area") != "2-HIGH", F.col("lag_1m")).alias("lag_1m"),
        (F.col("period_month") < F.lit("1999-01-01").cast("date")).alias("is_train"),
    )


@query(
    "m3_impute_median",
    with_shapes("PANEL")
    + HOLED
    + """, MED AS (SELECT area, median(observed) AS mo, median(lag_1m) AS ml FROM S WHERE is_train GROUP BY 1)
SELECT area, period_month, is_train, round(coalesce(observed, mo, 0), 5) AS observed, round(coalesce(lag_1m, ml, 0), 5) AS lag_1m
FROM S JOIN MED USING (area)""",
)
def impute_median(spark, d):
    return rounded(m.impute_median(holed_panel(spark, d), ["area"], ["observed", "lag_1m"], F.col("is_train")), 5)


@query(
    "m4_standardise",
    with_shapes("PANEL")
    + HOLED
    + """, ST AS (SELECT area, avg(observed) AS m, stddev_pop(observed) AS s FROM S WHERE is_train GROUP BY 1)
SELECT area, period_month, is_train, round((observed - m) / CASE WHEN s = 0 THEN 1 ELSE s END, 8) AS observed
FROM S JOIN ST USING (area)""",
)
def standardise(spark, d):
    panel = holed_panel(spark, d).drop("lag_1m")
    return rounded(m.standardise(panel, ["area"], ["observed"], F.col("is_train")), 8)


TRAINED = """, T AS (SELECT *, period_month < DATE '2000-01-01' AS is_train FROM ARC)"""


def _one_table(features: list[str], name: str, base: str | None = None) -> str:
    """Ridge over the pooled table of all areas, predictions for the later months."""
    columns = [*features, *([base] if base else []), "target"]
    y, b = len(columns) - 1, len(features) if base else None
    return (
        with_shapes("M", "MGRID")
        + AR_SQL
        + TRAINED
        + f", G AS (SELECT {gram_sql(columns)} FROM T WHERE is_train),\n"
        + ridge_sql("G", name, list(range(len(features))), y, base=b)
        + f""" SELECT area, period_month, target, round({predict_sql(name, features, base)}, 5) AS y_pred
FROM T, {name} WHERE NOT is_train"""
    )


def _fitted(spark, d, spec):
    """One table of all areas: fitted on the rows before 2000, applied to the later ones."""
    panel = ar_panel(spark, d).na.drop(subset=[*FEATURES, "target"])
    is_train = F.col("period_month") < F.lit("2000-01-01").cast("date")
    scored = m.fit_predict(panel, [], {"ridge": spec}, "target", is_train).where(~is_train)
    return rounded(scored.select("area", "period_month", "target", "y_pred"), 5, ("target",))


@query("m5_fit_ridge", _one_table(["observed"], "rx"))
def fit_ridge(spark, d):
    return _fitted(spark, d, m.Ridge(("observed",)))


@query("m6_fit_ar_ridge", _one_table(FEATURES, "rx"))
def fit_ar_ridge(spark, d):
    return _fitted(spark, d, m.Ridge(tuple(FEATURES)))


@query("m7_delta_wrap", _one_table(FEATURES[1:], "rx", "observed"))
def delta_wrap(spark, d):
    return _fitted(spark, d, m.delta_wrap(m.Ridge(tuple(FEATURES)), "observed"))


@query(
    "m8_ridge_from_stats",
    with_shapes("M", "MGRID")
    + AR_SQL
    + ", G AS (SELECT area, "
    + gram_sql([*FEATURES, "target"])
    + " FROM ARC GROUP BY area),\n"
    + ridge_sql("G", "rx", [0, 1, 2, 3], 4)
    + " SELECT area, n, "
    + ", ".join(f"round(rx_b{i}, 6) AS b{i}" for i in range(5))
    + " FROM rx",
)
def ridge_from_stats(spark, d):
    stats = m.gram_stats(ar_panel(spark, d), ["area"], [*FEATURES, "target"])
    fitted = m.ridge_from_stats(stats, {"ar": m.Ridge(tuple(FEATURES))}, FEATURES, "target")
    return fitted.select("area", "n", *[F.round(F.get("coef_ar", i), 6).alias(f"b{i}") for i in range(5)])


def _boosted(spark, d):
    split = split_chronological(
        ar_panel(spark, d).na.drop(subset=[*FEATURES, "target"]), ["area"], "period_month"
    )
    train = split.where("split <> 'test'").withColumn("is_inner", F.col("split") == "valid")
    model = m.fit_boosted_trees(train, FEATURES, "target", inner="is_inner", settings=m.BoostSettings(rounds=30))
    return model, split.where("split = 'test'")


@query("m9_fit_boosted_trees")
def fit_boosted_trees(spark, d):
    model, test = _boosted(spark, d)
    return m.apply_model(model, test, FEATURES).select("area", "period_month", "target", "y_pred")


@query("m10_feature_importance")
def feature_importance(spark, d):
    model, _ = _boosted(spark, d)
    return m.feature_importance(spark, model, FEATURES)


_SPLIT = with_shapes("M", "MGRID") + AR_SQL + TRAINED + ", TRAIN AS (SELECT * FROM T WHERE is_train),\n" + stump_sql("TRAIN", "S", FEATURES, "area", "target", 5)


def _marked(spark, d):
    panel = ar_panel(spark, d).na.drop(subset=[*FEATURES, "target"])
    return panel, F.col("period_month") < F.lit("2000-01-01").cast("date")


@query(
    "m9_cell_trees",
    _SPLIT + f" SELECT area, period_month, target, round({stump_value('S', FEATURES)}, 5) AS y_pred FROM T t JOIN S USING (area) WHERE NOT is_train",
)
def cell_trees(spark, d):
    """A tree of one split per area, fitted where the series is."""
    panel, is_train = _marked(spark, d)
    grown = tree_predictions(panel, ["area"], {"y_pred": STUMPS["stump"]}, "target", is_train)
    return rounded(grown.select("area", "period_month", "target", "y_pred"), 5, ("target",))


@query(
    "m10_cell_gains",
    _SPLIT + " SELECT area, f.feature, CAST(S.feature = f.i AS DOUBLE) AS gain FROM S, (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(FEATURES)) + ") f(i, feature)",
)
def cell_gains(spark, d):
    panel, is_train = _marked(spark, d)
    return tree_gains(panel, ["area"], STUMPS["stump"], "target", is_train)


def _cv(panel: str, linear_rows: str, impute: bool = False) -> str:
    """CTEs up to R (fold ranges) and S (scores) of five models; ``linear_rows``: what linear models are laid over."""
    key = "area, fold"
    filled = (
        f"""FM AS (SELECT {key}, {MEDIANS} FROM F1 WHERE role = 'train' GROUP BY ALL),
F AS (SELECT {filled_sql('FM')} FROM F1 t JOIN FM USING ({key}))"""
        if impute else "F AS (SELECT * FROM F1)"
    )
    naive_rows = "ARH" if impute else "ARP"
    return (
        with_shapes("M", "MGRID")
        + panel
        + """, P AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY period_month) - 1 AS pos, count(*) OVER (PARTITION BY area) AS cnt FROM """ + linear_rows + """),
K AS (SELECT P.*, CAST(f AS INTEGER) AS fold, cnt - (5 - f + 1) * (cnt // 6) AS start FROM P, range(1, 6) r(f)),
F0 AS (SELECT *, CASE WHEN pos < start - 1 THEN 'train' WHEN pos >= start AND pos < start + cnt // 6 THEN 'valid' END AS role FROM K),
F1 AS (SELECT * FROM F0 WHERE role IS NOT NULL),
""" + filled + """,
G AS (SELECT area, fold, """
        + gram_sql([*FEATURES, "target"])
        + " FROM F WHERE role = 'train' GROUP BY area, fold),\n"
        + POSITIONS
        + """,
J AS (SELECT F.*, rd.* EXCLUDE (area, fold) FROM F JOIN rd USING (area, fold) WHERE role = 'valid'),
NP AS ("""
        + " UNION ALL ".join(
            f"SELECT '{m}' AS model, area, period_month, target, {c} AS y_pred FROM {naive_rows} WHERE target IS NOT NULL AND {c} IS NOT NULL"
            for m, c in MODELS.naive.items()
    )
        + """),
NQ AS (SELECT *, row_number() OVER (PARTITION BY model, area ORDER BY period_month) - 1 AS pos, count(*) OVER (PARTITION BY model, area) AS cnt FROM NP),
NK AS (SELECT NQ.*, CAST(f AS INTEGER) AS fold, cnt - (5 - f + 1) * (cnt // 6) AS start FROM NQ, range(1, 6) r(f)),
NF AS (SELECT * FROM (SELECT *, CASE WHEN pos < start - 1 THEN 'train' WHEN pos >= start AND pos < start + cnt // 6 THEN 'valid' END AS role FROM NK)
  WHERE role IS NOT NULL),
L AS (SELECT area, fold, period_month, y_true, model, y_pred FROM ("""
        + _linear_predictions("J", "area, fold, period_month")
        + """) UNION ALL SELECT area, fold, period_month, target, model, y_pred FROM NF WHERE role = 'valid'),
A AS (SELECT m.model, area, fold, role, period_month FROM F CROSS JOIN (VALUES ('monthly_ar_ridge'), ('delta_ar_ridge')) m(model)
  UNION ALL SELECT model, area, fold, role, period_month FROM NF),
R AS (SELECT area, fold, model, count(*) FILTER (role = 'train') AS train_n, min(period_month) FILTER (role = 'train') AS train_from,
  max(period_month) FILTER (role = 'train') AS train_to, min(period_month) FILTER (role = 'valid') AS valid_from,
  max(period_month) FILTER (role = 'valid') AS valid_to FROM A GROUP BY 1, 2, 3),
S AS (SELECT area, fold, model, sqrt(avg((y_true - y_pred) ** 2)) AS rmse,
  avg(abs((y_true - y_pred) / greatest(abs(y_true), 1e-8))) * 100 AS mape, avg(abs(y_true - y_pred)) AS mae, count(*) AS valid_n
  FROM L GROUP BY 1, 2, 3)
"""
    )


CV = _cv(AR_SQL, "ARC")


@query(
    "m11_cross_validate",
    CV + """ SELECT area, fold, model, round(rmse, 5) AS rmse, round(mape, 5) AS mape, round(mae, 5) AS mae, valid_n,
  train_n, train_from, train_to, valid_from, valid_to FROM S JOIN R USING (area, fold, model)""",
)
def cross_validate(spark, d):
    _, metrics = bt.cross_validate(ar_panel(spark, d), ["area"], MODELS, "target")
    return rounded(metrics, 5)


@query(
    "m11_cross_validate_imputed",
    _cv(_holed(AR_SQL), "ARH WHERE target IS NOT NULL", impute=True)
    + """ SELECT area, fold, model, round(rmse, 5) AS rmse, round(mape, 5) AS mape, round(mae, 5) AS mae, valid_n,
  train_n, train_from, train_to, valid_from, valid_to FROM S JOIN R USING (area, fold, model)""",
)
def cross_validate_imputed(spark, d):
    _, metrics = bt.cross_validate(gapped_panel(spark, d), ["area"], MODELS, "target", impute=True)
    return rounded(metrics, 5)


@query(
    "m11_cross_validation_summary",
    CV + """ SELECT area, model, count(*) AS n_folds, round(avg(rmse), 5) AS rmse_mean, round(stddev_pop(rmse), 5) AS rmse_std,
  round(avg(mape), 5) AS mape_mean, round(stddev_pop(mape), 5) AS mape_std, round(avg(mae), 5) AS mae_mean,
  round(stddev_pop(mae), 5) AS mae_std FROM S GROUP BY 1, 2""",
)
def cross_validation_summary(spark, d):
    _, metrics = bt.cross_validate(ar_panel(spark, d), ["area"], MODELS, "target")
    return rounded(fold_summary(metrics, ["rmse", "mape", "mae"], ["area", "model"]), 5)
