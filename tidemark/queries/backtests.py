"""Splits, folds and backtests on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import checks as ck
from tidemark.operators import splits as sp
from tidemark.operators.grids import LagSpec, RollSpec, add_lags_and_rolls, lead_target, monthly_grid
from tidemark.operators.models import Ridge
from tidemark.operators.trees import Boosting, Trees
from tidemark.plans import backtests as bt
from tidemark.plans import shapes
from tidemark.plans.shapes import with_shapes
from tidemark.queries.linear import gram_sql, predict_sql, ridge_sql, stump_sql, stump_value
from tidemark.queries.registry import query
from tidemark.queries.tools import rounded

FEATURES = ["observed", "lag_1m", "roll_3m", "lag_12m"]


def ar_panel(spark, d, gaps: bool = False):
    """Gridded panel with the autoregressive features and a one-month target."""
    prices = shapes.monthly_price_with_gaps(spark, d) if gaps else shapes.monthly_price(spark, d)
    grid = monthly_grid(prices.withColumnRenamed("price", "observed"), ["area"])
    lagged = add_lags_and_rolls(
        grid, ["area"], "period_month",
        [LagSpec("observed", 1, "lag_1m"), LagSpec("observed", 12, "lag_12m")],
        [RollSpec("observed", 3, "mean", "roll_3m")],
    )
    return lead_target(lagged, ["area"], "period_month", "observed", 1)


AR_SQL = """, ARP AS (
  SELECT area, period_month, observed, lag(observed, 1) OVER w AS lag_1m, lag(observed, 12) OVER w AS lag_12m,
    CASE WHEN count(observed) OVER r = 3 THEN avg(observed) OVER r END AS roll_3m, lead(observed, 1) OVER w AS target
  FROM (SELECT area, period_month, price AS observed FROM MGRID)
  WINDOW w AS (PARTITION BY area ORDER BY period_month),
         r AS (PARTITION BY area ORDER BY period_month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
ARC AS (SELECT * FROM ARP WHERE observed IS NOT NULL AND lag_1m IS NOT NULL AND lag_12m IS NOT NULL
  AND roll_3m IS NOT NULL AND target IS NOT NULL)"""

VERSIONS = [
    sp.Version("v1", "1997-12-01", "1997-12-01", "1998-01-01", "1998-12-01"),
    sp.Version("v2", "1998-12-01", "1998-12-01", "1999-01-01", "1999-12-01"),
    sp.Version("v3", "1999-12-01", "1999-12-01", "2000-01-01", "2000-06-01"),
    sp.Version("v4", "2000-12-01", "2000-12-01", window=6),
]
MODELS = bt.ModelSet(
    naive={"persistence_monthly": "observed", "naive_lag_1m": "lag_1m", "seasonal_naive_lag_12m": "lag_12m"},
    linear={
        "monthly_ar_ridge": Ridge(tuple(FEATURES)),
        "delta_ar_ridge": Ridge(tuple(FEATURES[1:]), delta_from="observed"),
    },
    min_train={"monthly_ar_ridge": 36, "delta_ar_ridge": 36, "persistence_monthly": 24,
               "naive_lag_1m": 24, "seasonal_naive_lag_12m": 24},
)


@query(
    "b1_split_chronological",
    with_shapes("M")
    + """, P AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY period_month) - 1 AS pos,
  count(*) OVER (PARTITION BY area) AS n FROM M)
SELECT area, period_month, price, CASE
  WHEN pos < n - CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) * 2 THEN 'train'
  WHEN pos < n - CAST(floor(n * CAST(0.15 AS DOUBLE)) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM P""",
)
def split_chronological(spark, d):
    return sp.split_chronological(shapes.monthly_price(spark, d), ["area"], "period_month")


FOLDS = """, P AS (SELECT area, period_month, row_number() OVER (PARTITION BY area ORDER BY period_month) - 1 AS pos,
  count(*) OVER (PARTITION BY area) AS n FROM M),
K AS (SELECT *, CAST(f AS INTEGER) AS fold, n - (5 - f + 1) * (n // 6) AS start FROM P, range(1, 6) r(f)),
FOLDS AS (SELECT area, period_month, fold, CASE WHEN pos < start - 1 THEN 'train'
  WHEN pos >= start AND pos < start + n // 6 THEN 'valid' END AS role FROM K)"""


@query("b2_ts_folds", with_shapes("M") + FOLDS + " SELECT * FROM FOLDS WHERE role IS NOT NULL")
def ts_folds(spark, d):
    months = shapes.monthly_price(spark, d).drop("price")
    return sp.ts_folds(months, ["area"], "period_month", k=5, embargo=1)


@query(
    "b3_inner_validation",
    with_shapes("M")
    + FOLDS
    + """, T AS (SELECT *, row_number() OVER (PARTITION BY area, fold ORDER BY period_month) - 1 AS pos,
  count(*) OVER (PARTITION BY area, fold) AS n FROM FOLDS WHERE role = 'train')
SELECT area, period_month, fold, role, n >= 30 AND pos >= greatest(1, least(CAST(floor(n * CAST(0.85 AS DOUBLE)) AS BIGINT), n - 2)) AS is_inner FROM T""",
)
def inner_validation(spark, d):
    months = shapes.monthly_price(spark, d).drop("price")
    return sp.inner_validation(sp.ts_folds(months, ["area"], "period_month"), ["area"], "period_month")


def _holdout_sql(versions) -> str:
    parts = []
    for v in versions:
        parts.append(
            f"SELECT area, period_month, '{v.name}' AS version, 'train' AS role FROM PANEL WHERE target IS NOT NULL AND "
            f"CAST(period_month + INTERVAL 1 MONTH AS DATE) <= DATE '{v.cutoff}' AND period_month <= DATE '{v.train_end}'"
        )
        parts.append(
            f"SELECT area, period_month, '{v.name}', 'test' FROM PANEL WHERE target IS NOT NULL AND "
            f"period_month BETWEEN DATE '{v.test_start}' AND DATE '{v.test_end}'"
        )
    return " UNION ALL ".join(parts)


@query("b4_fixed_holdout", with_shapes("PANEL") + _holdout_sql(VERSIONS[:3]))
def fixed_holdout(spark, d):
    panel = shapes.backtest_panel(spark, d).select("area", "period_month", "target")
    return sp.fixed_holdout(panel, VERSIONS[:3], 1).drop("target")


@query(
    "b5_rolling_validation",
    with_shapes("PANEL")
    + """, E AS (SELECT CAST(DATE '2000-11-01' - to_months(CAST(k AS INTEGER)) AS DATE) AS eval_month FROM range(0, 6) r(k))
SELECT area, period_month, eval_month, CASE WHEN period_month = eval_month THEN 'test' ELSE 'train' END AS role
FROM PANEL, E WHERE target IS NOT NULL AND
  (period_month = eval_month OR CAST(period_month + INTERVAL 1 MONTH AS DATE) < eval_month)""",
)
def rolling_validation(spark, d):
    panel = shapes.backtest_panel(spark, d).select("area", "period_month", "target")
    return sp.rolling_validation(panel, "2000-12-01", 6, 1).drop("target")


def _linear_predictions(source: str, keep: str) -> str:
    """The linear models' predictions from a CTE that holds the features and both sets of coefficients."""
    exprs = {"monthly_ar_ridge": predict_sql("ra", FEATURES), "delta_ar_ridge": predict_sql("rd", FEATURES[1:], "observed")}
    return " UNION ALL ".join(f"SELECT {keep}, target AS y_true, '{m}' AS model, {e} AS y_pred FROM {source}" for m, e in exprs.items())


def _long_predictions(naive: str, linear: str, keep: str) -> str:
    """Five models' predictions: naive ones from one CTE, linear ones from one with their coefficients."""
    repeated = [f"SELECT {keep}, target AS y_true, '{m}' AS model, {c} AS y_pred FROM {naive}" for m, c in MODELS.naive.items()]
    return " UNION ALL ".join([*repeated, _linear_predictions(linear, keep)])


POSITIONS = ridge_sql("G", "ra", [0, 1, 2, 3], 4) + ",\n" + ridge_sql("ra", "rd", [1, 2, 3], 4, base=0)


@query(
    "b6_walk_forward",
    with_shapes("M", "MGRID")
    + AR_SQL
    + ", G AS (SELECT area, period_month, observed, lag_1m, roll_3m, lag_12m, target, "
    + gram_sql([*FEATURES, "target"], "w")
    + """ FROM ARC WINDOW w AS (PARTITION BY area ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  QUALIFY count(*) OVER w >= 24),
"""
    + POSITIONS
    + """, NAIVE AS (SELECT * FROM (SELECT *, count(target) OVER (PARTITION BY area ORDER BY period_month
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM ARP) WHERE target IS NOT NULL AND known >= 24),
LONG AS (SELECT * FROM ("""
    + _long_predictions("NAIVE", "rd", "area, period_month, observed")
    + """) WHERE y_pred IS NOT NULL)
SELECT area, period_month, y_true, observed AS observed_value, model, round(y_pred, 6) AS y_pred,
  period_month AS forecast_origin_month, CAST(period_month + INTERVAL 1 MONTH AS DATE) AS target_month,
  y_true - observed AS true_delta, round(y_pred - observed, 6) AS predicted_delta FROM LONG""",
)
def walk_forward(spark, d):
    out = bt.walk_forward(ar_panel(spark, d), ["area"], MODELS, "target", "observed")
    return rounded(out, 6, ("y_true", "observed_value", "true_delta"))


HOLES = "CASE WHEN month(period_month) % 4 = 0 THEN NULL ELSE roll_3m END AS roll_3m"


def holed_panel(spark, d):
    """The panel without one feature in every fourth month: naive models must not notice."""
    hole = F.when(F.month("period_month") % 4 == 0, None).otherwise(F.col("roll_3m"))
    return ar_panel(spark, d).withColumn("roll_3m", hole)


def _holed(sql: str) -> str:
    return sql.replace("ARC AS (SELECT * FROM ARP", f"ARH AS (SELECT * REPLACE ({HOLES}) FROM ARP),\nARC AS (SELECT * FROM ARH")


_CELL = "version, eval_month, area"


def filled_sql(medians: str) -> str:
    """Select-list of the rows ``t`` with holes in the features filled from ``medians`` (``m_<feature>``)."""
    fills = ", ".join(f"coalesce(t.{c}, {medians}.m_{c}, 0) AS {c}" for c in FEATURES)
    return f"t.* REPLACE ({fills})"


MEDIANS = ", ".join(f"median({c}) AS m_{c}" for c in FEATURES)


@query(
    "b6_walk_forward_imputed",
    with_shapes("M", "MGRID")
    + _holed(AR_SQL)
    + ", MEDS AS (SELECT *, "
    + ", ".join(f"median(CASE WHEN target IS NOT NULL THEN {c} END) OVER w AS m_{c}" for c in FEATURES)
    + """ FROM ARH WINDOW w AS (PARTITION BY area ORDER BY period_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
PAST AS (SELECT s.area, s.period_month, """
    + ", ".join(f"coalesce(t.{c}, s.m_{c}, 0) AS {c}" for c in FEATURES)
    + """, t.target FROM MEDS s JOIN ARH t ON t.area = s.area AND t.period_month < s.period_month AND t.target IS NOT NULL),
G AS (SELECT area, period_month, """
    + gram_sql([*FEATURES, "target"])
    + " FROM PAST GROUP BY area, period_month HAVING count(*) >= 24),\n"
    + POSITIONS
    + ", J AS (SELECT s.area, s.period_month, s.target, s.observed AS seen, "
    + ", ".join(f"coalesce(s.{c}, s.m_{c}, 0) AS {c}" for c in FEATURES)
    + """, rd.* EXCLUDE (area, period_month) FROM MEDS s JOIN rd USING (area, period_month) WHERE s.target IS NOT NULL),
NAIVE AS (SELECT *, observed AS seen FROM (SELECT *, count(target) OVER (PARTITION BY area ORDER BY period_month
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM ARH) WHERE target IS NOT NULL AND known >= 24),
LONG AS (SELECT * FROM ("""
    + _long_predictions("NAIVE", "J", "area, period_month, seen")
    + """) WHERE y_pred IS NOT NULL)
SELECT area, period_month, y_true, seen AS observed_value, model, round(y_pred, 5) AS y_pred,
  period_month AS forecast_origin_month, CAST(period_month + INTERVAL 1 MONTH AS DATE) AS target_month,
  y_true - seen AS true_delta, round(y_pred - seen, 5) AS predicted_delta FROM LONG""",
)
def walk_forward_imputed(spark, d):
    """Holes are filled, step by step, with the median of the rows known by then; every step is predicted."""
    out = bt.walk_forward(holed_panel(spark, d), ["area"], MODELS, "target", "observed", impute=True)
    return rounded(out, 5, ("y_true", "observed_value", "true_delta"))


def cell_rows() -> tuple[list[str], list[str]]:
    """Selections of the training and the test rows of every version from ARP."""
    train, test = [], []
    for v in VERSIONS:
        if v.window:
            months = "(SELECT CAST(DATE '2000-11-01' - to_months(CAST(k AS INTEGER)) AS DATE) AS e FROM range(0, 6) r(k))"
            train.append(
                f"SELECT '{v.name}' AS version, e AS eval_month, ARP.* FROM ARP, {months} "
                "WHERE CAST(period_month + INTERVAL 1 MONTH AS DATE) < e"
            )
            test.append(f"SELECT '{v.name}' AS version, e AS eval_month, ARP.* FROM ARP, {months} WHERE period_month = e")
        else:
            train.append(
                f"SELECT '{v.name}' AS version, DATE '1900-01-01' AS eval_month, ARP.* FROM ARP WHERE "
                f"CAST(period_month + INTERVAL 1 MONTH AS DATE) <= DATE '{v.cutoff}' AND period_month <= DATE '{v.train_end}'"
            )
            test.append(
                f"SELECT '{v.name}' AS version, DATE '1900-01-01' AS eval_month, ARP.* FROM ARP WHERE "
                f"period_month BETWEEN DATE '{v.test_start}' AND DATE '{v.test_end}'"
            )
    return train, test


def _matrix_sql(impute: bool = False) -> str:
    train, test = cell_rows()
    pool = " UNION ALL ".join(
        f"SELECT area, '{v.name}' AS version, '{v.mode}' AS evaluation_mode, count(*) FILTER ("
        f"CAST(period_month + INTERVAL 1 MONTH AS DATE) <= DATE '{v.cutoff}' AND period_month <= DATE '{v.train_end}') AS n_train "
        "FROM ARP GROUP BY area"
        for v in VERSIONS
    )
    complete = " AND ".join(f"{c} IS NOT NULL" for c in [*FEATURES, "target"])
    needs = ", ".join(f"('{m}', {MODELS.min_train[m]})" for m in MODELS.names)
    rows = f"SELECT * FROM ({' UNION ALL '.join(train)}) WHERE"
    if impute:
        known = f"""TRAIN0 AS ({rows} target IS NOT NULL),
MED AS (SELECT {_CELL}, {MEDIANS} FROM TRAIN0 GROUP BY ALL),
TRAIN AS (SELECT {filled_sql('MED')} FROM TRAIN0 t JOIN MED USING ({_CELL}))"""
        joined = f"SELECT {filled_sql('MED')}, rd.* EXCLUDE ({_CELL}) FROM TEST t JOIN MED USING ({_CELL}) JOIN rd USING ({_CELL})"
    else:
        known = f"TRAIN AS ({rows} {complete})"
        joined = f"SELECT TEST.*, rd.* EXCLUDE ({_CELL}) FROM TEST JOIN rd USING ({_CELL})"
    return f""", {known},
TEST AS (SELECT * FROM ({' UNION ALL '.join(test)}) WHERE target IS NOT NULL),
G AS (SELECT version, eval_month, area, {gram_sql([*FEATURES, 'target'])} FROM TRAIN GROUP BY ALL),
{POSITIONS},
J AS ({joined}),
LONG AS (SELECT * FROM ({_long_predictions('TEST', 'J', 'version, area, period_month')}) WHERE y_pred IS NOT NULL),
STEP AS (SELECT *, CAST(sign(y_true - lag(y_true) OVER w) = sign(y_pred - lag(y_pred) OVER w) AS DOUBLE) AS same
  FROM LONG WINDOW w AS (PARTITION BY version, model, area ORDER BY period_month)),
S AS (SELECT version, model, area, count(*) AS n, avg(abs(y_true - y_pred)) AS mae,
  sqrt(avg((y_true - y_pred) ** 2)) AS rmse, avg(abs((y_true - y_pred) / y_true)) * 100 AS mape,
  CASE WHEN var_pop(y_true) * count(*) >= 1e-12 THEN 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) END AS r2,
  avg(same) AS directional_accuracy FROM STEP GROUP BY 1, 2, 3),
PLAN AS (SELECT pool.*, m.model, m.min_train FROM ({pool}) pool CROSS JOIN (VALUES {needs}) m(model, min_train)),
OUT AS (SELECT PLAN.*, S.* EXCLUDE (version, model, area), CASE
  WHEN n_train < min_train THEN 'n_train=' || n_train || ' < min_train_rows=' || min_train
  WHEN n IS NULL THEN 'no rows to evaluate' END AS skip_reason
  FROM PLAN LEFT JOIN S USING (version, model, area))
"""


MATRIX_COLUMNS = """version, model, area, evaluation_mode, n_train,
  CASE WHEN skip_reason IS NULL THEN n ELSE 0 END AS n_test,
  CASE WHEN skip_reason IS NULL THEN round(mae, 5) END AS mae, CASE WHEN skip_reason IS NULL THEN round(rmse, 5) END AS rmse,
  CASE WHEN skip_reason IS NULL THEN round(mape, 5) END AS mape, CASE WHEN skip_reason IS NULL THEN round(r2, 5) END AS r2,
  CASE WHEN skip_reason IS NULL THEN round(directional_accuracy, 5) END AS directional_accuracy,
  skip_reason IS NOT NULL AS skipped, skip_reason"""


@query("b7_backtest_matrix", with_shapes("M", "MGRID") + AR_SQL + _matrix_sql() + f"SELECT {MATRIX_COLUMNS} FROM OUT")
def backtest_matrix(spark, d):
    return rounded(bt.backtest_matrix(ar_panel(spark, d), ["area"], VERSIONS, MODELS, "target"), 5)


@query(
    "b7_backtest_matrix_with_holes",
    with_shapes("M", "MGRID") + _holed(AR_SQL) + _matrix_sql().replace("ARP.*", "ARH.*").replace("FROM ARP", "FROM ARH")
    + f"SELECT {MATRIX_COLUMNS} FROM OUT",
)
def backtest_matrix_with_holes(spark, d):
    """Each model is fitted and scored on the rows that it can use itself."""
    return rounded(bt.backtest_matrix(holed_panel(spark, d), ["area"], VERSIONS, MODELS, "target"), 5)


@query(
    "b7_backtest_matrix_imputed",
    with_shapes("M", "MGRID") + _holed(AR_SQL) + _matrix_sql(impute=True).replace("ARP.*", "ARH.*").replace("FROM ARP", "FROM ARH")
    + f"SELECT {MATRIX_COLUMNS} FROM OUT",
)
def backtest_matrix_imputed(spark, d):
    """Linear models fill holes with the medians of their own training rows, as in service."""
    return rounded(bt.backtest_matrix(holed_panel(spark, d), ["area"], VERSIONS, MODELS, "target", impute=True), 5)


GROUPS = {
    "observed_only": ["observed"],
    "lags_without_observed": ["lag_1m", "lag_12m", "roll_3m"],
    "calendar_only": ["quarter", "is_summer"],
    "observed_plus_calendar": ["observed", "quarter", "is_summer"],
    "all_features": ["observed", "lag_1m", "lag_12m", "roll_3m", "quarter", "is_summer"],
}


def _ablation_sql() -> str:
    columns = list(dict.fromkeys(c for cols in GROUPS.values() for c in cols))
    at = {c: i for i, c in enumerate([*columns, "target"])}
    ctes, longs, previous = [], [], "G"
    for k, (name, cols) in enumerate(GROUPS.items()):
        r = f"r{k}x"
        ctes.append(ridge_sql(previous, r, [at[c] for c in cols], at["target"]))
        previous = r
        longs.append((name, "ridge", predict_sql(r, cols)))
        if "observed" in cols:
            longs.append((name, "persistence_monthly", "observed"))
            rest = [c for c in cols if c != "observed"]
            if rest:
                q = f"d{k}x"
                ctes.append(ridge_sql(previous, q, [at[c] for c in rest], at["target"], base=at["observed"]))
                previous = q
                longs.append((name, "delta_ridge", predict_sql(q, rest, "observed")))
    fill = ", ".join(
        f"coalesce(CAST({c} AS DOUBLE), median(CAST({c} AS DOUBLE)) FILTER (split = 'train') OVER (PARTITION BY area), 0) AS {c}"
        for c in columns
    )
    union = " UNION ALL ".join(
        f"SELECT area, '{g}' AS feature_group, '{m}' AS model, target AS y_true, observed, {e} AS y_pred FROM J"
        for g, m, e in longs
    )
    sizes = " ".join(f"WHEN '{n}' THEN {len(cols)}" for n, cols in GROUPS.items())
    return f""", P0 AS (SELECT *, CAST(quarter(period_month) AS DOUBLE) AS quarter,
    CAST(month(period_month) IN (6, 7, 8) AS DOUBLE) AS is_summer FROM ARP WHERE target IS NOT NULL),
P AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY period_month) - 1 AS pos, count(*) OVER (PARTITION BY area) AS cnt FROM P0),
SPLIT AS (SELECT *, CASE WHEN pos < cnt - 2 * CAST(floor(cnt * CAST(0.15 AS DOUBLE)) AS BIGINT) THEN 'train'
  WHEN pos < cnt - CAST(floor(cnt * CAST(0.15 AS DOUBLE)) AS BIGINT) THEN 'valid' ELSE 'test' END AS split FROM P),
FILLED AS (SELECT area, period_month, split, target, {fill} FROM SPLIT),
G AS (SELECT area, {gram_sql([*columns, 'target'])} FROM FILLED WHERE split = 'train' GROUP BY area),
{','.join(ctes)},
J AS (SELECT t.*, c.* EXCLUDE (area) FROM FILLED t JOIN {previous} c ON c.area = t.area WHERE split = 'test'),
L AS ({union})
SELECT area, feature_group, model, round(avg(abs(y_true - y_pred)), 5) AS mae, round(sqrt(avg((y_true - y_pred) ** 2)), 5) AS rmse,
  round(avg(abs((y_true - y_pred) / y_true)) * 100, 5) AS mape,
  round(avg(abs(y_true - y_pred) / ((abs(y_true) + abs(y_pred)) / 2)) * 100, 5) AS smape,
  round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)), 5) AS r2, count(*) AS n,
  round(avg(abs((y_true - observed) - (y_pred - observed))), 5) AS delta_mae,
  round(avg(CAST(sign(y_true - observed) = sign(y_pred - observed) AS DOUBLE)) FILTER (y_true <> observed), 5) AS delta_direction_accuracy,
  CAST(CASE feature_group {sizes} END AS INTEGER) AS n_features
FROM L GROUP BY 1, 2, 3"""


STUMP = Boosting(rounds=1, depth=1, step=1.0, leaf_rows=5)
STUMPS = {"stump": Trees(tuple(FEATURES), STUMP), "delta_stump": Trees(tuple(FEATURES), STUMP).delta_wrap("observed")}


@query(
    "b7_backtest_stumps",
    with_shapes("M", "MGRID") + AR_SQL
    + f""", TRAIN AS ({' UNION ALL '.join(cell_rows()[0]).replace('ARP', 'ARC')}),
TEST AS ({' UNION ALL '.join(cell_rows()[1]).replace('ARP', 'ARC')}),
{stump_sql('TRAIN', 'S', FEATURES, _CELL, 'target', 5)},
{stump_sql('TRAIN', 'D', FEATURES[1:], _CELL, 'target - observed', 5)}
SELECT version, area, period_month, target AS y_true, 'stump' AS model, round({stump_value('S', FEATURES)}, 5) AS y_pred
FROM TEST t JOIN S USING ({_CELL})
UNION ALL SELECT version, area, period_month, target, 'delta_stump', round(observed + {stump_value('D', FEATURES[1:])}, 5)
FROM TEST t JOIN D USING ({_CELL})""",
)
def backtest_stumps(spark, d):
    """Trees in the version grid, plain and under the delta wrap; of one split each, so that SQL can follow."""
    panel = ar_panel(spark, d).na.drop(subset=[*FEATURES, "target"])
    return rounded(bt.backtest_predictions(panel, ["area"], VERSIONS, bt.ModelSet(trees=STUMPS), "target"), 5, ("y_true",))


@query("b8_ablation", with_shapes("M", "MGRID") + AR_SQL + _ablation_sql())
def ablation(spark, d):
    panel = ar_panel(spark, d).withColumns(
        {"quarter": F.quarter("period_month"), "is_summer": F.month("period_month").isin(6, 7, 8)}
    )
    return rounded(bt.ablation(panel, ["area"], GROUPS, "target", "observed"), 5)


@query(
    "v7_suffix_contract",
    with_shapes("M", "MGRID") + AR_SQL + " " + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n_values FROM ARP" for c in ("observed", "lag_12m", "roll_3m", "target")
    ),
)
def suffix_contract(spark, d):
    """Columns of the autoregressive panel whose name does not say that they lag, with the values they hold."""
    named = ar_panel(spark, d).withColumnRenamed("lag_1m", "price_lag_1m")
    return ck.suffix_findings(named, ["area", "period_month"])
