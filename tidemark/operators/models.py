"""Models as table operators.

Linear models are fitted from sufficient statistics: means and covariances per cell are
ordinary mergeable aggregates (or one running window for a walk-forward), so any number of cells is
fitted in one pass, and only a p-by-p system per cell reaches Python. Trees use Spark ML.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quantiles import medians

ALPHA = 1.0
#: a deviation of less than this share of the mean is rounding
FLAT = 2e-15

# fixed values: default feature pools
HOURLY_POOL = (
    "demand_forecast_mw", "demand_lag_24h", "demand_lag_168h", "smp_lag_1h", "smp_lag_24h",
    "smp_lag_168h", "smp_rolling_24h_mean", "smp_rolling_7d_mean", "hour_sin", "hour_cos",
    "dow_sin", "dow_cos", "month",
)
MONTHLY_POOL = (
    "smp_t_observed", "smp_lag_1m", "smp_lag_2m", "smp_lag_3m", "smp_lag_6m", "smp_lag_12m",
    "smp_rolling_3m_mean", "smp_rolling_6m_mean", "smp_rolling_12m_mean", "smp_rolling_12m_std",
    "month_sin", "month_cos", "quarter",
    "lng_price_usd_per_mmbtu_lag_1m", "lng_price_usd_per_mmbtu_lag_2m", "lng_price_chg_1m_lag_1m",
    "settlement_unit_price_total_lag_1m", "settlement_unit_price_nuclear_lag_1m",
    "settlement_unit_price_coal_total_lag_1m", "settlement_unit_price_lng_lag_1m",
    "settlement_unit_price_renewable_lag_1m",
)
AR_POOL = (
    "smp_t_observed", "smp_lag_1m", "smp_rolling_3m_mean", "smp_lag_12m",
    "lng_price_usd_per_mmbtu_lag_1m", "lng_price_chg_1m_lag_1m",
)
OBSERVED = "smp_t_observed"
MONTHLY_MARKS = ("_lag_1m", "_lag_12m", "_lag_1y")


def predict_columns(
    df: DataFrame, models: Mapping[str, str], keep: Sequence[str], out: str = "y_pred"
) -> DataFrame:
    """Naive models at once: each predicts with one column; long by ``model``."""
    wide = df.select(*keep, *[F.col(c).cast("double").alias(m) for m, c in models.items()])
    return wide.unpivot(list(keep), list(models), "model", out)


#: what names of features say: a lag of some hours, days, months or years, a window, a forward price, or a part of the calendar
FEATURE_NAMES = (
    r"_lag_\d+[hdmy]$|_rolling_\d+[hdm]_\w+$|^forward_\w+$|^(is_\w+|(hour|dow|month)_(sin|cos)|year|quarter|month|day|hour|day_of_week)$"
)


def features_by_name(columns: Sequence[str], observed: Sequence[str] = ()) -> list[str]:
    """Columns that their names mark as known at the forecast's origin, and the observed ones, in the table's order."""
    return [c for c in columns if c in observed or re.search(FEATURE_NAMES, c)]


def feature_pool(
    columns: Sequence[str], explicit: Sequence[str] | None = None, ar_only: bool = False,
    observed: str = OBSERVED, monthly: Sequence[str] = MONTHLY_POOL, hourly: Sequence[str] = HOURLY_POOL,
    ar: Sequence[str] = AR_POOL,
) -> list[str]:
    """Feature names a linear model uses on a table with these columns.

    An explicit list must be there in full. Otherwise the default pool of the table's
    granularity, and where that does not meet the table, the columns that are features by their
    names, or if none is, every column.
    """
    if explicit is not None:
        missing = [c for c in explicit if c not in columns]
        if missing:
            raise KeyError(f"requested features missing: {missing}")
        return list(explicit)
    if ar_only:
        chosen = [c for c in ar if c in columns]
        if not chosen:
            raise KeyError(f"none of {list(ar)} in the table")
        return chosen
    is_monthly = observed in columns or any(c.endswith(MONTHLY_MARKS) for c in columns)
    chosen = [c for c in (monthly if is_monthly else hourly) if c in columns]
    return chosen or features_by_name(columns) or list(columns)


def _with_cell_values(df: DataFrame, by: Sequence[str], values: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with the values of their cell; a table without cells gets the one row as one scalar."""
    if by:
        return df.join(values, list(by), "left")
    whole = df.withColumn("_cell", values.select(F.struct(*names)).scalar())
    return whole.select(*df.columns, "_cell.*")


def impute_median(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], is_train: Column, all_null: float | None = 0.0
) -> DataFrame:
    """Fill nulls with the exact training median of the cell, on training and other rows alike.

    A column without any training value gets ``all_null``. Cells may be of any size.
    """
    names = {c: f"_med_{c}" for c in columns}
    found = medians(df.where(is_train), by, columns)
    wide = found.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("median"))).alias(n) for c, n in names.items()])
    joined = _with_cell_values(df, by, wide, list(names.values()))
    return _filled(joined, names, all_null).drop(*names.values())


def impute_series(
    df: DataFrame, cell: Sequence[str], columns: Sequence[str], is_train: Column, all_null: float | None = 0.0
) -> DataFrame:
    """The same for cells that hold one gridded series: the calendar bounds them, so one window per cell does it."""
    names = {c: f"_med_{c}" for c in columns}
    over = Window.partitionBy(*cell)
    found = {n: F.percentile(F.when(is_train, F.col(c).cast("double")), 0.5).over(over) for c, n in names.items()}
    return _filled(df.withColumns(found), names, all_null).drop(*names.values())


def _filled(df: DataFrame, medians_of: Mapping[str, str], all_null: float | None) -> DataFrame:
    fallback = [F.lit(all_null)] if all_null is not None else []
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(n), *fallback) for c, n in medians_of.items()})


def standardise(df: DataFrame, by: Sequence[str], columns: Sequence[str], is_train: Column) -> DataFrame:
    """(x - mean) / population deviation from training rows; a constant column becomes zero."""
    names = [f"{p}{c}" for c in columns for p in ("_m_", "_s_")]
    stats = df.where(is_train).groupBy(*by).agg(*[f(c).alias(f"{p}{c}") for c in columns for p, f in (("_m_", F.avg), ("_s_", F.stddev_pop))])
    joined = _with_cell_values(df, by, stats, names)
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, 1.0).otherwise(F.col(f"_s_{c}"))
        for c in columns
    }
    return joined.withColumns(scaled).drop(*names)


# --- sufficient statistics -------------------------------------------------------------


def _complete(columns: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


def with_refs(df: DataFrame, columns: Sequence[str], group: Sequence[str], ts: str) -> DataFrame:
    """``_ref_<column>``: a value of the column in its series (the first), for statistics about it.

    Differences to a value of like size are exact, so columns of any size and little spread keep their
    digits. The window is that of the lags, without another shuffle or sort.
    """
    whole = Window.partitionBy(*group).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumns({f"_ref_{c}": F.first(F.col(c).cast("double"), ignorenulls=True).over(whole) for c in columns})


def _stat_sql(columns: Sequence[str], keep: str, over: str = "", suffix: str = "") -> list[str]:
    """Row count, means and upper-triangle covariances of the rows for which ``keep`` holds, about ``_ref_<column>``.

    Both are updated and merged about running means; raw sums of products would lose digits.
    """
    kept = [f"CASE WHEN {keep} THEN CAST(`{c}` AS DOUBLE) - `_ref_{c}` END" for c in columns]
    refs = [f"`_ref_{c}`" if over else f"max(`_ref_{c}`)" for c in columns]
    means = ", ".join(f"{r} + avg({k}) {over}" for r, k in zip(refs, kept))
    pairs = ", ".join(f"covar_pop({a}, {b}) {over}" for i, a in enumerate(kept) for b in kept[i:])
    return [
        f"CAST(count(CASE WHEN {keep} THEN 1 END) {over} AS DOUBLE) AS n{suffix}",
        f"array({means}) AS means{suffix}", f"array({pairs}) AS cov{suffix}",
    ]


def gram_stats(df: DataFrame, by: Sequence[str], columns: Sequence[str], is_train: Column | None = None) -> DataFrame:
    """``by``, ``n``, ``means``, ``cov`` over the complete training rows of each cell, of any size.

    A first aggregation finds the cell's means, a second what the rows are about them.
    """
    keep = _complete(columns) if is_train is None else _complete(columns) & is_train
    rows = df.where(keep).select(*by, *columns)
    refs = {c: f"_ref_{c}" for c in columns}
    centres = rows.groupBy(*by).agg(*[F.avg(F.col(c).cast("double")).alias(r) for c, r in refs.items()])
    about = _with_cell_values(rows, by, centres, list(refs.values()))
    return about.groupBy(*by).agg(*[F.expr(e) for e in _stat_sql(columns, "true")])


def gram_sets(df: DataFrame, by: Sequence[str], sets: Sequence[Sequence[str]], is_train: Column) -> DataFrame:
    """``n<k>, means<k>, cov<k>`` of each set of columns, over its own complete training rows, in one aggregation.

    ``df`` has the columns of ``with_refs``.
    """
    marked = df.where(is_train).withColumns({f"_keep{k}": _complete(cols) for k, cols in enumerate(sets)})
    return marked.groupBy(*by).agg(*[F.expr(e) for k, cols in enumerate(sets) for e in _stat_sql(cols, f"_keep{k}", suffix=str(k))])


def expanding_gram(
    df: DataFrame, group: Sequence[str], ts: str, columns: Sequence[str], target: str, horizon: int = 1, suffix: str = ""
) -> DataFrame:
    """The same over all earlier rows whose target is known at each row, as one running window.

    ``df`` is a gridded series: the target of a row lies ``horizon`` rows later, so the last
    ``horizon - 1`` rows before the current one are not trained on.
    """
    names = [*columns, target]
    part = f"PARTITION BY {', '.join(f'`{g}`' for g in group)} " if group else ""
    over = f"OVER ({part}ORDER BY `{ts}` ROWS BETWEEN UNBOUNDED PRECEDING AND {horizon} PRECEDING)"
    flag, refs = f"_keep{suffix}", [f"_ref_{c}" for c in names]
    marked = with_refs(df, names, group, ts).withColumn(flag, _complete(names))
    return marked.selectExpr("*", *_stat_sql(names, flag, over, suffix)).drop(flag, *refs)


def running_medians(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """At each place the exact median of the known values before it, NaN while there is none."""
    out, ordered = np.full(len(values) + 1, np.nan), []
    for i, (value, use) in enumerate(zip(values.tolist(), known.tolist())):
        if use:
            insort(ordered, value)
        k = len(ordered)
        if k:
            out[i + 1] = ordered[k // 2] if k % 2 else ordered[k // 2 - 1] + (ordered[k // 2] - ordered[k // 2 - 1]) / 2
    return out


def _imputed_stats(x: np.ndarray, y: np.ndarray, horizon: int, chunk: int = 4096):
    """Row count, means, covariances and medians at each row of a series, holes filled with that row's medians.

    A hole has another value at each row, so the sums are kept apart by what is missing: products of
    known pairs, values of one column where the other is missing, and counts of both missing. The
    medians then enter as factors. All values are taken about the mean of their column, which changes no result.
    """
    rows, width = x.shape
    trained = ~np.isnan(y)
    seen = ~np.isnan(x)
    med = np.column_stack([running_medians(x[:, j], seen[:, j] & trained) for j in range(width)]) if width else np.zeros((rows + 1, 0))
    # as of each row: only rows at least ``horizon`` before it are known
    at = np.maximum(np.arange(rows) - horizon + 1, 0)
    med = np.where(np.isnan(med), 0.0, med)[at]
    some = seen & trained[:, None]
    centre = np.array([x[some[:, j], j].mean() if some[:, j].any() else 0.0 for j in range(width)] + [y[trained].mean() if trained.any() else 0.0])
    full = np.column_stack([x, y]) - centre
    here = np.column_stack([seen, trained]) & trained[:, None]
    value, known = np.where(here, full, 0.0), here.astype(float)
    gap = trained[:, None] - known
    fill = np.column_stack([np.where(seen.any(axis=0), med - centre[:width], -centre[:width]), np.zeros(rows)])
    upper = np.triu_indices(width + 1)
    n = np.concatenate([[0.0], np.cumsum(trained)])[at]
    sums, holes = (np.vstack([np.zeros(width + 1), np.cumsum(v, axis=0)])[at] for v in (value, gap))
    means = np.zeros((rows, width + 1))
    cov = np.zeros((rows, len(upper[0])))
    carry = np.zeros((3, width + 1, width + 1))
    for lo in range(0, rows, chunk):
        hi = min(lo + chunk, rows)
        # running products up to each place of this stretch, then looked up at the last row that is known
        v, g = value[lo:hi], gap[lo:hi]
        run = [np.cumsum(np.einsum("ra,rb->rab", p, q), axis=0) for p, q in ((v, v), (v, g), (g, g))]
        run = [np.concatenate([c[None], c + r]) for c, r in zip(carry, run)]
        rows_here = np.flatnonzero((at >= lo) & (at < hi) | ((at == hi) & (hi == rows)))
        both, one, none = (r[at[rows_here] - lo] for r in run)
        f, k = fill[rows_here], np.maximum(n[rows_here], 1.0)
        mean = (sums[rows_here] + f * holes[rows_here]) / k[:, None]
        cross = one * f[:, None, :]
        product = both + cross + cross.transpose(0, 2, 1) + none * f[:, :, None] * f[:, None, :]
        centred = product / k[:, None, None] - mean[:, :, None] * mean[:, None, :]
        row, empty = np.nonzero(holes[rows_here] >= n[rows_here][:, None])
        centred[row, empty, :] = centred[row, :, empty] = 0.0
        means[rows_here], cov[rows_here] = mean + centre, centred[:, upper[0], upper[1]]
        carry = np.stack([r[-1] for r in run])
    return n, means, cov, med


def expanding_gram_imputed(
    df: DataFrame, group: Sequence[str], ts: str, columns: Sequence[str], target: str, horizon: int = 1
) -> DataFrame:
    """Statistics as in ``expanding_gram`` with holes filled, and ``in_<column>``: the row's own inputs, filled alike.

    The median of a column at a row is that of its known values among the rows trained on there, so it
    grows with the series like the fit itself; a column without any gets zero. Rows without a
    target are not trained on. Each series is one task's sorted run: its length is bounded by the calendar.
    """
    names = [f"in_{c}" for c in columns]
    extra = [("n", pa.float64()), ("means", pa.list_(pa.float64())), ("cov", pa.list_(pa.float64())), *[(m, pa.float64()) for m in names]]

    def run(series: pa.Table) -> pa.Table:
        series = series.combine_chunks().sort_by(ts)
        given = [series.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*columns, target)]
        x, y = np.column_stack([np.zeros((len(series), 0)), *given[:-1]]), given[-1]
        n, means, cov, med = _imputed_stats(x, y, horizon)
        filled = np.where(np.isnan(x), med, x)
        rows = [pa.array(n), pa.array(list(means), extra[1][1]), pa.array(list(cov), extra[2][1]), *[pa.array(filled[:, j]) for j in range(len(columns))]]
        for (name, _), values in zip(extra, rows):
            series = series.append_column(name, values)
        return series

    typed = df.withColumns({c: F.col(c).cast("double") for c in dict.fromkeys([*columns, target])})
    schema = T.StructType([*typed.schema.fields, T.StructField("n", T.DoubleType()), *[T.StructField(f, T.ArrayType(T.DoubleType())) for f in ("means", "cov")],
                           *[T.StructField(m, T.DoubleType()) for m in names]])
    return typed.groupBy(*group).applyInArrow(run, schema)


@dataclass(frozen=True)
class Ridge:
    """Which columns of the statistics a linear model uses.

    With ``delta_from`` the target is the change against that column, which is itself no
    feature and is added back to the prediction.
    """

    features: tuple[str, ...]
    alpha: float = ALPHA
    delta_from: str | None = None

    def __post_init__(self):
        if self.delta_from in self.features:
            raise ValueError("the observed column is absorbed into the delta target")


def delta_wrap(spec: Ridge, observed: str) -> Ridge:
    """The model of the change against ``observed``: no feature any more, added back to the prediction."""
    return replace(spec, features=tuple(f for f in spec.features if f != observed), delta_from=observed)


def _solve(n, means, cov, spec: Ridge, columns: Sequence[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """Intercept and slopes, and the centre of target and features, per cell, batched.

    Minimises |y - Xw - b|^2 + alpha |w|^2 on scaled X.
    """
    size = len(columns)
    full = np.zeros((len(n), size, size))
    rows, cols = np.triu_indices(size)
    full[:, rows, cols] = cov
    full[:, cols, rows] = cov
    idx = [columns.index(f) for f in spec.features]
    y = columns.index(target)
    xx, xy, mean_x, mean_y = full[:, idx][:, :, idx], full[:, idx, y], means[:, idx], means[:, y]
    if spec.delta_from:
        base = columns.index(spec.delta_from)
        xy, mean_y = xy - full[:, idx, base], mean_y - means[:, base]
    spread = np.einsum("bii->bi", xx)
    scale = np.sqrt(np.maximum(spread, 0.0))
    # what rounding leaves of a constant column is no variation
    flat = spread <= np.square(FLAT * mean_x)
    scale[flat] = 1.0
    a = n[:, None, None] * xx / scale[:, :, None] / scale[:, None, :]
    b = n[:, None] * xy / scale
    for k in range(len(idx)):
        dead = flat[:, k]
        a[dead, k, :] = 0.0
        a[dead, :, k] = 0.0
        b[dead, k] = 0.0
    a = a + spec.alpha * np.eye(len(idx))
    slope = np.linalg.solve(a, b[:, :, None])[:, :, 0] / scale
    coef = np.column_stack([mean_y - (slope * mean_x).sum(axis=1), slope])
    return coef, np.column_stack([mean_y, mean_x])


def ridge_from_stats(
    stats: DataFrame, models: Mapping[str, Ridge], columns: Sequence[str], target: str, min_rows: int = 1, suffix: str = ""
) -> DataFrame:
    """Add ``coef_<model>``: intercept, then slopes, and ``mid_<model>``: the means they are about.

    Null with fewer than ``min_rows`` rows. All models are solved in one call per batch, as they share
    the statistics.
    """
    if not models:
        return stats
    names = [*columns, target]
    fields = [f"{p}_{m}" for m in models for p in ("coef", "mid")]

    def solve(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        usable = np.flatnonzero(n.to_numpy() >= max(min_rows, 1))
        out = {f: np.full(len(n), None, dtype=object) for f in fields}
        if len(usable):
            picked = [np.stack(s.iloc[usable].to_list()).astype(float) for s in (means, cov)]
            counts = n.iloc[usable].to_numpy(dtype=float)
            for m, spec in models.items():
                for i, coef, mid in zip(usable, *_solve(counts, *picked, spec, names, target)):
                    out[f"coef_{m}"][i], out[f"mid_{m}"][i] = coef, mid
        return pd.DataFrame({f: pd.Series(v, dtype=object) for f, v in out.items()})

    schema = T.StructType([T.StructField(f, T.ArrayType(T.DoubleType())) for f in fields])
    solver = F.pandas_udf(solve, schema)
    return stats.withColumn("_fit", solver(*[f"{c}{suffix}" for c in ("n", "means", "cov")])).select(*stats.columns, "_fit.*")


def linear_prediction(model: str, spec: Ridge, inputs: str = "") -> Column:
    """Prediction of one fitted model on the columns of the current row, in generated code.

    Taken about the means, so that large columns do not cancel. ``inputs`` is put before feature names.
    """
    terms = [f"get(`mid_{model}`, 0)"]
    terms += [f"get(`coef_{model}`, {i}) * (`{inputs}{f}` - get(`mid_{model}`, {i}))" for i, f in enumerate(spec.features, 1)]
    if spec.delta_from:
        terms.append(f"`{inputs}{spec.delta_from}`")
    return F.expr(" + ".join(terms))


def fit_predict(
    df: DataFrame, by: Sequence[str], models: Mapping[str, Ridge], target: str, is_train: Column, out: str = "y_pred"
) -> DataFrame:
    """Rows with the prediction of each model fitted on the complete training rows of their cell.

    One aggregation and one small solve; a single model's column is ``out``, several are ``<out>_<model>``.
    A cell without complete training rows predicts null. Tables without ``by`` may have any size.
    """
    columns = list(dict.fromkeys(c for s in models.values() for c in (*s.features, *([s.delta_from] if s.delta_from else []))))
    stats = gram_stats(df, by, [*columns, target], is_train)
    fitted = ridge_from_stats(stats, models, columns, target).drop("n", "means", "cov")
    names = [c for c in fitted.columns if c not in by]
    joined = _with_cell_values(df, by, fitted, names)
    single = len(models) == 1
    made = {out if single else f"{out}_{m}": linear_prediction(m, s) for m, s in models.items()}
    return joined.withColumns(made).drop(*names)


# --- Spark ML --------------------------------------------------------------------------


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    doubles = df.withColumns({f: F.col(f).cast("double") for f in features})
    return VectorAssembler(inputCols=list(features), outputCol="_features").transform(doubles)


def apply_model(model, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``y_pred``; rows must have all features."""
    return model.transform(_assembled(df, features)).drop("_features")


@dataclass(frozen=True)
class BoostSettings:
    """Settings of the boosted trees; the caller chooses them, the number of rows changes nothing."""

    rounds: int = 200
    depth: int = 4
    step: float = 0.05
    leaf_rows: int = 10
    row_share: float = 0.8
    feature_share: float = 0.8
    seed: int = 7


def fit_boosted_trees(
    train: DataFrame, features: Sequence[str], target: str, inner: str | None = None,
    settings: BoostSettings = BoostSettings(),
) -> GBTRegressionModel:
    """Boosted trees on the complete rows.

    Rows flagged by ``inner`` stop the boosting early; they come from the training set.
    """
    rows = train.where(_complete([*features, target]))
    params = dict(
        featuresCol="_features", labelCol=target, predictionCol="y_pred", seed=settings.seed,
        maxIter=settings.rounds, maxDepth=settings.depth, stepSize=settings.step,
        minInstancesPerNode=settings.leaf_rows, subsamplingRate=settings.row_share,
        featureSubsetStrategy=str(settings.feature_share) if settings.feature_share < 1 else "all",
    )
    if inner:
        params["validationIndicatorCol"] = inner
    return GBTRegressor(**params).fit(_assembled(rows, features))


def feature_importance(spark: SparkSession, model: GBTRegressionModel, features: Sequence[str]) -> DataFrame:
    """Feature and gain, descending."""
    rows = [(f, float(model.featureImportances[i])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")
