"""Scoring of prediction tables, leaderboards and recommendations.

Input is one long table with ``y_true``, ``y_pred`` and grouping columns. Every score is a
partial aggregation over its groups; only the direction of change needs an order, and that
is per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import vs_baseline
from tidemark.operators.quantiles import exact_quantiles

Y, P = "y_true", "y_pred"
METRICS = ("mae", "rmse", "mape", "r2", "directional_accuracy")


def finite(col: Column) -> Column:
    return F.when(~F.isnan(col) & (F.abs(col) != float("inf")), col)


def pairs(df: DataFrame) -> DataFrame:
    return df.where(F.col(Y).isNotNull() & F.col(P).isNotNull() & ~F.isnan(Y) & ~F.isnan(P))


def _error() -> Column:
    return F.col(Y) - F.col(P)


def mae() -> Column:
    return F.avg(F.abs(_error()))


def rmse() -> Column:
    return F.sqrt(F.avg(_error() * _error()))


def mape(eps: float = 1e-9) -> Column:
    """Percent, over rows whose true value is not about zero."""
    usable = F.abs(F.col(Y)) > eps
    return F.avg(F.when(usable, F.abs(_error() / F.when(usable, F.col(Y))))) * 100


def smape(eps: float = 1e-9) -> Column:
    half = (F.abs(F.col(Y)) + F.abs(F.col(P))) / 2
    return F.avg(F.when(half > eps, F.abs(_error()) / F.when(half > eps, half))) * 100


def r2() -> Column:
    """1 - SSE/SST in one pass; null where the true values do not vary."""
    total = F.var_pop(Y) * F.count(Y)
    return F.when(total >= 1e-12, 1 - F.sum(_error() * _error()) / F.when(total >= 1e-12, total))


def regression_metrics(df: DataFrame, by: Sequence[str], check: bool = False) -> DataFrame:
    """MAE, RMSE and row count over complete pairs, per group."""
    rows = pairs(df)
    if check and rows.isEmpty():
        raise ValueError("no pair of true and predicted values to score")
    return rows.groupBy(*by).agg(mae().alias("mae"), rmse().alias("rmse"), F.count("*").alias("n"))


def error_aggs() -> list[Column]:
    """Aggregates of all level errors, to be combined with others in one pass."""
    return [
        mae().alias("mae"), rmse().alias("rmse"), mape().alias("mape"), smape().alias("smape"),
        r2().alias("r2"), F.count("*").alias("n"),
    ]


def error_metrics(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return pairs(df).groupBy(*by).agg(*error_aggs())


def directional_accuracy(df: DataFrame, by: Sequence[str], series: Sequence[str], ts: str) -> DataFrame:
    """Share of steps in which true and predicted values move the same way; standing still counts.

    Steps are taken inside a series, in time order; one row alone makes no step.
    """
    return with_steps(pairs(df), by, series, ts).groupBy(*by).agg(direction_agg())


def with_steps(df: DataFrame, by: Sequence[str], series: Sequence[str], ts: str) -> DataFrame:
    """Mark each step of a series: 1 where both values move alike, 0 where not, null at its start."""
    order = Window.partitionBy(*dict.fromkeys([*by, *series])).orderBy(ts)
    dy, dp = F.col(Y) - F.lag(Y).over(order), F.col(P) - F.lag(P).over(order)
    return df.withColumn("_same_way", (F.signum(dy) == F.signum(dp)).cast("double"))


def direction_agg() -> Column:
    return F.avg("_same_way").alias("directional_accuracy")


def peak_scores(df: DataFrame, by: Sequence[str], percentile: float = 90.0) -> DataFrame:
    """Precision, recall and F1 of calling a row a peak: at or above the percentile of the truth."""
    rows = pairs(df)
    limits = exact_quantiles(rows, by, Y, [percentile / 100]).select(
        *by, F.col("quantile").alias("peak_threshold")
    )
    joined = rows.join(limits, list(by))
    true, called = F.col(Y) >= F.col("peak_threshold"), F.col(P) >= F.col("peak_threshold")
    counts = joined.groupBy(*by, "peak_threshold").agg(
        F.count_if(true & called).alias("tp"), F.count_if(~true & called).alias("fp"),
        F.count_if(true & ~called).alias("fn"),
    )
    none = (F.col("tp") + F.col("fp") == 0) & (F.col("tp") + F.col("fn") == 0)

    def rate(other: str) -> Column:
        found = F.col("tp") + F.col(other)
        return F.when(none, None).when(found > 0, F.col("tp") / F.when(found > 0, found)).otherwise(0.0)

    scored = counts.withColumns({"peak_precision": rate("fp"), "peak_recall": rate("fn")})
    both = F.col("peak_precision") + F.col("peak_recall")
    f1 = F.when(
        both > 0, 2 * F.col("peak_precision") * F.col("peak_recall") / F.when(both > 0, both)
    ).when(both == 0, 0.0)
    return scored.withColumn("peak_f1", f1).select(
        *by, "peak_precision", "peak_recall", "peak_f1", "peak_threshold"
    )


def all_metrics(df: DataFrame, by: Sequence[str], series: Sequence[str], ts: str, percentile: float = 90.0) -> DataFrame:
    out = with_steps(pairs(df), by, series, ts).groupBy(*by).agg(*error_aggs(), direction_agg())
    return out.join(peak_scores(df, by, percentile), list(by), "left")


def rmse_mape(df: DataFrame, by: Sequence[str], eps: float = 1e-8) -> DataFrame:
    """RMSE, MAE and percent error with a floor under the denominator."""
    relative = F.abs(_error() / F.greatest(F.abs(F.col(Y)), F.lit(eps)))
    return df.groupBy(*by).agg(
        rmse().alias("rmse"), (F.avg(relative) * 100).alias("mape"), mae().alias("mae"),
        F.count("*").alias("valid_n"),
    )


def delta_metrics(df: DataFrame, by: Sequence[str], observed: str) -> DataFrame:
    """Error of the change against the observed value, and share of changes with equal sign.

    Rows whose true change is zero do not count; a predicted change of zero counts as wrong.
    """
    return df.groupBy(*by).agg(*delta_aggs(observed))


def delta_aggs(observed: str) -> list[Column]:
    true, called = F.col(Y) - F.col(observed), F.col(P) - F.col(observed)
    same = (F.signum(true) == F.signum(called)).cast("double")
    return [
        F.avg(F.abs(true - called)).alias("delta_mae"),
        F.avg(F.when(true != 0, same)).alias("delta_direction_accuracy"),
    ]


def residual_summary(df: DataFrame, by: Sequence[str], observed: str) -> DataFrame:
    """Bias, size and side of residuals; here direction compares "up" with "not up"."""
    residual = F.col(P) - F.col(Y)
    true, called = F.col(Y) - F.col(observed), F.col(P) - F.col(observed)
    same = ((true > 0) == (called > 0)).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(residual).alias("mean_residual"),
        F.avg(F.abs(residual)).alias("mean_abs_residual"),
        F.count_if(residual < 0).alias("n_underpred"),
        F.count_if(residual > 0).alias("n_overpred"),
        F.avg(F.abs(true - called)).alias("delta_mae"),
        F.avg(F.when(true != 0, same)).alias("delta_direction_accuracy"),
    )


def leaderboard(metrics: DataFrame, split: str | None = "split", metric: str = "mae") -> DataFrame:
    keys = ([split] if split else []) + [metric, "model"]
    return metrics.orderBy(*[F.col(k).asc_nulls_last() for k in keys])


def version_table(planned: DataFrame, scored: DataFrame, key: Sequence[str] = ("version", "model")) -> DataFrame:
    """Every planned cell with its metrics; non-finite metrics and missing cells are null."""
    cells = scored.select(*key, *[finite(F.col(m)).alias(m) for m in METRICS])
    return planned.join(cells, list(key), "left")


# fixed values: statuses of a version table
HISTORICAL, LATEST, SKIPPED, RECOMMENDED = (
    "historical_backtest", "latest_candidate", "skipped", "recommended_historical",
)


def annotate_status(
    df: DataFrame, historical: Sequence, latest, metric: str = "mae", lower_is_better: bool = True,
    baseline_model: str = "persistence_monthly",
) -> DataFrame:
    """Registry status per cell, with the best valid historical one recommended, and gains over the baseline."""
    eligible = F.col("version").isin(*historical) & ~F.col("skipped") & F.col(metric).isNotNull()
    rank = F.col(metric) if lower_is_better else -F.col(metric)
    best = df.where(eligible).agg(
        F.min(F.struct(rank.alias("m"), F.col("version"), F.col("model"))).alias("b")
    ).select(F.struct("b.version", "b.model")).scalar()
    status = (
        F.when(F.struct("version", "model") == best, RECOMMENDED)
        .when(F.col("skipped"), SKIPPED)
        .when(F.col("version") == F.lit(latest), LATEST)
        .otherwise(HISTORICAL)
    )
    return vs_baseline(df, metric, baseline_model).withColumn("registry_status", status)


def recommendation(df: DataFrame, metric: str = "mae", baseline_model: str = "persistence_monthly") -> DataFrame:
    """One row: the recommended historical cell, the best latest candidate, its gain, and whether both agree."""
    valid = df.where(~F.col("skipped"))
    is_latest = F.col("registry_status") == LATEST
    one = valid.agg(
        F.max(F.when(F.col("registry_status") == RECOMMENDED, F.struct("version", "model", metric))).alias("r"),
        F.min(
            F.when(is_latest & F.col(metric).isNotNull(), F.struct(F.col(metric), F.col("model"), F.col("version")))
        ).alias("l"),
        F.min(F.when(is_latest & (F.col("model") == baseline_model), F.col(metric))).alias("baseline"),
    )
    return one.select(
        F.col("r.version").alias("recommended_version"),
        F.col("r.model").alias("recommended_model"),
        F.col(f"r.{metric}").alias(f"recommended_{metric}"),
        F.col("l.model").alias("latest_model"),
        F.col(f"l.{metric}").alias(f"latest_{metric}"),
        F.col("baseline").alias(f"baseline_{metric}"),
        (F.col("baseline") - F.col(f"l.{metric}")).alias(f"improvement_{metric}"),
        (F.col("r.model") == F.col("l.model")).alias("views_agree"),
    )


def metric_series(df: DataFrame, metrics: Sequence[str] = METRICS, keep: Sequence[str] = ("version", "model")) -> DataFrame:
    """Metrics by version in long form, without skipped cells and empty values."""
    valid = df.where(~F.col("skipped")) if "skipped" in df.columns else df
    return valid.unpivot(list(keep), list(metrics), "metric", "value").where(F.col("value").isNotNull())
