"""Macro-series panel: aligned series, their lags and statistics, and a target."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_monthly
from tidemark.operators.grids import LagSpec, RollSpec, add_lags_and_rolls, lead_target, monthly_grid
from tidemark.operators.joins import align_outer

# fixed values: lags and windows of the panel, in months
PANEL_LAGS = (1, 2, 3, 6, 12)
PANEL_ROLLS = ((3, "mean"), (6, "mean"), (6, "std"))


@dataclass(frozen=True)
class Panel:
    """Feature rows, and one row with row count, range and how many rows were dropped."""

    table: DataFrame
    info: DataFrame


def panel_features(
    series: Mapping[str, DataFrame], target: str, ratio: tuple[str, str], horizon: int = 1,
    period: str = "period_month",
) -> Panel:
    """Each frame in ``series`` holds ``period`` and one column named as its key.

    One macro series has one row per month, so the single ordered window spans only the
    months of the calendar.
    """
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    names = list(series)
    aligned = monthly_grid(align_outer([series[n].select(period, n) for n in names], period), [], period)
    lags = [LagSpec(n, k, f"{n}_lag{k}") for n in names for k in PANEL_LAGS]
    rolls = [RollSpec(n, k, agg, f"{n}_roll{k}_{agg}") for n in names for k, agg in PANEL_ROLLS]
    out = add_lags_and_rolls(aligned, [], period, lags, rolls)
    for n in names:
        one, two = F.col(f"{n}_lag1"), F.col(f"{n}_lag2")
        out = out.withColumn(f"{n}_ret1_lag1", (one - two) / F.when(two != 0, two))
    calendar = calendar_monthly(out, period)
    top, bottom = (F.col(f"{n}_lag1") for n in ratio)
    full = lead_target(calendar, [], period, target, horizon).withColumn(
        "ratio_lag1", top / F.when(bottom != 0, bottom)
    )
    features = [
        period,
        *[s.name for s in [*lags, *rolls]],
        *[f"{n}_ret1_lag1" for n in names],
        "month", "month_sin", "month_cos", "quarter", "ratio_lag1", "target",
    ]
    wide = full.select(*features)
    complete = F.lit(True)
    for c in features:
        complete = complete & F.col(c).isNotNull()
    info = wide.agg(
        F.count_if(complete).alias("rows"),
        F.min(F.when(complete, F.col(period))).alias("period_min"),
        F.max(F.when(complete, F.col(period))).alias("period_max"),
        F.count_if(~complete).alias("n_dropped"),
        F.lit(len(features) - 2).alias("n_features"),
        F.lit(horizon).alias("horizon_months"),
    )
    return Panel(wide.na.drop(), info)
