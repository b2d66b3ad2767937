"""From revisions to a ranked table of naive models, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scores as sc
from tidemark.operators.checks import drop_warmup
from tidemark.operators.grids import (
    MONTHLY_LAGS, MONTHLY_ROLLS, add_lags_and_rolls, lag_specs, lead_target, monthly_grid, roll_specs,
)
from tidemark.operators.models import predict_columns
from tidemark.operators.revisions import dedup_revisions

NAIVE = {
    "persistence_monthly": "price",
    "naive_lag_1m": "price_lag_1m",
    "seasonal_naive_lag_12m": "price_lag_12m",
}


def naive_leaderboard(revisions: DataFrame, area: str = "area", period: str = "period_month", horizon: int = 1) -> DataFrame:
    """Error, fit and direction of three naive models per area, best first."""
    current = dedup_revisions(revisions, [period, area]).select(area, period, "price")
    lags, rolls = lag_specs("price", MONTHLY_LAGS, "m"), roll_specs("price", MONTHLY_ROLLS, "m")
    wide = add_lags_and_rolls(monthly_grid(current, [area], period), [area], period, lags, rolls)
    target = lead_target(wide, [area], period, "price", horizon, "y_true")
    usable = drop_warmup(target, ["price", *[s.name for s in [*lags, *rolls]]], "y_true")
    predicted = predict_columns(usable, NAIVE, [area, period, "y_true"])
    steps = sc.with_steps(sc.pairs(predicted), [area, "model"], [], period)
    scored = steps.groupBy(area, "model").agg(*sc.error_aggs(), sc.direction_agg())
    return sc.leaderboard(scored.withColumnRenamed(area, "split"))
