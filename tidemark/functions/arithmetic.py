"""Guarded arithmetic over measures."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den where den is positive, else null."""
    return F.when(den > 0, num / F.when(den > 0, den))


def unit_price(amount: Column, volume: Column) -> Column:
    """Money per kWh from money and MWh."""
    return safe_ratio(amount, volume) / 1000


def row_sum(cols: Sequence[Column], min_count: int = 0) -> Column:
    """Sum across columns skipping nulls; with ``min_count`` 1 an all-null row stays null."""
    if min_count not in (0, 1):
        raise ValueError("min_count must be 0 or 1")
    if not cols:
        return F.lit(0.0) if min_count == 0 else F.lit(None).cast("double")
    total = reduce(add, [F.coalesce(c, F.lit(0.0)) for c in cols])
    if min_count == 0:
        return total
    return F.when(reduce(or_, [c.isNotNull() for c in cols]), total)


def null_sum(*cols: Column) -> Column:
    """Plain sum, null as soon as one part is null."""
    return reduce(add, cols)


def delta_target(y: Column, observed: Column) -> Column:
    return y - observed


def reconstruct(observed: Column, delta: Column) -> Column:
    return observed + delta


# fixed values: model names by kind
BASELINE_MODELS = (
    "naive", "seasonal_naive", "persistence_monthly", "naive_lag_1m", "seasonal_naive_lag_12m",
)
TRAINABLE_MODELS = (
    "ridge", "lightgbm", "monthly_ar_ridge", "delta_ridge", "delta_lightgbm", "delta_ar_ridge",
)


def classify_model(name: Column) -> Column:
    return (
        F.when(name.isin(*BASELINE_MODELS), "baseline")
        .when(name.isin(*TRAINABLE_MODELS), "trainable")
        .otherwise("unknown")
    )
