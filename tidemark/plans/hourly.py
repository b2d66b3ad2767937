"""The hourly feature table: one lazy plan over one sort per series."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.calendar import add_holiday_flag, calendar_hourly
from tidemark.operators import checks
from tidemark.operators.grids import LagSpec, RollSpec, add_lags_and_rolls, hourly_grid, lead_target
from tidemark.operators.revisions import keep_last

TARGET = "target_t_plus_h"

# fixed values: features of the hourly table
PRICE_LAGS = (1, 2, 3, 24, 48, 168)
DEMAND_LAGS = (1, 24, 168)
PRICE_ROLLS = ((24, "mean", "24h"), (24, "std", "24h"), (168, "mean", "7d"), (168, "std", "7d"))
DEMAND_ROLLS = ((24, "mean", "24h"), (168, "mean", "7d"))


@dataclass(frozen=True)
class HourlyFeatures:
    """The table and the columns a model may use; findings are planned on demand."""

    table: DataFrame
    features: list[str]
    rows: DataFrame
    group: tuple[str, ...]
    ts: str

    @property
    def comparable(self) -> list[str]:
        """Features that can equal the target: all but labels."""
        return [c for c in self.features if self.table.schema[c].dataType.simpleString() != "string"]

    def canary(self) -> DataFrame:
        return checks.leakage_canary(self.table, TARGET, self.comparable, checks.MIN_PAIRS_HOURLY)

    def missing_hours(self) -> DataFrame:
        return checks.daily_missing_hours(self.rows, self.group, self.ts).where(F.col("missing_hours") > 0)


def hourly_feature_table(
    df: DataFrame, price: str = "price", demand: str = "demand", group: Sequence[str] = ("area",),
    ts: str = "interval_end", horizon: int = 24, holidays: DataFrame | None = None,
    order: Sequence[str] = (), check: bool = False,
) -> HourlyFeatures:
    """Lags, past-only windows and calendar columns at t, target at t + ``horizon`` hours.

    Repeated rows of an hour are cut to the last in ``order`` first. With ``check`` gaps in
    the hours and features that equal the target stop the build; both look at the data, so
    they are off for a plan that is only described.
    """
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    missing = [c for c in (*group, ts, price, demand) if c not in df.columns]
    if missing:
        raise KeyError(f"required columns missing: {missing}")
    rows = keep_last(df, [*group, ts], list(order)) if order else df
    if check:
        checks.assert_unique(rows, [*group, ts], "hours")
        checks.assert_contiguous(rows, group, ts)
    lags = [LagSpec(price, k, f"{price}_lag_{k}h") for k in PRICE_LAGS]
    lags += [LagSpec(demand, k, f"{demand}_lag_{k}h") for k in DEMAND_LAGS]
    rolls = [RollSpec(price, n, agg, f"{price}_rolling_{label}_{agg}") for n, agg, label in PRICE_ROLLS]
    rolls += [RollSpec(demand, n, agg, f"{demand}_rolling_{label}_{agg}") for n, agg, label in DEMAND_ROLLS]
    grid = hourly_grid(rows.select(*group, ts, price, demand), group, ts)
    wide = lead_target(add_lags_and_rolls(grid, group, ts, lags, rolls), group, ts, price, horizon, TARGET)
    dated = calendar_hourly(wide, ts)
    if holidays is not None:
        dated = add_holiday_flag(dated, ts, holidays)
    features = [c for c in dated.columns if c not in {*group, ts, TARGET}]
    table = checks.drop_warmup(dated, features, TARGET)
    out = HourlyFeatures(table, features, rows, tuple(group), ts)
    if check:
        checks.assert_no_leakage(table, TARGET, out.comparable, checks.MIN_PAIRS_HOURLY)
    return out
