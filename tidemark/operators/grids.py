"""Regular hourly and monthly grids, lags, past-only rolling statistics and targets.

A lag is a step in time, not a step in rows, so every series is put on its regular grid
first. The grid is filled from the gap between a row and its successor inside one window,
which needs neither a calendar table nor a join, and the lags that follow reuse the same
partitioning. The work per group is bounded by the calendar span of the series.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MONTH = "month"
HOUR = "hour"

_ROLLING = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


@dataclass(frozen=True)
class LagSpec:
    column: str
    periods: int
    name: str


@dataclass(frozen=True)
class RollSpec:
    column: str
    window: int
    agg: str
    name: str


# fixed values: default lags and windows, in hours and months
HOURLY_PRICE_LAGS = (1, 2, 3, 24, 48, 168)
HOURLY_DEMAND_LAGS = (1, 24, 168)
HOURLY_PRICE_ROLLS = ((24, "mean"), (24, "std"), (168, "mean"), (168, "std"))
MONTHLY_LAGS = (1, 2, 3, 6, 12)
MONTHLY_ROLLS = ((3, "mean"), (6, "mean"), (12, "mean"), (12, "std"))


def lag_specs(column: str, periods: Sequence[int], unit: str, prefix: str | None = None) -> list[LagSpec]:
    stem = prefix or column
    return [LagSpec(column, p, f"{stem}_lag_{p}{unit}") for p in periods]


def roll_specs(
    column: str, windows: Sequence[tuple[int, str]], unit: str, prefix: str | None = None
) -> list[RollSpec]:
    stem = prefix or column
    return [RollSpec(column, n, agg, f"{stem}_rolling_{n}{unit}_{agg}") for n, agg in windows]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _over(group: Sequence[str], ts: str, frame: str = "") -> str:
    """Window of a series in time order, as SQL: wide tables are planned from one text per column."""
    part = f"PARTITION BY {', '.join(map(_q, group))} " if group else ""
    return f"OVER ({part}ORDER BY {_q(ts)} ASC NULLS LAST{' ' + frame if frame else ''})"


def _step(unit: str) -> Column:
    return F.expr(f"interval 1 {unit}")


def _ordered(group: Sequence[str], ts: str):
    return Window.partitionBy(*group).orderBy(F.col(ts).asc_nulls_last())


def _fill_grid(df: DataFrame, group: Sequence[str], ts: str, unit: str, extend: int) -> DataFrame:
    columns, t = df.columns, _q(ts)
    ts_type = df.schema[ts].dataType.simpleString()

    def shift(what: str, n: int) -> str:
        return f"add_months({what}, {n})" if unit == MONTH else f"{what} + interval {n} {unit}"

    following = f"lead({t}) {_over(group, ts)}"
    repeated = f"raise_error('more than one row per {', '.join([*group, ts])}')"
    last = f"""cast(CASE WHEN _next IS NULL THEN {shift(t, extend)} WHEN _next > {t} THEN {shift('_next', -1)}
        ELSE {repeated} END AS {ts_type})"""
    slots = (
        df.where(f"{t} IS NOT NULL")
        .selectExpr(*map(_q, columns), f"{following} AS _next")
        .selectExpr(*map(_q, columns), f"explode(sequence({t}, {last}, interval 1 {unit})) AS _slot")
    )
    values = [f"CASE WHEN _slot = {t} THEN {_q(c)} END AS {_q(c)}" for c in columns if c not in {*group, ts}]
    return slots.selectExpr(*map(_q, group), f"_slot AS {t}", *values)


def monthly_grid(df: DataFrame, group: Sequence[str], ts: str = "period_month", extend: int = 0) -> DataFrame:
    """Every month start from each group's first to its last month plus ``extend``."""
    return _fill_grid(df, group, ts, MONTH, extend)


def hourly_grid(df: DataFrame, group: Sequence[str], ts: str = "interval_end", extend: int = 0) -> DataFrame:
    """Every hour from each group's first to its last hour plus ``extend``."""
    return _fill_grid(df, group, ts, HOUR, extend)


def expected_hours(df: DataFrame, date: str, out: str = "interval_end") -> DataFrame:
    """The 24 interval ends of each distinct trade date."""
    start = F.col(date).cast("timestamp_ntz")
    hours = F.sequence(start + F.expr("interval 1 hour"), start + F.expr("interval 24 hours"), _step(HOUR))
    return df.select(date).distinct().select(date, F.explode(hours).alias(out))


def hour_index(df: DataFrame, start: str, end: str, out: str = "interval_end") -> DataFrame:
    """One row per hour from ``start`` to ``end``, both included, for each input row."""
    return df.withColumn(out, F.explode(F.sequence(F.col(start), F.col(end), _step(HOUR))))


def _need_columns(df: DataFrame, columns: Sequence[str], what: str) -> None:
    missing = sorted({c for c in columns if c not in df.columns})
    if missing:
        raise KeyError(f"{what} source column missing: {missing}")


def lag_sql(group: Sequence[str], ts: str, specs: Sequence[LagSpec]) -> list[str]:
    bad = [s for s in specs if s.periods <= 0]
    if bad:
        raise ValueError(f"a lag must look at the past, so periods must be > 0: {bad}")
    return [f"lag({_q(s.column)}, {s.periods}) {_over(group, ts)} AS {_q(s.name)}" for s in specs]


def roll_sql(group: Sequence[str], ts: str, specs: Sequence[RollSpec]) -> list[str]:
    """Statistics over the ``n`` grid rows before each row; null unless all ``n`` are present."""
    out = []
    for s in specs:
        if s.window <= 0:
            raise ValueError(f"window must be > 0: {s}")
        if s.agg not in _ROLLING:
            raise ValueError(f"unsupported rolling statistic {s.agg!r}; one of {sorted(_ROLLING)}")
        over = _over(group, ts, f"ROWS BETWEEN {s.window} PRECEDING AND 1 PRECEDING")
        c = _q(s.column)
        out.append(
            f"CASE WHEN count({c}) {over} = {s.window} THEN {_ROLLING[s.agg]}({c}) {over} END AS {_q(s.name)}"
        )
    return out


def add_lags(grid: DataFrame, group: Sequence[str], ts: str, specs: Sequence[LagSpec]) -> DataFrame:
    _need_columns(grid, [s.column for s in specs], "lag")
    return grid.selectExpr("*", *lag_sql(group, ts, specs))


def add_rolls(grid: DataFrame, group: Sequence[str], ts: str, specs: Sequence[RollSpec]) -> DataFrame:
    _need_columns(grid, [s.column for s in specs], "rolling")
    return grid.selectExpr("*", *roll_sql(group, ts, specs))


def add_lags_and_rolls(
    grid: DataFrame, group: Sequence[str], ts: str, lags: Sequence[LagSpec], rolls: Sequence[RollSpec]
) -> DataFrame:
    """All lags and rolling statistics over one sort of the gridded series."""
    _need_columns(grid, [s.column for s in [*lags, *rolls]], "feature")
    return grid.selectExpr("*", *lag_sql(group, ts, lags), *roll_sql(group, ts, rolls))


def lead_target(
    grid: DataFrame, group: Sequence[str], ts: str, column: str, horizon: int, name: str = "target"
) -> DataFrame:
    """Value ``horizon`` grid steps ahead of each row."""
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    return grid.withColumn(name, F.lead(column, horizon).over(_ordered(group, ts)))


def exogenous_lag(
    df: DataFrame,
    columns: Sequence[str],
    group: Sequence[str] = (),
    ts: str = "period_month",
    periods: int = 1,
) -> DataFrame:
    """Only ``<col>_lag_1m`` leaves: duplicates averaged per month, grid one month longer.

    The extra month keeps the newest observation visible in the month after it.
    """
    means = df.groupBy(*group, ts).agg(*[F.expr(f"avg({_q(c)}) AS {_q(c)}") for c in columns])
    grid = monthly_grid(means, group, ts, extend=periods)
    specs = [LagSpec(c, periods, f"{c}_lag_{periods}m") for c in columns]
    return grid.selectExpr(*map(_q, [*group, ts]), *lag_sql(group, ts, specs))


def price_lags(df: DataFrame, column: str, group: Sequence[str] = (), ts: str = "period_month") -> DataFrame:
    """Lags 1 and 2 and the change between them; the current value is not observable yet.

    No value is carried over a gap: a change with a missing end is null.
    """
    grid = monthly_grid(df.select(*group, ts, column), group, ts, extend=2)
    one, two = f"{column}_lag_1m", f"{column}_lag_2m"
    lagged = add_lags(grid, group, ts, [LagSpec(column, 1, one), LagSpec(column, 2, two)])
    change = (F.col(one) - F.col(two)) / F.when(F.col(two) != 0, F.col(two))
    return lagged.select(*group, ts, one, two, change.alias(f"{column}_chg_1m_lag_1m"))


def step_diff(df: DataFrame, group: Sequence[str], ts: str, out: str = "step_seconds") -> DataFrame:
    """Seconds since the previous timestamp of the group."""
    previous = F.lag(ts).over(_ordered(group, ts))
    return df.withColumn(out, F.timestamp_diff("SECOND", previous, F.col(ts)))


def expanding_stats(df: DataFrame, columns: Sequence[str], group: Sequence[str], ts: str) -> DataFrame:
    """Row count, means and covariances of ``columns`` over all rows before each row.

    They are updated about a value of the series, so large values with little spread keep their digits.
    """
    past = _over(group, ts, "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
    whole = _over(group, ts, "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING")
    about = df.selectExpr("*", *[f"first({_q(c)}, true) {whole} AS {_q(f'_ref_{c}')}" for c in columns])
    near = {c: f"({_q(c)} - {_q(f'_ref_{c}')})" for c in columns}
    out = [f"count(*) {past} AS n_past"]
    for i, a in enumerate(columns):
        out.append(f"{_q(f'_ref_{a}')} + avg({near[a]}) {past} AS {_q(f'mean_{a}')}")
        out += [f"covar_pop({near[a]}, {near[b]}) {past} AS {_q(f'cov_{a}_{b}')}" for b in columns[i:]]
    return about.selectExpr("*", *out).drop(*[f"_ref_{c}" for c in columns])
