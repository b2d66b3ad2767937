"""Chronological splits, expanding folds and point-in-time holdouts.

Positions are counted per series, so a window never holds more than one series' calendar.
Versions and folds are configuration: they travel as a literal array that each row is tested
against, not as a table to join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: shares of rows, smallest training sizes
VALID_FRACTION = 0.15
TEST_FRACTION = 0.15
MIN_TRAIN_ROWS = 24
INNER_FRACTION = 0.15
INNER_MIN_ROWS = 30


def _positions(df: DataFrame, group: Sequence[str], ts: str) -> DataFrame:
    """Zero-based position in time and row count of each series."""
    series = Window.partitionBy(*group)
    return df.withColumns(
        {
            "_pos": F.row_number().over(series.orderBy(ts)) - 1,
            "_n": F.count("*").over(series),
        }
    )


def split_chronological(
    df: DataFrame, group: Sequence[str], ts: str, valid: float = VALID_FRACTION,
    test: float = TEST_FRACTION, min_train: int = MIN_TRAIN_ROWS,
) -> DataFrame:
    """Add ``split``: train, valid, test in time order; too short a training part is an error."""
    placed = _positions(df, group, ts)
    n_test = F.floor(F.col("_n") * F.lit(float(test)))
    n_valid = F.floor(F.col("_n") * F.lit(float(valid)))
    n_train = F.col("_n") - n_test - n_valid
    short = F.concat(F.lit("train split too small: "), n_train.cast("string"), F.lit(f" < {min_train}"))
    split = (
        F.when(n_train < min_train, F.raise_error(short))
        .when(F.col("_pos") < n_train, "train")
        .when(F.col("_pos") < n_train + n_valid, "valid")
        .otherwise("test")
    )
    return placed.withColumn("split", split).drop("_pos", "_n")


def ts_folds(df: DataFrame, group: Sequence[str], ts: str, k: int = 5, embargo: int = 1) -> DataFrame:
    """Expanding folds: one output row per (fold, role, row), with ``fold`` and ``role`` added.

    The last ``embargo`` rows before a validation block are not trained on; folds left
    without training rows are skipped and do not take a number.
    """
    if k < 2:
        raise ValueError("at least two folds are needed")
    if embargo < 0:
        raise ValueError("embargo must be >= 0")
    placed = _positions(df, group, ts)
    size = F.floor(F.col("_n") / (k + 1))

    def start(i: int):
        return F.col("_n") - (k - i + 1) * size

    skipped = sum((F.when(start(i) <= embargo, 1).otherwise(0) for i in range(1, k + 1)), F.lit(0))
    cells = F.array(
        *[
            F.struct(
                (F.lit(i) - skipped).cast("int").alias("fold"),
                F.when(start(i) <= embargo, F.lit(None).cast("string"))
                .when(F.col("_pos") < start(i) - embargo, "train")
                .when((F.col("_pos") >= start(i)) & (F.col("_pos") < start(i) + size), "valid")
                .alias("role"),
            )
            for i in range(1, k + 1)
        ]
    )
    kept = F.filter(cells, lambda c: c["role"].isNotNull())
    return placed.select(*df.columns, F.inline(kept))


def inner_validation(
    folds: DataFrame, group: Sequence[str], ts: str, frac: float = INNER_FRACTION, min_rows: int = INNER_MIN_ROWS
) -> DataFrame:
    """Flag the last part of each training set as inner validation (``is_inner``).

    Only training rows are flagged, so the outer validation rows are never looked at; short
    training sets get no inner part.
    """
    train = folds.where("role = 'train'")
    placed = _positions(train, [*group, "fold"], ts)
    cut = F.greatest(
        F.lit(1), F.least(F.floor(F.col("_n") * F.lit(1.0 - frac)), F.col("_n") - 2)
    )
    inner = (F.col("_n") >= min_rows) & (F.col("_pos") >= cut)
    return placed.withColumn("is_inner", inner).drop("_pos", "_n")


@dataclass(frozen=True)
class Version:
    """One simulated retraining moment; ``window`` asks for rolling validation instead of a holdout."""

    name: str
    cutoff: str
    train_end: str
    test_start: str | None = None
    test_end: str | None = None
    window: int | None = None

    @property
    def mode(self) -> str:
        return "latest_rolling_validation" if self.window else "fixed_holdout"


def _day(text: str | None):
    return F.lit(text).cast("date")


def _role_cell(version, eval_month, role):
    return F.struct(
        F.lit(version).alias("version"), eval_month.cast("date").alias("eval_month"), role.alias("role")
    )


def _fixed_cells(v: Version, horizon: int, period: str):
    """Train on labels known at the cutoff; test on the months after, known only in hindsight."""
    p = F.col(period)
    train = (F.add_months(p, horizon) <= _day(v.cutoff)) & (p <= _day(v.train_end))
    test = (p >= _day(v.test_start)) & (p <= _day(v.test_end))
    return F.array(
        *[_role_cell(v.name, F.lit(None), F.when(inside, F.lit(role))) for role, inside in (("train", train), ("test", test))]
    )


def _rolling_cells(v: Version, horizon: int, period: str):
    """Train on rows whose target month lies strictly before the evaluated month."""
    p = F.col(period)
    last = F.add_months(_day(v.cutoff), -horizon)
    months = F.sequence(F.add_months(last, -(v.window - 1)), last, F.expr("interval 1 month"))
    return F.transform(
        months,
        lambda m: _role_cell(
            v.name, m, F.when(F.add_months(p, horizon) < m, F.lit("train")).when(p == m, F.lit("test"))
        ),
    )


def version_cells(
    df: DataFrame, versions: Sequence[Version], horizon: int, target: str = "target", period: str = "period_month"
) -> DataFrame:
    """One row per (version, evaluation month, role, row) of all versions, in one pass over the rows.

    The evaluation month is null for a fixed holdout.
    """
    cells = F.concat(
        *[(_rolling_cells if v.window else _fixed_cells)(v, horizon, period) for v in versions]
    )
    kept = F.filter(cells, lambda c: c["role"].isNotNull())
    return df.where(F.col(target).isNotNull()).select(*df.columns, F.inline(kept))


def fixed_holdout(
    df: DataFrame, versions: Sequence[Version], horizon: int, target: str = "target", period: str = "period_month"
) -> DataFrame:
    """One row per (version, role, row)."""
    if any(v.window for v in versions):
        raise ValueError("a rolling version has no fixed holdout")
    return version_cells(df, versions, horizon, target, period).drop("eval_month")


def rolling_validation(
    df: DataFrame, cutoff: str, window: int, horizon: int, target: str = "target", period: str = "period_month"
) -> DataFrame:
    """One row per (evaluation month, role, row) for the last months whose label is known."""
    version = Version("rolling", cutoff, cutoff, window=window)
    return version_cells(df, [version], horizon, target, period).drop("version")
