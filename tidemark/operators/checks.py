"""Integrity and leakage checks as tables of findings; assertions look at a small sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grids import step_diff

# fixed values: pairs needed before equality with the target counts as a leak
MIN_PAIRS_HOURLY = 24
MIN_PAIRS_MONTHLY = 6

SAMPLE = 5


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """All rows whose key occurs more than once.

    Keys are counted with map-side partial sums and only the repeated ones are joined back.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").drop("_n")
    on = None
    named = repeated.select(*[F.col(k).alias(f"_dup_{k}") for k in keys])
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_dup_{k}"))
        on = same if on is None else on & same
    return df.join(named, on, "left_semi")


def assert_unique(df: DataFrame, keys: Sequence[str], label: str = "rows") -> None:
    sample = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(SAMPLE).collect()
    if sample:
        raise AssertionError(f"duplicate {label} on {list(keys)}: {[r.asDict() for r in sample]}")


def hourly_gaps(
    df: DataFrame, group: Sequence[str], ts: str = "interval_end", slack_minutes: int = 0
) -> DataFrame:
    """Rows that follow their predecessor by more than an hour plus the slack."""
    return step_diff(df, group, ts).where(F.col("step_seconds") > 3600 + 60 * slack_minutes)


def assert_contiguous(df: DataFrame, group: Sequence[str], ts: str = "interval_end", slack_minutes: int = 0) -> None:
    first = hourly_gaps(df, group, ts, slack_minutes).orderBy(*group, ts).select(*group, ts).limit(1).collect()
    if first:
        raise AssertionError(f"gap of more than an hour before {first[0].asDict()}")


def daily_missing_hours(df: DataFrame, group: Sequence[str], ts: str = "interval_end") -> DataFrame:
    """Per group and trade date the hours present and missing; hour 24 ends at the next midnight."""
    trade_date = (F.col(ts) - F.expr("interval 1 hour")).cast("date")
    return (
        df.groupBy(*group, trade_date.alias("trade_date"))
        .agg(F.count("*").alias("hour_count"))
        .withColumn("missing_hours", 24 - F.col("hour_count"))
    )


def leakage_canary(
    df: DataFrame, target: str, features: Sequence[str], min_pairs: int = MIN_PAIRS_MONTHLY
) -> DataFrame:
    """Per feature the comparable pairs, how many equal the target, and whether all of them do.

    One pass over the table for all features.
    """
    y = F.col(target).cast("double")
    aggs = []
    for f in features:
        x = F.col(f).cast("double")
        aggs.append(
            F.struct(
                F.lit(f).alias("feature"),
                F.count_if(x.isNotNull() & y.isNotNull()).alias("pairs"),
                F.count_if(x == y).alias("equal_pairs"),
            )
        )
    found = df.agg(F.array(*aggs).alias("_f")).select(F.inline("_f"))
    suspect = (F.col("pairs") >= min_pairs) & (F.col("pairs") == F.col("equal_pairs"))
    return found.withColumn("suspect", suspect)


def assert_no_leakage(
    df: DataFrame, target: str, features: Sequence[str], min_pairs: int = MIN_PAIRS_MONTHLY
) -> None:
    """Raise naming the features that equal the target; the table has one row per feature."""
    rows = leakage_canary(df, target, features, min_pairs).where("suspect").select("feature").collect()
    if rows:
        raise AssertionError(f"features equal to the future target: {sorted(r[0] for r in rows)}")


def row_count_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: the counts on both sides of an optional join and whether they agree."""
    return before.agg(F.count("*").alias("before")).withColumn(
        "after", after.agg(F.count("*")).scalar()
    ).withColumn("same", F.col("before") == F.col("after"))


def assert_row_count(before: DataFrame, after: DataFrame) -> None:
    row = row_count_change(before, after).collect()[0]
    if not row["same"]:
        raise AssertionError(f"row count changed from {row['before']} to {row['after']}")


def drop_warmup(df: DataFrame, required: Sequence[str], target: str) -> DataFrame:
    """Rows whose baseline features and target are all there."""
    return df.na.drop(subset=[*required, target])


# fixed values: endings that mark a column as already lagged
LAGGED_SUFFIXES = ("_lag_1m", "_lag_1y")


def unlagged_columns(columns: Sequence[str], exempt: Sequence[str] = ()) -> list[str]:
    """Optional feature columns that break the naming contract for lagged values."""
    return [c for c in columns if c not in exempt and not c.endswith(LAGGED_SUFFIXES)]


def suffix_findings(df: DataFrame, exempt: Sequence[str] = ()) -> DataFrame:
    """The columns that break the contract, each with its number of values."""
    broken = unlagged_columns(df.columns, exempt)
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in broken])
    return counts.unpivot([], broken, "column_name", "n_values") if broken else df.sparkSession.createDataFrame(
        [], "column_name string, n_values bigint"
    )


def observable_only(df: DataFrame, cutoff, horizon: int = 0, period: str = "period_month") -> DataFrame:
    """Rows known at the cutoff; with a horizon the label must have been known too."""
    if horizon < 0:
        raise ValueError("horizon must be >= 0")
    return df.where(F.add_months(F.col(period), horizon) <= F.lit(cutoff).cast("date"))
