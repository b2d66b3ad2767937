"""Key-unique block joins, as-of lookups and key comparisons; equi joins only."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.revisions import keep_last
from tidemark.operators.sets import except_keys, intersect_keys


def one_row_per_date(block: DataFrame, key: Sequence[str]) -> DataFrame:
    """Mark a block that is unique on one date column for broadcast.

    Its size is bounded by the calendar, whatever the data: months or days are thousands. A
    shuffle join on such a key would also run in as many tasks as there are dates.
    """
    on_date = len(key) == 1 and block.schema[key[0]].dataType.simpleString() == "date"
    return F.broadcast(block) if on_date else block


def join_blocks(
    base: DataFrame,
    blocks: Sequence[DataFrame],
    key: Sequence[str],
    order: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Left join optional blocks, each first cut to its last row per key.

    The base row count cannot change. A block keyed by date is sent to the base rows; for any
    other key the planner decides by size.
    """
    out = base
    for i, block in enumerate(blocks):
        within = list(order[i]) if order else []
        ties = within or [c for c in block.columns if c not in key]
        unique = keep_last(block, key, ties)
        out = out.join(one_row_per_date(unique, key), list(key), "left")
    return out


def common_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys at which both sides hold at least one value."""

    def valued(df: DataFrame) -> DataFrame:
        values = [c for c in df.columns if c not in key]
        return df.na.drop("all", subset=values).select(*key)

    return intersect_keys(valued(a), valued(b))


def missing_keys(base: DataFrame, block: DataFrame, key: Sequence[str]) -> DataFrame:
    """Distinct base keys the block does not have."""
    # a key with a null in it matches nothing, so the base keeps it
    return except_keys(base.select(*key), block.select(*key).dropna())


def broadcast_yearly(
    months: DataFrame, yearly: DataFrame, values: Sequence[str], period: str = "period_month",
    year: str = "period_year", key: Sequence[str] = (),
) -> DataFrame:
    """Each month sees the figures of the calendar year before, named ``<col>_lag_1y``."""
    lagged = yearly.select(
        *key,
        (F.col(year) + 1).cast("int").alias("_year"),
        *[F.col(v).alias(f"{v}_lag_1y") for v in values],
    )
    keyed = months.withColumn("_year", F.year(period))
    if not key:
        # one row per calendar year: of repeated ones the last in the order of the values, never a mixture
        whole = F.struct(*[c for c in lagged.columns if c != "_year"])
        lagged = F.broadcast(lagged.groupBy("_year").agg(F.max(whole).alias("_row")).select("_year", "_row.*"))
    return keyed.join(lagged, [*key, "_year"], "left").drop("_year")


def asof_latest(
    months: DataFrame, snapshots: DataFrame, period: str = "period_month", quote: str = "quote_date"
) -> DataFrame:
    """Per month the latest snapshot date not after the month's end.

    Snapshot dates are first reduced to one per calendar month in parallel; what remains is
    one row per month, over which the last value is carried forward. Months before the
    first snapshot are absent.
    """
    per_month = snapshots.groupBy(F.trunc(F.col(quote), "month").alias(period)).agg(
        F.max(quote).alias("_latest")
    )
    wanted = months.select(F.col(period).cast("date").alias(period)).distinct().withColumn("_wanted", F.lit(True))
    steps = per_month.join(wanted, period, "full")
    so_far = Window.orderBy(period).rowsBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn(quote, F.last("_latest", ignorenulls=True).over(so_far))
        .where(F.col("_wanted") & F.col(quote).isNotNull())
        .select(period, quote)
    )


def curve_points(
    asof: DataFrame, curve: DataFrame, settle: str, period: str = "period_month",
    quote: str = "quote_date", contract: str = "contract_month",
) -> DataFrame:
    """Price of the next two contract months in the chosen snapshot and their slope."""
    joined = asof.join(curve.select(quote, contract, settle), quote, "left")

    def price(ahead: int) -> Column:
        return F.max(F.when(F.col(contract) == F.add_months(F.col(period), ahead), F.col(settle)))

    points = joined.groupBy(period).agg(price(1).alias("forward_1m"), price(2).alias("forward_2m"))
    usable = (F.col("forward_1m") != 0) & (F.col("forward_2m") != 0)
    slope = F.when(usable, (F.col("forward_2m") - F.col("forward_1m")) / F.col("forward_1m"))
    return points.withColumn("forward_slope_1_2", slope)


def align_outer(series: Sequence[DataFrame], key: str = "period_month") -> DataFrame:
    """Full outer alignment of single-value series on one key."""
    return reduce(lambda a, b: a.join(b, key, "full"), series)


def vs_baseline(
    df: DataFrame, metric: str, baseline_model: str, by: Sequence[str] = ("version",), model: str = "model"
) -> DataFrame:
    """The baseline model's metric on every row of the same version, and the gain over it."""
    name = f"baseline_{metric}"
    baseline = df.where(F.col(model) == baseline_model).groupBy(*by).agg(F.max(metric).alias(name))
    return df.join(baseline, list(by), "left").withColumn(
        "improvement_vs_baseline", F.col(name) - F.col(metric)
    )


def stability(
    df: DataFrame, version_a, version_b, metric: str = "mae", key: Sequence[str] = ("model",)
) -> DataFrame:
    """Scores of two versions side by side with their difference and mean."""
    a = df.where(F.col("version") == F.lit(version_a)).select(*key, F.col(metric).alias(f"{metric}_a"))
    b = df.where(F.col("version") == F.lit(version_b)).select(*key, F.col(metric).alias(f"{metric}_b"))
    return a.join(b, list(key)).withColumns(
        {
            "delta_b_minus_a": F.round(F.col(f"{metric}_b") - F.col(f"{metric}_a"), 3),
            f"mean_{metric}": F.round((F.col(f"{metric}_a") + F.col(f"{metric}_b")) / 2, 3),
        }
    )


def compare_tags(
    before: DataFrame, after: DataFrame, middle: DataFrame | None = None,
    metric: str = "mae", key: Sequence[str] = ("model",),
) -> DataFrame:
    """Metric snapshots by model: difference and percent change of the last against the first.

    The first and last must both hold the model; a middle snapshot may lack it.
    """
    out = before.select(*key, F.col(metric).alias("before")).join(
        after.select(*key, F.col(metric).alias("after")), list(key)
    )
    if middle is not None:
        out = out.join(middle.select(*key, F.col(metric).alias("middle")), list(key), "left")
    change = F.round(F.col("after") - F.col("before"), 3)
    percent = F.round(change / F.when(F.col("before") != 0, F.col("before")) * 100, 2)
    return out.withColumns({"change": change, "change_pct": percent})


def lookup_region(df: DataFrame, name: str, grid: DataFrame, grid_name: str) -> DataFrame:
    """Attach the grid cell of a region name; unknown names keep nulls."""
    cells = grid.withColumnRenamed(grid_name, "_region")
    return df.join(cells, F.col(name) == F.col("_region"), "left").drop("_region")
