"""Grouped summaries, pivots, category mixes and coverage tables.

All of them are partial aggregations: each map task sends one row per group, so a group that
holds a large share of the rows costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import null_sum, row_sum, safe_ratio
from tidemark.functions.parsing import hier_key
from tidemark.operators.grids import LagSpec, add_lags, exogenous_lag, monthly_grid
from tidemark.operators.revisions import first_per_key


def to_monthly(
    df: DataFrame, values: Sequence[str], by: Sequence[str], date: str = "trade_date",
    out: str = "period_month",
) -> DataFrame:
    """Sums per month of the trade date, so hour 24 of a month's last day stays in that month."""
    return df.groupBy(F.trunc(F.col(date), "month").alias(out), *by).agg(
        *[F.sum(v).alias(v) for v in values]
    )


def daily_price_stats(
    df: DataFrame, price: str, date: str = "trade_date", by: Sequence[str] = (), out: str = "period_month"
) -> DataFrame:
    """Per month mean, sample deviation, extremes, range and last price by date."""
    daily = df.where(F.col(price).isNotNull())
    return daily.groupBy(*by, F.trunc(F.col(date), "month").alias(out)).agg(
        F.avg(price).alias("daily_mean"),
        F.stddev_samp(price).alias("daily_std"),
        F.max(price).alias("daily_max"),
        F.min(price).alias("daily_min"),
        F.max_by(price, date).alias("daily_last"),
        (F.max(price) - F.min(price)).alias("daily_range"),
    )


DAILY_LAGGED = ("daily_mean", "daily_std", "daily_range", "daily_last")


def daily_price_lags(
    df: DataFrame, price: str, date: str = "trade_date", by: Sequence[str] = (), out: str = "period_month"
) -> DataFrame:
    """The monthly statistics one month later, on a grid that is one month longer."""
    stats = daily_price_stats(df, price, date, by, out).select(*by, out, *DAILY_LAGGED)
    grid = monthly_grid(stats, by, out, extend=1)
    lagged = add_lags(grid, by, out, [LagSpec(c, 1, f"{c}_lag_1m") for c in DAILY_LAGGED])
    return lagged.select(*by, out, *[f"{c}_lag_1m" for c in DAILY_LAGGED])


def _pivot(df: DataFrame, index: Sequence[str], cat: str, value: str, values: Sequence[str], agg: str) -> DataFrame:
    def cell(v: str) -> str:
        label = v.replace("\\", "\\\\").replace("'", "\\'")
        return f"{agg}(CASE WHEN `{cat}` = '{label}' THEN `{value}` END) AS `{v}`"

    return df.groupBy(*index).agg(*[F.expr(cell(v)) for v in values])


def pivot_sum(df: DataFrame, index: Sequence[str], cat: str, value: str, values: Sequence[str]) -> DataFrame:
    """One column per known category in one pass; a cell without rows is null."""
    return _pivot(df, index, cat, value, values, "sum")


def pivot_mean(df: DataFrame, index: Sequence[str], cat: str, value: str, values: Sequence[str]) -> DataFrame:
    return _pivot(df, index, cat, value, values, "avg")


# fixed values: fuel categories
RENEWABLE_CAPACITY = (
    "renewable_solar", "renewable_wind", "renewable_fuel_cell", "renewable_hydro",
    "renewable_marine", "renewable_bio", "renewable_waste", "renewable_igcc",
)
RENEWABLE_TRADE = (
    "renewable_solar", "renewable_wind", "renewable_fuel_cell", "renewable_hydro",
    "renewable_marine", "renewable_bio", "renewable_biogas", "renewable_biomass",
    "renewable_bio_srf", "renewable_waste", "renewable_igcc",
)


def _named(name: str, unit: str) -> str:
    return f"{name}_{unit}"


def capacity_mix(
    long: DataFrame, value: str, cat: str, published: Sequence[str], renewable: Sequence[str],
    prefix: str = "capacity_fuel", unit: str = "mw", nuclear: str = "nuclear", lng: str = "lng",
    coal: tuple[str, str] = ("coal_bituminous", "coal_anthracite"), total: str = "total",
    index: str = "period_month", lagged: bool = True,
) -> DataFrame:
    """Capacity per fuel, renewable and coal totals, shares of the published total; one month lagged.

    ``published`` lists the category columns to emit; ``renewable`` the sub-fuels to sum.
    """
    wide = pivot_sum(long, [index], cat, value, sorted({*published, *renewable, nuclear, lng, *coal, total}))
    den = F.col(total)
    cols: dict[str, Column] = {f"{prefix}_{_named(c, unit)}": F.col(c) for c in published}
    renewable_total = row_sum([F.col(c) for c in renewable])
    coal_total = null_sum(*[F.col(c) for c in coal])
    cols[f"{prefix}_renewable_total_{unit}"] = renewable_total
    cols[f"{prefix}_nuclear_share"] = safe_ratio(F.col(nuclear), den)
    cols[f"{prefix}_lng_share"] = safe_ratio(F.col(lng), den)
    cols[f"{prefix}_coal_total_{unit}"] = coal_total
    cols[f"{prefix}_coal_total_share"] = safe_ratio(coal_total, den)
    cols[f"{prefix}_renewable_total_share"] = safe_ratio(renewable_total, den)
    current = wide.select(index, *[c.alias(n) for n, c in cols.items()])
    return exogenous_lag(current, list(cols), ts=index) if lagged else current


def capacity_type_mix(
    long: DataFrame, value: str, cat: str, groups: Mapping[str, Sequence[str]], singles: Mapping[str, str],
    total: str, shares: Mapping[str, str], prefix: str = "capacity_type", unit: str = "mw",
    index: str = "period_month", lagged: bool = True,
) -> DataFrame:
    """Sub-types summed into groups, single types passed through, shares of the total; lagged.

    ``groups`` and ``singles`` go from output name to sub-types; ``shares`` from output name to
    the group or single whose share it is.
    """
    values = sorted({total, *singles.values(), *[t for g in groups.values() for t in g]})
    wide = pivot_sum(long, [index], cat, value, values)
    parts: dict[str, Column] = {n: row_sum([F.col(t) for t in g]) for n, g in groups.items()}
    parts |= {n: F.col(t) for n, t in singles.items()}
    cols = {f"{prefix}_{n}_{unit}": c for n, c in parts.items()}
    cols |= {f"{prefix}_{n}_share": safe_ratio(parts[g], F.col(total)) for n, g in shares.items()}
    current = wide.select(index, *[c.alias(n) for n, c in cols.items()])
    return exogenous_lag(current, list(cols), ts=index) if lagged else current


def trade_mix(
    monthly: DataFrame, value: str, cat: str, prefix: str, unit: str,
    renewable: Sequence[str] = RENEWABLE_TRADE, nuclear: str = "nuclear", lng: str = "lng",
    coal: tuple[str, str] = ("coal_bituminous", "coal_anthracite"), oil: str = "oil",
    single_renewable: str | None = "renewable", index: str = "period_month", lagged: bool = True,
) -> DataFrame:
    """Traded volume or amount per fuel with total, shares and coal total; one month lagged.

    The total runs over nuclear, gas, the two coals, oil and renewables; pumped storage and
    other fuels are not in it. The renewable sum is 0, not null, when no sub-fuel is there.
    """
    named = {nuclear: "nuclear", lng: "lng", coal[0]: "coal_bituminous", coal[1]: "coal_anthracite", oil: "oil"}
    if single_renewable:
        named[single_renewable] = "renewable_singlecol"
    wide = pivot_sum(monthly, [index], cat, value, sorted({*named, *renewable}))
    cols: dict[str, Column] = {f"{prefix}_{n}_{unit}": F.col(c) for c, n in named.items()}
    renewable_total = row_sum([F.col(c) for c in renewable])
    cols[f"{prefix}_renewable_total_{unit}"] = renewable_total
    total = row_sum(list(cols.values()), min_count=1)
    coal_total = null_sum(F.col(coal[0]), F.col(coal[1]))
    cols |= {
        f"{prefix}_total_{unit}": total,
        f"{prefix}_nuclear_share": safe_ratio(F.col(nuclear), total),
        f"{prefix}_lng_share": safe_ratio(F.col(lng), total),
        f"{prefix}_renewable_share": safe_ratio(renewable_total, total),
        f"{prefix}_coal_total_{unit}": coal_total,
        f"{prefix}_coal_total_share": safe_ratio(coal_total, total),
    }
    current = wide.select(index, *[c.alias(n) for n, c in cols.items()])
    return exogenous_lag(current, list(cols), ts=index) if lagged else current


def yearly_totals(
    df: DataFrame, value: str, named: Mapping[str, str], category: str | None, total_label: str,
    level1: str = "level1", level2: str = "level2", year: str = "period_year",
) -> DataFrame:
    """Sum per year and two-level category of the total rows, pivoted to named columns.

    Where no row carries the total label, all rows count.
    """
    rows = df
    if category:
        labelled = F.max(F.col(category) == total_label)
        any_total = df.agg(F.coalesce(labelled, F.lit(False))).scalar()
        rows = df.where(~any_total | (F.col(category) == total_label))
    keyed = rows.withColumn("_key", hier_key(F.col(level1), F.col(level2)))
    wide = pivot_sum(keyed, [year], "_key", value, list(named))
    return wide.select(year, *[F.col("`" + k + "`").alias(v) for k, v in named.items()])


def mean_duplicates(df: DataFrame, key: Sequence[str], values: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).agg(*[F.avg(v).alias(v) for v in values])


def coverage(df: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows and first and last period, per category if asked."""
    return df.groupBy(*by).agg(
        F.count("*").alias("rows"), F.min(time).alias("period_min"), F.max(time).alias("period_max")
    )


def source_inventory(
    df: DataFrame, path: str = "parsed_path", source: str = "source_id",
    times: Sequence[str] = ("period_month", "trade_date", "interval_end"), year: str = "period_year",
) -> DataFrame:
    """Per source its snapshots, rows and the range of the first time column it fills.

    A yearly column widens to the first and last day of its years.
    """
    present = [F.col(c).cast("date") for c in times if c in df.columns]
    lows, highs = [F.min(c) for c in present], [F.max(c) for c in present]
    if year in df.columns:
        lows.append(F.make_date(F.min(year), F.lit(1), F.lit(1)))
        highs.append(F.make_date(F.max(year), F.lit(12), F.lit(31)))
    return df.groupBy(source).agg(
        F.count_distinct(F.col(path)).alias("snapshots"),
        F.count("*").alias("rows"),
        F.coalesce(*lows).alias("period_min"),
        F.coalesce(*highs).alias("period_max"),
    )


def null_coverage(df: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Filled cells per feature group in percent, from one pass over the table."""
    used = sorted({c for cols in groups.values() for c in cols})
    counts = df.agg(F.count("*").alias("_rows"), *[F.count(c).alias(c) for c in used])
    cells = [
        F.struct(
            F.lit(name).alias("feature_group"),
            F.lit(len(cols)).alias("n_cols"),
            (
                row_sum([F.col(c) for c in cols]) * 100.0
                / F.when(F.col("_rows") > 0, F.col("_rows") * len(cols))
            ).alias("non_null_pct"),
        )
        for name, cols in groups.items()
        if cols
    ]
    return counts.select(F.inline(F.array(*cells)))


def column_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Non-null count per column, one row each."""
    counts = df.agg(*[F.count(c).alias(c) for c in cols])
    return counts.unpivot([], list(cols), "column", "non_null")


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.groupBy(*cols).agg(F.count("*").alias("rows"))


def histogram(df: DataFrame, col: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bin counts between the smallest and largest value; the last bin is closed."""
    if bins < 1:
        raise ValueError("bins must be at least 1")
    rows = df.where(F.col(col).isNotNull())
    if by:
        spans = rows.groupBy(*by).agg(F.min(col).alias("_lo"), F.max(col).alias("_hi"))
        joined = rows.join(spans, list(by))
    else:
        lo, hi = (rows.agg(f(col)).scalar() for f in (F.min, F.max))
        joined = rows.withColumns({"_lo": lo, "_hi": hi})
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.when(width > 0, F.floor((F.col(col) - F.col("_lo")) / F.when(width > 0, width))).otherwise(0)
    counted = joined.groupBy(*by, "_lo", "_hi", F.least(slot, F.lit(bins - 1)).cast("int").alias("bin")).agg(
        F.count("*").alias("rows")
    )
    return counted.select(
        *by, "bin", (F.col("_lo") + F.col("bin") * width).alias("bin_start"), "rows"
    )


def fold_summary(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """Mean and population deviation of fold metrics."""
    aggs: list[Column] = [F.count("*").alias("n_folds")]
    for m in metrics:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std")]
    return df.groupBy(*by).agg(*aggs)


def ablation_matrix(df: DataFrame, models: Sequence[str], metric: str = "mae") -> DataFrame:
    """Mean metric, one row per feature group and one column per model."""
    return pivot_mean(df, ["feature_group"], "model", metric, models)


def quality_report(runs: DataFrame, covered: DataFrame, quarantine: DataFrame | None = None) -> DataFrame:
    """Latest run per source with coverage, and the notes that follow from them.

    ``runs`` holds source_id, collected_at, source_file, dropped_columns, missing_categories
    (arrays) and zero_rows (map); ``covered`` holds source_id, rows, period_min, period_max.
    """
    latest = first_per_key(
        runs, ["source_id"], [F.col("collected_at").desc_nulls_last(), F.col("source_file").asc()]
    )
    n_runs = runs.groupBy("source_id").agg(F.count("*").alias("runs"))
    joined = latest.drop("rows").join(n_runs, "source_id").join(covered, "source_id", "left")
    rows = F.coalesce(F.col("rows"), F.lit(0))
    zero_total = F.aggregate(
        F.coalesce(F.map_values("zero_rows"), F.array().cast("array<bigint>")),
        F.lit(0).cast("bigint"), lambda total, n: total + n,
    )
    prefix = F.concat(F.col("source_id"), F.lit(": "))
    notes = F.array(
        F.when(rows == 0, F.concat(prefix, F.lit("no parsed rows yet"))).when(
            F.size("dropped_columns") > 0,
            F.concat(prefix, F.lit("dropped vendor columns "), F.concat_ws(", ", "dropped_columns")),
        ),
        F.when(
            F.size("missing_categories") > 0,
            F.concat(prefix, F.lit("categories absent "), F.concat_ws(", ", "missing_categories")),
        ),
        F.when(
            zero_total > 0,
            F.concat(prefix, F.lit("dropped "), zero_total.cast("string"), F.lit(" rows with zero for not published")),
        ),
    )
    report = joined.select(
        "source_id",
        F.col("source_file").alias("latest_source_file"),
        "runs",
        rows.alias("rows"),
        "period_min",
        "period_max",
        F.concat_ws("; ", F.array_compact(notes)).alias("notes"),
    )
    if quarantine is None:
        return report
    held = quarantine.select(
        F.col("source_id"),
        F.col("original_path").alias("latest_source_file"),
        F.lit(0).cast("bigint").alias("runs"),
        F.lit(0).cast("bigint").alias("rows"),
        F.lit(None).cast(report.schema["period_min"].dataType).alias("period_min"),
        F.lit(None).cast(report.schema["period_max"].dataType).alias("period_max"),
        F.concat(F.lit("quarantine: "), F.col("original_path"), F.lit(" ("), F.col("reason"), F.lit(")")).alias("notes"),
    )
    return report.unionByName(held)
