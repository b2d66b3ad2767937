"""Renaming, reshaping and filtering of vendor tables into canonical long tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parsing as p

# fixed value: marks a mapping entry nobody has filled in yet
TBD = "TBD_AFTER_FIRST_DOWNLOAD"

ZERO_IS_MISSING = 1e-9


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def apply_mapping(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename vendor columns; ``mapping`` goes from canonical name to vendor header."""
    open_entries = [k for k, v in mapping.items() if v == TBD]
    if open_entries:
        raise ValueError(f"column mapping has entries to be filled in: {open_entries}")
    missing = [v for v in mapping.values() if v not in df.columns]
    if missing:
        raise ValueError(f"vendor columns {missing} are not in the file; it has {df.columns}")
    return df.withColumnsRenamed({vendor: name for name, vendor in mapping.items()})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: p.number(quoted(c)) for c in cols if c in df.columns})


def coerce_percent(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, p.percent(quoted(col)))


def map_category(df: DataFrame, raw: str, mapping: Mapping[str, str], out: str) -> DataFrame:
    """Trimmed label to canonical value; rows without one are dropped."""
    value = p.lookup(F.trim(F.col(raw).cast("string")), mapping)
    return df.withColumn(out, value).where(F.col(out).isNotNull())


def map_category_hier(
    df: DataFrame, level1: str, level2: str, mapping: Mapping[str, str], out: str
) -> DataFrame:
    """Pair lookup with fallback to the first level; unknown stays null."""
    return df.withColumn(out, p.lookup_hier(F.col(level1), F.col(level2), mapping))


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str, val: str) -> DataFrame:
    """Wide to long for a fixed list of value columns; nulls are kept."""
    return df.unpivot([quoted(c) for c in ids], [quoted(c) for c in values], var, val)


def melt_hier(
    df: DataFrame, ids: Sequence[str], val: str, level1: str = "level1", level2: str = "level2",
    sep: str = "|",
) -> DataFrame:
    """Melt every other column and split its name once into two levels.

    A name without a second level gets an empty one; an empty input keeps the schema.
    """
    cells = []
    for name in df.columns:
        if name not in ids:
            first, _, second = name.partition(sep)
            cells.append(
                F.struct(
                    F.lit(first.strip()).alias(level1),
                    F.lit(second.strip()).alias(level2),
                    p.number(quoted(name)).alias(val),
                )
            )
    if not cells:
        raise ValueError(f"nothing to melt besides {list(ids)}")
    return df.select(*[quoted(c) for c in ids], F.inline(F.array(*cells)))


def zero_flag(col: str, eps: float = ZERO_IS_MISSING) -> Column:
    return F.coalesce(F.abs(F.col(col)) < eps, F.lit(False))


def zero_is_missing(df: DataFrame, col: str, eps: float = ZERO_IS_MISSING) -> DataFrame:
    """A literal zero means "not published": such rows and nulls are dropped."""
    return df.where(F.col(col).isNotNull() & ~zero_flag(col, eps))


def zero_counts(df: DataFrame, col: str, by: Sequence[str], eps: float = ZERO_IS_MISSING) -> DataFrame:
    """How many rows per category ``zero_is_missing`` takes out for being zero."""
    return df.where(zero_flag(col, eps)).groupBy(*by).agg(F.count("*").alias("zero_rows"))


def keep_total_rows(df: DataFrame, filters: Mapping[str, str] | None) -> DataFrame:
    """Rows whose metadata columns all carry their total label; absent columns are ignored."""
    present = {c: v for c, v in (filters or {}).items() if c in df.columns}
    if not present:
        return df
    return df.where(
        reduce(and_, [F.trim(F.col(c).cast("string")) == str(v).strip() for c, v in present.items()])
    )


def drop_missing(df: DataFrame, required: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(required))


def stamp_provenance(
    df: DataFrame, source_id: str, collected_at: Column, source_file: Column, sha256: Column,
    priority: int = 99, path: Column | None = None,
) -> DataFrame:
    """The revision metadata columns every canonical row carries."""
    return df.withColumns(
        {
            "source_id": F.lit(source_id),
            "source_priority": F.lit(priority),
            "collected_at": collected_at.cast("timestamp_ntz"),
            "source_file": source_file,
            "source_file_sha256": sha256,
            "parsed_path": path if path is not None else source_file,
        }
    )


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Project to the canonical columns and types; a missing column is an error."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"canonical columns missing: {missing}")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def unknown_columns(df: DataFrame, schema: T.StructType) -> list[str]:
    """Columns the canonical schema does not know; they are reported, not rejected."""
    known = {f.name for f in schema}
    return [c for c in df.columns if c not in known]


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"{what}: no rows")
    return df


def dropped_columns(df: DataFrame, used: Sequence[str]) -> list[str]:
    """Vendor columns the mapping does not use, sorted."""
    return sorted(set(df.columns) - set(used))


def absent_categories(df: DataFrame, col: str, expected: Sequence[str]) -> DataFrame:
    """Expected categories the data does not hold."""
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], f"{col} string")
    return wanted.join(df.select(col).distinct(), col, "left_anti")


def explode_leads(
    df: DataFrame, record: str, issued: str, leads: Sequence[int] = tuple(range(3, 11)),
    low: str = "taMin", high: str = "taMax",
) -> DataFrame:
    """One row per forecast lead of a ``map<string,string>`` record.

    The forecast date is the issue date plus the lead. A lead is skipped only when both of
    its keys are absent; a key with an empty value still makes a row.
    """
    rec = F.col(record)

    def cell(k: int) -> Column:
        lo, hi = F.lit(f"{low}{k}"), F.lit(f"{high}{k}")
        return F.struct(
            F.lit(k).alias("lead_days"),
            (F.map_contains_key(rec, lo) | F.map_contains_key(rec, hi)).alias("present"),
            p.number(F.try_element_at(rec, lo)).alias("ta_min"),
            p.number(F.try_element_at(rec, hi)).alias("ta_max"),
        )

    cells = F.filter(F.array(*[cell(k) for k in leads]), lambda c: c["present"])
    others = [c for c in df.columns if c != record]
    issue_date = F.try_to_timestamp(F.col(issued), F.lit("yyyyMMddHHmm")).cast("date")
    return (
        df.select(*others, F.explode(cells).alias("_cell"))
        .select(
            *others,
            F.date_add(issue_date, F.col("_cell.lead_days")).alias("forecast_date"),
            F.col("_cell.lead_days").alias("lead_days"),
            F.col("_cell.ta_min").alias("ta_min"),
            F.col("_cell.ta_max").alias("ta_max"),
        )
        .where(F.col("forecast_date").isNotNull())
    )


def eav_numeric(df: DataFrame, value: str) -> DataFrame:
    """Keep the raw text and add its numeric twin, null when it is not a number."""
    return df.withColumn(f"{value}_numeric", p.number(F.col(value)))


def series_rows(
    df: DataFrame, source_id: str, period: str = "period", series: str = "seriesId",
    value: str = "value", unit: str = "unit",
) -> DataFrame:
    """Macro-series rows: month, series id, numeric value, units (empty when not given)."""
    units = F.coalesce(F.col(unit).cast("string"), F.lit("")) if unit in df.columns else F.lit("")
    return df.select(
        F.lit(source_id).alias("source_id"),
        p.to_month(F.col(period), "%Y-%m").alias("period_month"),
        F.col(series).alias("series_id"),
        p.number(F.col(value)).alias("value"),
        units.alias("units"),
    ).na.drop(subset=["period_month", "value"])


def filter_area(df: DataFrame, area: str, aliases: Mapping[str, str], column: str = "area") -> DataFrame:
    """Rows of one area given by canonical name or alias; a name that is neither is an error."""
    canonical = aliases.get(area, area)
    if canonical not in set(aliases.values()):
        raise ValueError(f"unknown area {area!r}; known: {sorted(set(aliases.values()))}")
    return df.where(F.col(column) == canonical)


def missing_areas(df: DataFrame, aliases: Mapping[str, str], column: str = "area") -> DataFrame:
    """The canonical areas without rows, as a table."""
    known = df.sparkSession.createDataFrame([(a,) for a in sorted(set(aliases.values()))], f"`{column}` string")
    return known.join(df.select(column).distinct(), column, "left_anti")


# fixed values: time columns in order of preference
TIME_COLUMNS = ("period_month", "trade_date", "interval_end")


def event_date(df: DataFrame, candidates: Sequence[str] = TIME_COLUMNS) -> DataFrame:
    """Partition date of a load: the newest value of the first time column present."""
    present = [c for c in candidates if c in df.columns]
    if not present:
        raise ValueError(f"none of {list(candidates)} in {df.columns}")
    return df.agg(F.max(present[0]).cast("date").alias("event_date"))


def select_columns(
    df: DataFrame, names: Sequence[str] = (), prefixes: Sequence[str] = (), keep: Sequence[str] = ()
) -> DataFrame:
    """Columns listed by name or matching a prefix, in table order, after ``keep``."""
    chosen = [c for c in df.columns if c in names or (prefixes and c.startswith(tuple(prefixes)))]
    return df.select(*keep, *[c for c in chosen if c not in keep])


def numeric_columns(df: DataFrame, drop: Sequence[str] = ()) -> list[str]:
    numeric = (T.NumericType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, numeric) and f.name not in drop]


def numeric_matrix(df: DataFrame, target: str, bookkeeping: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Numeric and boolean columns as doubles, without the target and bookkeeping columns."""
    features = numeric_columns(df, [target, *bookkeeping, *keep])
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in features])
