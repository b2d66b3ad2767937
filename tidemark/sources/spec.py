"""One config-driven load for every vendor table: a spec says how, one function does it."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parsing as p
from tidemark.operators import cleaning as c
from tidemark.sources.files import read_delimited, read_multi_header


@dataclass(frozen=True)
class Period:
    """Where the time key comes from.

    ``kind``: ``month`` (text in ``fmt``), ``parts`` (year and month columns), ``day`` (text in
    ``fmt``), ``filename_year`` (capture group ``fmt`` of the file name).
    """

    kind: str
    columns: tuple[str, ...] = ()
    fmt: str = ""
    strict: bool = False
    out: str = "period_month"


@dataclass(frozen=True)
class Melt:
    """Wide to long: a fixed list of columns, or every other one split into two levels.

    ``joined`` keeps the levels as one key as well.
    """

    value: str
    columns: tuple[str, ...] = ()
    var: str = "category_raw"
    level1: str = "level1"
    level2: str = "level2"
    joined: str | None = None


@dataclass(frozen=True)
class Category:
    """Label to canonical value; with two ``raw`` columns the pair is looked up first."""

    raw: tuple[str, ...]
    out: str
    mapping: Mapping[str, str]
    required: bool = True


@dataclass(frozen=True)
class SourceSpec:
    source_id: str
    schema: str
    mapping: Mapping[str, str] = field(default_factory=dict)
    period: Period | None = None
    hour: str | None = None
    measures: tuple[str, ...] = ()
    percents: tuple[str, ...] = ()
    totals: Mapping[str, str] = field(default_factory=dict)
    ids: tuple[str, ...] = ()
    melt: Melt | None = None
    category: Category | None = None
    contract: tuple[str, str, str] | None = None
    zero_is_missing: str | None = None
    required: tuple[str, ...] = ()
    priority: int = 99
    file_format: str | None = None
    encoding: str = "utf-8"
    skip_rows: int = 0
    header_row: int = 0
    header_rows: int = 0
    skip_after_header: int = 0


def read_source(spark: SparkSession, spec: SourceSpec, path: str) -> DataFrame:
    if spec.header_rows:
        df = read_multi_header(
            spark, path, spec.header_rows, spec.file_format, spec.encoding, spec.skip_rows,
            spec.skip_after_header,
        )
        return df.toDF(*[n.rstrip("|").strip() for n in df.columns])
    return read_delimited(
        spark, path, spec.file_format, spec.encoding, spec.skip_rows, spec.header_row,
        spec.skip_after_header,
    )


def _with_period(df: DataFrame, rule: Period, file_name: Column | None) -> DataFrame:
    if rule.kind == "month":
        value = p.to_month(F.col(rule.columns[0]), rule.fmt, rule.strict)
    elif rule.kind == "day":
        value = p.to_trade_date(F.col(rule.columns[0]), rule.fmt)
    elif rule.kind == "parts":
        value = p.month_from_parts(*[p.number(F.col(n)) for n in rule.columns])
    elif rule.kind == "filename_year":
        if file_name is None:
            raise ValueError("a year from the file name needs the file name")
        value = p.from_filename(file_name, rule.fmt or r"\((\d{4})\)").cast("int")
    else:
        raise ValueError(f"unknown period rule {rule.kind!r}")
    return df.withColumn(rule.out, value).where(F.col(rule.out).isNotNull())


def conform_source(
    df: DataFrame, spec: SourceSpec, collected_at: Column, file_name: Column, sha256: Column,
) -> DataFrame:
    """Rename, filter, type, melt, map and stamp one vendor table into its canonical schema.

    Narrow transformations only: one stage, no shuffle.
    """
    out = c.apply_mapping(df, spec.mapping)
    out = c.keep_total_rows(out, spec.totals)
    if spec.period:
        out = _with_period(out, spec.period, file_name)
    out = c.coerce_numeric(out, spec.measures)
    for name in spec.percents:
        out = c.coerce_percent(out, name)
    if spec.hour:
        out = c.drop_missing(out.withColumn(spec.hour, p.number(F.col(spec.hour)).cast("int")), [spec.hour])
        out = out.withColumn("interval_end", p.interval_end(F.col(spec.period.out), F.col(spec.hour)))
    if spec.melt and spec.melt.columns:
        present = [n for n in spec.melt.columns if n in out.columns]
        if not present:
            raise ValueError(f"none of the value columns {list(spec.melt.columns)} in {out.columns}")
        out = c.melt(out, spec.ids, present, spec.melt.var, spec.melt.value)
        out = c.coerce_numeric(out, [spec.melt.value])
    elif spec.melt:
        used = set(spec.ids)
        spent = set(spec.period.columns if spec.period else ()) - used
        out = c.melt_hier(out.drop(*spent), list(spec.ids), spec.melt.value, spec.melt.level1, spec.melt.level2)
        if spec.melt.joined:
            key = p.hier_key(F.col(spec.melt.level1), F.col(spec.melt.level2))
            out = out.withColumn(spec.melt.joined, key)
    if spec.contract:
        label, code, quote = (F.col(n) for n in spec.contract)
        out = out.withColumn("contract_month", p.contract_month(label, code, quote))
    if spec.category:
        rule = spec.category
        if len(rule.raw) == 2:
            out = c.map_category_hier(out, *rule.raw, rule.mapping, rule.out)
        else:
            out = out.withColumn(rule.out, p.lookup(F.trim(F.col(rule.raw[0])), rule.mapping))
        if rule.required:
            out = out.where(F.col(rule.out).isNotNull())
    if spec.zero_is_missing:
        out = c.zero_is_missing(out, spec.zero_is_missing)
    if spec.required:
        # blank labels are missing labels
        out = out.where(
            reduce(and_, [F.trim(F.coalesce(F.col(n).cast("string"), F.lit(""))) != "" for n in spec.required])
        )
    out = c.stamp_provenance(out, spec.source_id, collected_at, file_name, sha256, spec.priority)
    return c.conform(out, T.StructType.fromDDL(spec.schema))


def load_source(
    spark: SparkSession, spec: SourceSpec, path: str, collected_at: Column, file_name: str, sha256: Column
) -> DataFrame:
    """Read one vendor file and conform it; a file that yields nothing is an error."""
    out = conform_source(read_source(spark, spec, path), spec, collected_at, F.lit(file_name), sha256)
    return c.require_rows(out, f"{spec.source_id}: {file_name}")
