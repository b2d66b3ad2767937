"""Sorting, newest rows and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sort_mixed(df: DataFrame, keys: Sequence[str], ascending: Sequence[bool]) -> DataFrame:
    """Total order with a direction per key and nulls last in each."""
    if len(keys) != len(ascending):
        raise ValueError("one direction per key")
    return df.orderBy(
        *[F.col(k).asc_nulls_last() if up else F.col(k).desc_nulls_last() for k, up in zip(keys, ascending)]
    )


def latest_rows(df: DataFrame, ts: str, n: int = 1, ties: Sequence[str] = ()) -> DataFrame:
    """The newest ``n`` rows: a top-n per task and one small merge, never a full sort."""
    return df.orderBy(F.col(ts).desc_nulls_last(), *[F.col(t).asc() for t in ties]).limit(n)


def _sides(a: DataFrame, b: DataFrame) -> DataFrame:
    """Each different row of either side once (nulls equal), with whether ``a`` and ``b`` hold it.

    One aggregation, so a task keeps different rows only. ``intersect`` and ``subtract`` become joins with
    every row of ``b``, repeated or not, and a broadcast of ``b`` stands in memory with all its copies.
    """
    names = [f"_{i}" for i in range(len(a.columns))]
    marked = [df.toDF(*names).withColumns({"_a": F.lit(df is a), "_b": F.lit(df is b)}) for df in (a, b)]
    return marked[0].union(marked[1]).groupBy(*names).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))


def intersect_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).filter("_a AND _b").drop("_a", "_b").toDF(*a.columns)


def except_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    return _sides(a, b).filter("_a AND NOT _b").drop("_a", "_b").toDF(*a.columns)
