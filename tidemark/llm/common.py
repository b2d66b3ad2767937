"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import apply_settings, materialise

__all__ = ["QUERIES", "ORACLES", "query", "table", "collapsed", "word_count", "materialise", "stage_rows", "kept_ids"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: a white-space run that is not already one plain space
_RUN = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a ``(spark, sf_dir) -> DataFrame`` callable and its SQL, if SQL can say it."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return apply_settings(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def collapsed(text: Column) -> Column:
    """The text (null: empty) with every ``[\\x20\\x09-\\x0D]+`` replaced by one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUN, " ")


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in the text (null: 0), from byte lengths only."""
    flat = F.trim(collapsed(text))
    gaps = F.octet_length(flat) - F.octet_length(F.replace(flat, F.lit(" "), F.lit("")))
    return F.when(flat == "", F.lit(0)).otherwise(gaps + 1).cast("long")


def kept_ids(ids: DataFrame, labels: DataFrame, keep: Column, limit: int) -> DataFrame:
    """At most ``limit`` labelled ids, chosen by a hash of the id: the bounded fitting sample."""
    return ids.join(labels.filter(keep), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def stage_rows(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Only the columns of the stage's input, in its order."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])
