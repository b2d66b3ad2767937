"""Delimited vendor files, parquet snapshots and files held back."""

from __future__ import annotations

import csv
import fnmatch
import unicodedata
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FORMATS = {"csv": ",", "tsv": "\t"}


def separator(path: str, file_format: str | None = None) -> str:
    """Field separator of a declared format, else of the path's suffix."""
    fmt = (file_format or path.rsplit(".", 1)[-1]).lower()
    if fmt not in _FORMATS:
        raise ValueError(f"unsupported file format {fmt!r} for {path}")
    return _FORMATS[fmt]


def _first_lines(spark: SparkSession, path: str, encoding: str, n: int) -> list[str]:
    """The first few decoded lines of the first file; only header rows come to the driver."""
    lines = (
        spark.read.option("encoding", encoding)
        .option("sep", "\u0001").option("quote", "").option("header", False)
        .schema("line string").csv(path)
    )
    return [row[0] or "" for row in lines.head(n)]


def flatten_headers(rows: Sequence[Sequence[str]], sep: str = "|") -> list[str]:
    """One name per column from several header rows.

    Labels above the last row stand for the empty cells to their right, as merged cells do; the last row
    is taken as it is, so a column without a label there keeps an empty one.
    """
    if not rows:
        return []
    width = max(map(len, rows))
    *above, last = [[*(cell.strip() for cell in row), *[""] * (width - len(row))] for row in rows]
    spread = [accumulate(row, lambda label, cell: cell or label) for row in above]
    return [sep.join(labels) for labels in zip(*spread, last)]


def _body(
    spark: SparkSession, path: str, sep: str, encoding: str, names: Sequence[str], skip: int
) -> DataFrame:
    """All rows as strings without the first ``skip`` lines of each file.

    Only rows in the block that starts a file are numbered; every later block passes as is.
    """
    columns = [f"_c{i}" for i in range(len(names))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    raw = (
        spark.read.schema(schema).option("encoding", encoding).option("sep", sep)
        .option("header", False).option("ignoreLeadingWhiteSpace", False).csv(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_at"))
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    heads = raw.where("_at = 0").groupBy("_file").agg(F.min("_seq").alias("_first"))
    # one row per file, and the list of files is in the driver's index already
    kept = raw.join(F.broadcast(heads), "_file", "left").where(
        (F.col("_at") > 0) | (F.col("_seq") - F.col("_first") >= skip)
    )
    return kept.select(*[F.col(c).alias(n) for c, n in zip(columns, names)])


def read_delimited(
    spark: SparkSession, path: str, file_format: str | None = None, encoding: str = "utf-8",
    skip_rows: int = 0, header_row: int = 0, skip_after_header: int = 0,
) -> DataFrame:
    """Delimited text with string columns and trimmed headers.

    ``header_row`` counts after ``skip_rows``; separator rows after the header can be skipped.
    """
    sep = separator(path, file_format)
    if not (skip_rows or header_row or skip_after_header):
        df = spark.read.option("encoding", encoding).csv(path, header=True, sep=sep)
        return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])
    at = skip_rows + header_row
    lines = _first_lines(spark, path, encoding, at + 1)
    names = [c.lstrip("\ufeff").strip() for c in next(csv.reader([lines[at]], delimiter=sep))]
    return _body(spark, path, sep, encoding, names, at + 1 + skip_after_header)


def read_multi_header(
    spark: SparkSession, path: str, header_rows: int, file_format: str | None = None,
    encoding: str = "utf-8", skip_rows: int = 0, skip_after_header: int = 0, name_sep: str = "|",
) -> DataFrame:
    """Delimited text whose column names are spread over several header rows."""
    sep = separator(path, file_format)
    lines = _first_lines(spark, path, encoding, skip_rows + header_rows)[skip_rows:]
    rows = list(csv.reader([line.lstrip("\ufeff") for line in lines], delimiter=sep))
    names = flatten_headers(rows, name_sep)
    return _body(spark, path, sep, encoding, names, skip_rows + header_rows + skip_after_header)


def read_snapshots(
    spark: SparkSession, root: str, source_id: str, default_priority: int = 99
) -> DataFrame | None:
    """Every parsed snapshot of a source with complete revision metadata; None if there is none.

    Files written before a metadata column existed get its default. The position of a row in
    its file is kept, so that a row has an identity.
    """
    path = f"{root}/source_id={source_id}"
    try:
        df = (
            spark.read.option("mergeSchema", True).option("recursiveFileLookup", True)
            .option("pathGlobFilter", "*.parquet").parquet(path)
        )
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            return None
        raise

    def filled(name: str, default: Column) -> Column:
        return F.coalesce(F.col(name), default) if name in df.columns else default

    return df.withColumns(
        {
            "source_id": filled("source_id", F.lit(source_id)),
            "source_priority": filled("source_priority", F.lit(default_priority)).cast("int"),
            "source_file_sha256": filled("source_file_sha256", F.lit("")),
            "parsed_path": F.col("_metadata.file_path"),
            "parsed_row": F.col("_metadata.row_index"),
        }
    )


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union of tables with unlike columns; what a table lacks becomes null."""
    if not dfs:
        raise ValueError("nothing to union")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def read_sources(
    spark: SparkSession, root: str, priorities: dict[str, int]
) -> DataFrame:
    """Union of several sources' snapshots; an error if none of them has data."""
    found = [read_snapshots(spark, root, s, p) for s, p in priorities.items()]
    present = [df for df in found if df is not None]
    if not present:
        raise FileNotFoundError(f"no snapshots of {sorted(priorities)} under {root}")
    return union_all(present)


@F.pandas_udf(T.StringType())
def nfc(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode NFC form; Spark has no built-in for it."""
    for batch in names:
        yield batch.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


def glob_matches(name: Column, patterns: Sequence[str]) -> Column:
    """Whether a name matches one of the file globs, both in NFC form."""
    regexes = [fnmatch.translate(unicodedata.normalize("NFC", p)) for p in patterns]
    # Java has no \Z for the absolute end that also rejects a final newline: use \z
    java = "|".join(r.replace(r"\Z", r"\z").replace("(?>", "(?:") for r in regexes)
    return name.rlike(f"^(?:{java})") if regexes else F.lit(False)


def quarantine_manifest(
    files: DataFrame, patterns: Sequence[str], source_id: str, reason: str, notes: Sequence[str] = (),
    name: str = "file_name", path: str = "path", sha256: str = "sha256",
) -> DataFrame:
    """One row per file whose name says something its content does not hold."""
    # plain ASCII is in normal form already and does not need the round trip through Python
    other = F.when(F.col(name).rlike("[^\\x00-\\x7F]"), F.col(name))
    normal = files.withColumn("_name", F.coalesce(nfc(other), F.col(name)))
    return normal.where(glob_matches(F.col("_name"), patterns)).select(
        F.lit(source_id).alias("source_id"),
        F.lit("pending_schema_verification").alias("status"),
        F.lit(reason).alias("reason"),
        F.col(path).alias("original_path"),
        F.col(sha256).alias("sha256"),
        F.array(*[F.lit(n) for n in notes]).cast("array<string>").alias("notes"),
    )
