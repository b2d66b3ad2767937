"""Append-only tables and report files.

Snapshots and logs are append-only: a snapshot id is written once, and readers pick the
winning revision. Several columns partition the files so that later reads prune them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.cleaning import TIME_COLUMNS, event_date


def write_snapshot(
    df: DataFrame, root: str, source_id: str, snapshot_id: str, times: Sequence[str] = TIME_COLUMNS
) -> str:
    """Write one immutable snapshot under the newest date it holds; an existing id is refused.

    The date is one scalar over the snapshot, so the rows are written where they are.
    """
    path = f"{root}/source_id={source_id}/snapshot_id={snapshot_id}"
    dated = df.withColumn("event_date", event_date(df, times).scalar())
    try:
        dated.write.partitionBy("event_date").mode("errorifexists").parquet(path)
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_ALREADY_EXISTS":
            raise FileExistsError(f"snapshot {snapshot_id} of {source_id} is already written") from exc
        raise
    return path


RUN_LOG = (
    "source_id string, started_at timestamp_ntz, collected_at timestamp_ntz, source_file string, "
    "status string, rows bigint, unit string, limitations array<string>, "
    "dropped_columns array<string>, missing_categories array<string>, zero_rows map<string,bigint>"
)


def append_run_log(runs: DataFrame, path: str) -> None:
    """One row per load, with lists and counts as nested columns."""
    fields = [f.split(" ")[0] for f in RUN_LOG.split(", ")]
    runs.select(*fields).write.mode("append").parquet(path)


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RUN_LOG).parquet(path)


def append_archive(rows: DataFrame, path: str) -> None:
    """Ranges over date and id: few dates per task, and a full date spread over several tasks."""
    ranged = rows.repartitionByRange("event_date", "payload_id")
    ranged.write.mode("append").partitionBy("source_id", "event_date").parquet(path)


def write_csv_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True)


def write_json_report(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("ignoreNullFields", False).json(path)


def append_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
