"""Incremental load of a drop folder: every new file once, conformed and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.sources.spec import SourceSpec, conform_source


def batch_path(table: str, epoch: int) -> str:
    return f"{table}/batch_id={epoch}"


def ingest_inbox(
    spark: SparkSession, spec: SourceSpec, inbox: str, table: str, checkpoint: str, schema: StructType,
    file_format: str = "csv", glob: str | None = None, files_per_batch: int = 100,
) -> StreamingQuery:
    """Start a run that loads what is new in the folder and stops.

    A batch owns its own folder in the table and replaces it when it is replayed after a
    failure, so every file counts once.
    """
    reader = spark.readStream.schema(schema).format(file_format).option("maxFilesPerTrigger", files_per_batch)
    if file_format == "csv":
        reader = reader.option("header", True).option("encoding", spec.encoding)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    # a file is known by its place, size and time; its content is read once, as rows
    meta = F.col("_metadata")
    identity = F.concat_ws("|", meta["file_path"], meta["file_size"], meta["file_modification_time"])
    plain = F.url_decode(F.replace(meta["file_name"], F.lit("+"), F.lit("%2B")))
    stream = reader.load(inbox).select("*", plain.alias("_name"), F.sha2(identity, 256).alias("_sha"))

    def load(batch: DataFrame, epoch: int) -> None:
        canonical = conform_source(batch, spec, F.current_timestamp(), F.col("_name"), F.col("_sha"))
        canonical.write.mode("overwrite").parquet(batch_path(table, epoch))

    return (
        stream.writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
