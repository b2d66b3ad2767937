"""The current revision per key while snapshots keep arriving.

Choosing a winner is associative, so a key's winner so far is all the state there is: a streaming aggregate
keeps one row per key in the state store, looks only at the keys of a micro-batch, and hands on their winners.
Each batch of winners is one committed upsert. There is no watermark, as a revision may come years later.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.operators.revisions import REVISION, RevisionColumns
from tidemark.session import materialise
from tidemark.sources import tables

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def winners(df: DataFrame, keys: Sequence[str], meta: RevisionColumns = REVISION) -> DataFrame:
    """One row per key in the order of revisions, as an aggregate: of a table, or of a stream in update mode."""
    best = F.min_by(F.struct(*df.columns), meta.rank_struct(df))
    return df.groupBy(*[F.col(k).alias(f"_key_{k}") for k in keys]).agg(best.alias("_row")).select("_row.*")


def follow_revisions(
    spark: SparkSession, inbox: str, schema: StructType, keys: Sequence[str], table: str, checkpoint: str,
    files_per_batch: int = 100, buckets: int = tables.BUCKETS, writer: str = "revisions",
) -> StreamingQuery:
    """Start a run over the new snapshot files; a replayed batch is already in the table and left out.

    State lies on the executors' disks, with its changes in the checkpoint, so it may outgrow their memory.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    if not tables.versions(spark, table):
        tables.create_table(spark, table, schema, keys, buckets)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(inbox)

    def commit(batch: DataFrame, epoch: int) -> None:
        # written once: the state must not be updated again for each look at the batch
        tables.upsert_table(materialise(batch, "winners"), table, (writer, epoch), null_safe=True)

    return (
        winners(stream, keys).writeStream.outputMode("update").foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def current_view(spark: SparkSession, table: str) -> DataFrame:
    """The winning revision per key over everything seen so far: a plain read."""
    return tables.read_table(spark, table)
