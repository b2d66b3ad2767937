"""Exact deduplication: 128-bit content hash, smallest stable id, bytes compared inside a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import collapsed


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when their bytes are after white space is collapsed. Grouping is by the
    128-bit hash *and* the normalised text, so the aggregate itself compares bytes inside a hash
    group; copies meet in map-side partial aggregates first, whatever their number. Rows find
    their class by hash and digest, without their text; only classes with copies take part.

    Null and empty texts are equal and form one group. A null id never wins over another id; if
    a group has null ids only, all its rows are kept with a null ``keep_id``. Rows repeated under
    one id count each in ``group_size`` and share the fate of that id. Other columns are ignored.
    """
    flat = collapsed(F.col(text_col))
    texts = docs.select(F.col(id_col).alias("doc_id"), flat.alias("_text"))
    hashed = F.unhex(F.md5("_text"))
    classes = (
        texts.groupBy(hashed.alias("_hash"), "_text")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
        .select("_hash", F.unhex(F.sha2("_text", 256)).alias("_sha"), "keep_id", "group_size")
    )
    rows = texts.select("doc_id", hashed.alias("_hash"), F.unhex(F.sha2("_text", 256)).alias("_sha"))
    single = F.col("group_size").isNull()
    return rows.join(classes, ["_hash", "_sha"], "left").select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("_sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The rows to go are those with an equal text under a smaller id. The verdict travels by id;
    a row that is repeated under the same id stays as often as it is there.
    """
    lost = (
        exact_groups(docs, id_col, text_col)
        .filter("NOT kept AND doc_id IS NOT NULL")
        .select(F.col("doc_id").alias("_lost"), F.col("text_sha256").alias("_lost_sha"))
    )
    sha = F.sha2(collapsed(F.col(text_col)), 256)
    return docs.join(lost, (docs[id_col] == lost["_lost"]) & (sha == lost["_lost_sha"]), "left_anti")
