"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, word_count

DIMS = ("_bytes", "_tokens", "_rows")
#: weight of each dimension in the dot product; bytes lead, so that a group of many short copies
#: does not leave its shard short of bytes
EMPHASIS = (1.0, 0.1, 0.1)
#: a group above this share of the whole in some dimension is placed first; there are at most 3 * LARGE of them
LARGE = 1024
#: groups in a cell, and rows that share a run of slots, on average
CELL = 2000


def place(items: np.ndarray, residual: np.ndarray, capacity: np.ndarray) -> np.ndarray:
    """The shard of each item (n x d), largest first, where the dot product with what is left is highest.

    Demand and residual are measured against ``capacity`` (one vector for all shards), so that
    the dimensions are comparable. ``residual`` (shards x d) is used up in place.
    """
    scale = np.sqrt(EMPHASIS) / np.maximum(capacity, 1e-12)
    demand = items * scale
    left = residual * scale
    where = np.zeros(len(items), dtype=np.int32)
    for i in np.argsort(-demand.max(axis=1, initial=0.0), kind="stable"):
        best = int(np.argmax(left @ demand[i]))
        left[best] -= demand[i]
        where[i] = best
    residual[:] = left / scale
    return where


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, size, text_crc32, shard, slot``.

    Equal texts form a group and share a shard, unless the group alone is larger than a shard's
    fair part: then it is cut into pieces by a hash of the id. Groups that matter for the whole
    (at most ``3 * LARGE``, by counting) are placed by one greedy pass on the driver. All
    others are dealt by hash into cells of about ``CELL`` groups; every cell runs the same greedy
    pass against its proportional part of what the large groups left in each shard, so cells are
    independent tasks and their balance adds up. Slots are runs per (shard, hash of the id).

    A null text has size 1 (no bytes, plus 1) and is equal to an empty one. A null id is allowed.
    Repeated rows are one group; an empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        word_count(text).alias("tokens"),
        F.crc32(text).alias("text_crc32"),
        F.unhex(F.md5(text)).alias("_hash"),
    )
    rows = materialise(rows, "shard-rows")
    whole = rows.agg(F.count(F.lit(1)), F.sum("size"), F.sum("tokens")).first()
    n = whole[0]
    total = np.array([whole[1] or 0, whole[2] or 0, n], dtype=float)
    fair = np.maximum(total / shards, 1.0)

    sums = [F.sum("size").alias("_bytes"), F.sum("tokens").alias("_tokens"), F.count(F.lit(1)).alias("_rows")]
    groups = rows.groupBy("_hash").agg(*sums)
    # groups beyond a fair part: fewer than 3 * shards by counting, so this table is bounded
    excess = F.greatest(*[F.col(d) / F.lit(float(f)) for d, f in zip(DIMS, fair)])
    oversize = groups.filter(excess > 1).select("_hash", F.ceil(excess * 4).cast("long").alias("_pieces"))
    piece = F.when(F.col("_pieces").isNotNull(), F.pmod(F.xxhash64("doc_id", F.lit(7)), F.col("_pieces"))).otherwise(0)
    rows = rows.join(F.broadcast(oversize), "_hash", "left").withColumn("_piece", piece.cast("long")).drop("_pieces")
    units = materialise(rows.groupBy("_hash", "_piece").agg(*sums), "shard-units")

    weigh = F.greatest(*[F.col(d) / F.lit(float(max(t, 1.0))) for d, t in zip(DIMS, total)])
    big = units.filter(weigh > 1.0 / LARGE).orderBy("_hash", "_piece").toPandas()
    residual = np.tile(total / shards, (shards, 1))
    chosen = place(big[list(DIMS)].to_numpy(dtype=float).reshape(-1, 3), residual, fair)
    big_total = big[list(DIMS)].to_numpy(dtype=float).reshape(-1, 3).sum(axis=0)
    session = docs.sparkSession
    placed_big = session.createDataFrame(
        [(bytes(h), int(p), int(s)) for h, p, s in zip(big["_hash"], big["_piece"], chosen)],
        "_hash binary, _piece long, shard int",
    )
    small_total = np.maximum(total - big_total, 1.0)
    left = np.maximum(residual, 0.0)
    left *= small_total / np.maximum(left.sum(axis=0), 1e-12)

    def pack(key: tuple, cell: pd.DataFrame) -> pd.DataFrame:
        cell = cell.sort_values(["_hash", "_piece"])
        items = cell[list(DIMS)].to_numpy(dtype=float)
        part = left * (items.sum(axis=0) / small_total)
        out = cell[["_hash", "_piece"]].copy()
        # every cell numbers the shards from another start, so that what cannot be split evenly spreads
        turn = np.roll(np.arange(shards), int(key[0]) % shards)
        out["shard"] = turn[place(items, part[turn].copy(), np.maximum(part.mean(axis=0), 1e-9))].astype(np.int32)
        return out

    cells = max(1, -(-int(n) // CELL))
    small = units.filter(weigh <= 1.0 / LARGE).withColumn("_cell", F.pmod(F.xxhash64("_hash", F.lit(3)), F.lit(cells)))
    placed = small.groupBy("_cell").applyInPandas(pack, "_hash binary, _piece long, shard int").unionByName(placed_big)

    runs = max(1, -(-int(n) // (shards * CELL)))
    dealt = rows.join(placed, ["_hash", "_piece"]).withColumn("_run", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(runs)))
    dealt = materialise(dealt.select("doc_id", "size", "text_crc32", "shard", "_run"), "shard-dealt")
    counts = dealt.groupBy("shard", "_run").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "_run", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("doc_id", "size", "text_crc32"))
    return dealt.withColumn("_in", inside - 1).join(starts, ["shard", "_run"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_start") + F.col("_in")).cast("long").alias("slot")
    )


def shard_loads(assigned: DataFrame) -> DataFrame:
    """Rows and bytes of each shard, for reports and tests."""
    return assigned.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("bytes"))

