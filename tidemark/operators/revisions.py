"""One winning revision per key, the log of what lost and why, and upserts.

Ranking filters of the form ``row_number() <= k`` are cut down per map task before the
shuffle (Spark's window group limit), so a key holding a large share of all rows sends at
most ``k`` rows per task over the network. Joins back to all candidates go through the
winners, one row per key; adaptive execution splits a hot key there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: cells that a key's candidates are dealt over
SALTS = 64


def _ordered(kind: T.DataType) -> bool:
    """Maps and variants have no order."""
    return not any(word in kind.simpleString() for word in ("map<", "variant"))


@dataclass(frozen=True)
class RevisionColumns:
    """Names of the revision metadata; ``row`` is the position inside the snapshot file."""

    priority: str = "source_priority"
    collected_at: str = "collected_at"
    sha256: str = "source_file_sha256"
    path: str = "parsed_path"
    row: str = "parsed_row"

    def ties(self, df: DataFrame) -> list[str]:
        """Columns that decide between equal revisions: sha, path, row, then all others by name that have an order."""
        first = [c for c in (self.sha256, self.path, self.row) if c in df.columns]
        return first + sorted(f.name for f in df.schema if _ordered(f.dataType) and f.name not in {*first, self.priority, self.collected_at})

    def order(self, df: DataFrame) -> list[Column]:
        """Lowest priority number, latest collection (unknown last), then the ties; nulls last."""
        return [
            F.col(self.priority).asc_nulls_last(),
            F.col(self.collected_at).desc_nulls_last(),
            *[F.col(c).asc_nulls_last() for c in self.ties(df)],
        ]

    def rank_struct(self, df: DataFrame) -> Column:
        """The same order as one comparable value: smaller wins."""
        at = F.col(self.collected_at)
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        micros = F.timestamp_diff("MICROSECOND", epoch, at.cast("timestamp_ntz"))
        parts = [
            F.col(self.priority).isNull().alias("no_priority"),
            F.col(self.priority).alias("priority"),
            at.isNull().alias("no_time"),
            (-micros).alias("newest_first"),
        ]
        for c in self.ties(df):
            parts += [F.col(c).isNull().alias(f"no_{c}"), F.col(c).alias(f"tie_{c}")]
        return F.struct(*parts)


REVISION = RevisionColumns()


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def dedup_revisions(df: DataFrame, keys: Sequence[str], meta: RevisionColumns = REVISION) -> DataFrame:
    """One row per key: lowest priority number, then latest, then sha, then path."""
    return first_per_key(df, keys, meta.order(df))


def dedup_log(df: DataFrame, keys: Sequence[str], meta: RevisionColumns = REVISION, salts: int = SALTS) -> DataFrame:
    """Every candidate of each contested key with its role and the reason it lost.

    The order is that of ``dedup_revisions``, so the selected candidate is the row kept there.
    Of rows that are equal in every column one is selected and the others are dropped.
    A key's rows are dealt over ``salts`` cells by a hash of what orders them, so equal rows stay together
    and no task holds a hot key. Rows are ranked in their cell and do not move again: of each cell only its first row
    and its size are compared with the key's other cells, and the verdict comes back to the cell.
    """
    places = [meta.priority, meta.collected_at, *meta.ties(df)]
    salt = F.pmod(F.xxhash64(*places), F.lit(salts))
    dealt = df.withColumn("_cell", F.struct(*keys, salt.alias("_salt")))
    cell = Window.partitionBy("_cell")
    ranked = dealt.withColumns({"_n": F.count("*").over(cell), "_place": F.row_number().over(cell.orderBy(*meta.order(df)))})
    firsts = ranked.where("_place = 1").select("_cell", F.struct(*[f"_cell.{k}" for k in keys]).alias("_key"), meta.rank_struct(df).alias("_order"), "_n")
    whole = Window.partitionBy("_key")
    best = firsts.withColumns({"_best": F.min("_order").over(whole), "_all": F.sum("_n").over(whole)}).where("_all > 1")
    verdict = best.select(F.col("_cell").alias("_of"), (F.col("_order") == F.col("_best")).alias("_holds"), F.col("_best.priority").alias("_top"))
    joined = ranked.join(verdict, F.col("_cell") == F.col("_of"))
    selected = F.col("_holds") & (F.col("_place") == 1)
    return joined.select(
        *df.columns,
        F.when(selected, "selected").otherwise("dropped").alias("role"),
        F.when(selected, "").when(F.col(meta.priority) > F.col("_top"), "lower_priority").otherwise("older_revision").alias("reason"),
    )


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given explicit order."""
    return first_per_key(df, keys, [F.col(c).desc_nulls_last() for c in order])


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The best ``k`` rows of each group with their rank."""
    if k < 1:
        raise ValueError("k must be at least 1")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def best_row(df: DataFrame, by: str, lower_is_better: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """The single best row by a metric; rows without it never win."""
    first = F.col(by).asc() if lower_is_better else F.col(by).desc()
    return df.where(F.col(by).isNotNull()).orderBy(first, *[F.col(c) for c in ties]).limit(1)


def upsert(target: DataFrame, incoming: DataFrame, keys: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``target`` whose key does not occur in ``incoming``, plus all of ``incoming``.

    An empty ``incoming`` leaves the target as it is. A null in a key matches nothing, or with
    ``null_safe`` another null.
    """
    touched = incoming.select(*[F.col(k).alias(f"_in_{k}") for k in keys]).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_in_{k}")) if null_safe else F.col(k) == F.col(f"_in_{k}") for k in keys]
    return target.join(touched, same, "left_anti").unionByName(incoming)
