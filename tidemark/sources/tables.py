"""Keyed tables in a folder, changed by committed upserts.

Rows lie in a fixed number of buckets by a hash of their key. An upsert writes the buckets that it touches
anew, beside the old files, and then publishes a manifest that says where each bucket is. Readers follow the newest
manifest, so they see all of an upsert or nothing; what a crashed run wrote is never looked at.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.revisions import upsert

BUCKETS = 64
_BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Another writer published a version in the meantime; the change can be tried again on top of it."""


@dataclass
class Manifest:
    """State of a table: where each bucket's rows are, and the last batch of each writer."""

    version: int
    keys: list[str]
    buckets: int
    schema: str
    data: dict[str, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def of(self, keys: Sequence[str]) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")


class _Files:
    """The few calls on the table's file system that no reader or writer of Spark offers."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.at = self.jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def names(self, path: str) -> list[str]:
        where = self.at(path)
        return [s.getPath().getName() for s in self.fs.listStatus(where)] if self.fs.exists(where) else []

    def read(self, path: str) -> str:
        with_lines = self.jvm.org.apache.commons.io.IOUtils
        stream = self.fs.open(self.at(path))
        try:
            return with_lines.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        stream = self.fs.create(self.at(path), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def move(self, source: str, target: str) -> bool:
        """False where the target is there already."""
        return not self.fs.exists(self.at(target)) and self.fs.rename(self.at(source), self.at(target))

    def remove(self, path: str) -> None:
        self.fs.delete(self.at(path), True)


def _manifest_path(root: str, version: int) -> str:
    return f"{root}/manifest/{version:012d}.json"


def versions(spark: SparkSession, root: str) -> list[int]:
    names = _Files(spark, root).names(f"{root}/manifest")
    return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())


def read_manifest(spark: SparkSession, root: str, version: int | None = None) -> Manifest:
    """The newest state, or that of a version."""
    if version is None:
        found = versions(spark, root)
        if not found:
            raise FileNotFoundError(f"no table at {root}")
        version = found[-1]
    return Manifest(**json.loads(_Files(spark, root).read(_manifest_path(root, version))))


def _publish(spark: SparkSession, root: str, manifest: Manifest) -> None:
    """Make a version the newest one: a rename, which the file system does wholly or not at all."""
    files, staged = _Files(spark, root), f"{root}/manifest/_{uuid.uuid4().hex}"
    files.write(staged, json.dumps(asdict(manifest)))
    if not files.move(staged, _manifest_path(root, manifest.version)):
        files.remove(staged)
        raise ConflictError(f"version {manifest.version} of {root} is taken")


def create_table(spark: SparkSession, root: str, schema: T.StructType, keys: Sequence[str], buckets: int = BUCKETS) -> Manifest:
    """An empty table; the number of buckets stays, so choose it for some hundred MB a bucket at full size."""
    missing = [k for k in keys if k not in schema.names]
    if missing or _BUCKET in schema.names:
        raise ValueError(f"keys not in the schema: {missing}" if missing else f"{_BUCKET} is reserved")
    first = Manifest(0, list(keys), buckets, schema.json())
    _publish(spark, root, first)
    return first


def _rows(spark: SparkSession, root: str, manifest: Manifest, buckets: Sequence[str] | None = None) -> DataFrame:
    chosen = manifest.data if buckets is None else [b for b in buckets if b in manifest.data]
    schema = T.StructType.fromJson(json.loads(manifest.schema))
    paths = [f"{root}/{manifest.data[b]}" for b in chosen]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All rows of the newest version, or of an older one that has not been expired."""
    return _rows(spark, root, read_manifest(spark, root, version))


def upsert_table(
    incoming: DataFrame, root: str, batch: tuple[str, int] | None = None, null_safe: bool = False
) -> Manifest:
    """Replace the rows whose key occurs in ``incoming`` and add all rows of ``incoming``.

    Only buckets with a key of ``incoming`` are read and written; all others keep their files. With ``batch``,
    the writer's name and its rising number, a batch that is already in the table is left out. Until the
    manifest is published nothing has changed; if another writer was first, ``ConflictError`` is raised.
    Null keys match nothing, so such rows are only added, or with ``null_safe`` match each other.
    """
    spark = incoming.sparkSession
    now = read_manifest(spark, root)
    if batch and now.batches.get(batch[0], -1) >= batch[1]:
        return now
    schema = T.StructType.fromJson(json.loads(now.schema))
    fresh = incoming.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    # at most one row per bucket of the table
    touched = sorted(str(r[0]) for r in fresh.select(now.of(now.keys)).distinct().collect())
    if not touched:
        return now
    merged = upsert(_rows(spark, root, now, touched), fresh, now.keys, null_safe)
    folder = f"data/{now.version + 1:012d}-{uuid.uuid4().hex}"
    merged.withColumn(_BUCKET, now.of(now.keys)).repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{root}/{folder}")
    data = {**now.data, **{b: f"{folder}/{_BUCKET}={b}" for b in touched}}
    batches = {**now.batches, **({batch[0]: batch[1]} if batch else {})}
    after = Manifest(now.version + 1, now.keys, now.buckets, now.schema, data, batches)
    _publish(spark, root, after)
    return after


def expire(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Forget all but the newest ``keep`` versions and remove what only they or crashed runs wrote.

    Not to be run beside a writer, whose files no manifest names yet. Returns the number of folders removed.
    """
    files, known = _Files(spark, root), versions(spark, root)
    for old in known[:-keep] if keep else []:
        files.remove(_manifest_path(root, old))
    used = {p.split("/")[1] for v in known[-keep:] for p in read_manifest(spark, root, v).data.values()}
    unused = [n for n in files.names(f"{root}/data") if n not in used]
    for name in unused:
        files.remove(f"{root}/data/{name}")
    return len(unused)
