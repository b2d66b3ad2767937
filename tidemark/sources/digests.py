"""Fingerprints of files of any size, read as streams where they lie."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes of a file that a task holds at a time
STREAM_BYTES = 1 << 22
#: tasks that the files are dealt over at most
TASKS = 20_000


def open_file(path: str) -> pa.NativeFile:
    """A file as a stream; paths are as Spark writes them, with characters unescaped."""
    scheme, found, rest = path.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem().open_input_stream(path)
    if scheme == "file":
        return fs.LocalFileSystem().open_input_stream("/" + rest.lstrip("/"))
    authority = rest.lstrip("/").split("/", 1)[0]
    store, base = fs.FileSystem.from_uri(f"{scheme}://{authority}/")
    inside = rest.lstrip("/").split("/", 1)[-1]
    return store.open_input_stream(f"{base.rstrip('/')}/{inside}" if base.strip("/") else f"/{inside}")


def stream_digest(path: str, step: int = STREAM_BYTES) -> tuple[int, str]:
    """Length and sha256 of a file."""
    digest, size = hashlib.sha256(), 0
    with open_file(path) as stream:
        while block := stream.read(step):
            digest.update(block)
            size += len(block)
    return size, digest.hexdigest()


def reachable(path: str) -> bool:
    """Whether tasks can open files of this store themselves."""
    try:
        open_file(path).close()
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    except OSError:
        return not path.partition(":")[0].lower().startswith(("viewfs", "hdfs", "abfs"))
    return True


def list_files(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """``path, file_name, bytes`` of the files below a folder with one of the suffixes; no content is read.

    Spark lists no empty files.
    """
    allowed = "(?i)\\.(" + "|".join(suffixes) + ")$"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return found.where(F.col("path").rlike(allowed)).select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("bytes")
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size, sha = stream_digest(row["path"])
            if size != row["bytes"]:
                raise OSError(f"{row['path']} changed while it was read: {row['bytes']} bytes, then {size}")
            yield pa.RecordBatch.from_pylist([{**row, "sha256": sha}])


def file_fingerprints(spark: SparkSession, path: str, suffixes: Sequence[str] = ("csv", "tsv", "json", "xml")) -> DataFrame:
    """Files with an allowed suffix, their size and the sha256 of their bytes.

    Files are dealt over the tasks by their path and each is read once, as a stream of a few MB at a time: memory does not
    depend on their size, and a file of any length is one row without its content. A file that changes meanwhile
    is an error. Stores that only Spark's own readers open are read by those, a file of up to 2 GB at a time.
    """
    listed = list_files(spark, path, suffixes)
    some, files = listed.agg(F.first("path"), F.count(F.lit(1))).first()
    if some is None or reachable(some):
        # a number of tasks that stays: by their own size the rows would all be put into one
        dealt = listed.repartition(max(1, min(files, TASKS)), "path")
        return dealt.mapInArrow(_digests, "path string, file_name string, bytes long, sha256 string")
    whole = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    digests = whole.select("path", F.sha2("content", 256).alias("sha256"))
    return listed.join(digests, "path").select("path", "file_name", "bytes", "sha256")
