"""Committed upserts: all or nothing, replays, untouched buckets, other writers."""

import pytest
from pyspark.sql import functions as F

from tidemark.session import scratch_path
from tidemark.sources import tables as t

SCHEMA = "k bigint, part string, v double"


@pytest.fixture()
def root(spark):
    path = scratch_path(spark, "table")
    t.create_table(spark, path, spark.createDataFrame([], SCHEMA).schema, ["k", "part"], buckets=8)
    return path


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(spark, root, version=None):
    return sorted(((r.k, r.part, r.v) for r in t.read_table(spark, root, version).collect()), key=str)


def test_rows_are_replaced_and_added(spark, root):
    assert content(spark, root) == []
    t.upsert_table(frame(spark, [(i, "a", 1.0) for i in range(40)]), root)
    t.upsert_table(frame(spark, [(3, "a", 2.0), (3, "b", 3.0), (99, "a", 4.0)]), root)
    want = [(i, "a", 2.0 if i == 3 else 1.0) for i in range(40)] + [(3, "b", 3.0), (99, "a", 4.0)]
    assert content(spark, root) == sorted(want, key=str)
    assert content(spark, root, 1) == sorted([(i, "a", 1.0) for i in range(40)], key=str)


def test_untouched_buckets_keep_their_files(spark, root):
    before = t.upsert_table(frame(spark, [(i, "a", 1.0) for i in range(100)]), root)
    after = t.upsert_table(frame(spark, [(5, "a", 9.0)]), root)
    changed = [b for b in after.data if after.data[b] != before.data[b]]
    assert len(changed) == 1 and len(after.data) == 8
    assert t.upsert_table(frame(spark, []), root).version == after.version


def test_a_crash_before_the_switch_changes_nothing(spark, root, monkeypatch):
    t.upsert_table(frame(spark, [(1, "a", 1.0), (2, "a", 1.0)]), root)
    publish = t._publish

    def crash(*_):
        raise OSError("lost")

    monkeypatch.setattr(t, "_publish", crash)
    with pytest.raises(OSError):
        t.upsert_table(frame(spark, [(1, "a", 7.0), (3, "a", 7.0)]), root)
    assert content(spark, root) == [(1, "a", 1.0), (2, "a", 1.0)]
    monkeypatch.setattr(t, "_publish", publish)
    t.upsert_table(frame(spark, [(1, "a", 7.0), (3, "a", 7.0)]), root)
    assert content(spark, root) == [(1, "a", 7.0), (2, "a", 1.0), (3, "a", 7.0)]
    assert t.expire(spark, root, keep=1) >= 1
    assert content(spark, root) == [(1, "a", 7.0), (2, "a", 1.0), (3, "a", 7.0)] and len(t.versions(spark, root)) == 1


def test_a_batch_counts_once(spark, root):
    t.upsert_table(frame(spark, [(1, "a", 1.0)]), root, ("loader", 0))
    t.upsert_table(frame(spark, [(1, "a", 2.0)]), root, ("loader", 1))
    replayed = t.upsert_table(frame(spark, [(1, "a", 1.0)]), root, ("loader", 0))
    assert replayed.version == 2 and content(spark, root) == [(1, "a", 2.0)]
    t.upsert_table(frame(spark, [(1, "a", 5.0)]), root, ("other", 0))
    assert content(spark, root) == [(1, "a", 5.0)]


def test_the_second_of_two_writers_is_told(spark, root, monkeypatch):
    read = t.read_manifest
    stale = read(spark, root)
    t.upsert_table(frame(spark, [(1, "a", 1.0)]), root)
    monkeypatch.setattr(t, "read_manifest", lambda *a, **k: stale)
    with pytest.raises(t.ConflictError):
        t.upsert_table(frame(spark, [(2, "a", 2.0)]), root)
    monkeypatch.setattr(t, "read_manifest", read)
    assert content(spark, root) == [(1, "a", 1.0)]


def test_null_keys_and_types(spark, root):
    t.upsert_table(frame(spark, [(None, "a", 1.0), (1, None, 1.0)]), root)
    t.upsert_table(frame(spark, [(None, "a", 2.0)]).withColumn("v", F.col("v").cast("int")), root)
    assert content(spark, root) == sorted([(None, "a", 1.0), (None, "a", 2.0), (1, None, 1.0)], key=str)
    with pytest.raises(ValueError):
        t.create_table(spark, root + "x", frame(spark, []).schema, ["nope"])
    with pytest.raises(FileNotFoundError):
        t.read_table(spark, root + "y")
