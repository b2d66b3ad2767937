"""The current view against a batch pick of winners, after every micro-batch and through failures."""

import random

import pytest

from tidemark.operators.revisions import dedup_revisions
from tidemark.session import scratch_path
from tidemark.sources import tables
from tidemark.streaming.current import current_view, follow_revisions, winners

SCHEMA = "area string, month int, price double, source_priority int, collected_at timestamp_ntz, source_file_sha256 string, parsed_path string"
KEYS = ["area", "month"]


def snapshots(spark, seed, n):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice(["a", "b", None]), rng.randrange(6), rng.choice([None, 1.0, 2.0, 3.0]), rng.choice([1, 2, None]),
            rng.choice([None, *[f"2024-01-0{k} 10:00:00" for k in range(1, 5)]]), rng.choice("xyz"), rng.choice(["p", "q", None]),
        )
        for _ in range(n)
    ]
    raw = spark.createDataFrame(rows, SCHEMA.replace("timestamp_ntz", "string"))
    return raw.selectExpr("area", "month", "price", "source_priority", "CAST(collected_at AS timestamp_ntz) AS collected_at", "source_file_sha256", "parsed_path")


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_winners_equal_the_ranked_pick(spark):
    df = snapshots(spark, 1, 400)
    assert plain(winners(df, KEYS)) == plain(dedup_revisions(df, KEYS))


def test_view_follows_each_batch_and_a_failed_one(spark, monkeypatch):
    inbox, table, state = (scratch_path(spark, n) for n in ("in", "current", "state"))
    seen = None
    commit = tables.upsert_table
    for i in range(4):
        part = snapshots(spark, 10 + i, 60)
        part.coalesce(1).write.mode("append").parquet(inbox)
        seen = part if seen is None else seen.unionByName(part)
        if i == 2:
            # lost between the state's update and the commit: the batch is run again by the next start
            monkeypatch.setattr(tables, "upsert_table", lambda *_, **__: (_ for _ in ()).throw(OSError("lost")))
            with pytest.raises(Exception):
                follow_revisions(spark, inbox, part.schema, KEYS, table, state, buckets=4).awaitTermination()
            monkeypatch.setattr(tables, "upsert_table", commit)
        follow_revisions(spark, inbox, part.schema, KEYS, table, state, buckets=4).awaitTermination()
        assert plain(current_view(spark, table)) == plain(dedup_revisions(seen, KEYS))
    assert tables.read_manifest(spark, table).batches == {"revisions": 3}
