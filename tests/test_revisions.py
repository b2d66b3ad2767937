from datetime import datetime

from pyspark.sql import functions as F

from tidemark.operators.revisions import dedup_log, dedup_revisions, keep_last, upsert

SCHEMA = (
    "k string, v double, source_priority int, collected_at timestamp_ntz, source_file_sha256 string, "
    "parsed_path string, parsed_row bigint"
)
AT = datetime(2024, 1, 1, 0, 0, 0, 1)
LATER = datetime(2024, 1, 1, 0, 0, 0, 2)


def winners(rows, df):
    return dict((r[0], r[1]) for r in rows(dedup_revisions(df, ["k"]).select("k", "v")))


def test_order_of_rules(spark, rows):
    df = spark.createDataFrame(
        [
            ("priority", 1.0, 1, AT, "b", "p", 0), ("priority", 2.0, 2, LATER, "a", "p", 1),
            ("newer", 1.0, 1, AT, "a", "p", 2), ("newer", 2.0, 1, LATER, "b", "p", 3),
            ("unknown_time", 1.0, 1, None, "a", "p", 4), ("unknown_time", 2.0, 1, AT, "b", "p", 5),
            ("sha", 1.0, 1, AT, "a", "q", 6), ("sha", 2.0, 1, AT, "b", "p", 7),
            ("path", 1.0, 1, AT, "a", "a", 8), ("path", 2.0, 1, AT, "a", "b", 9),
            ("row", 1.0, 1, AT, "a", "a", 10), ("row", 2.0, 1, AT, "a", "a", 11),
        ],
        SCHEMA,
    )
    expected = {"priority": 1.0, "newer": 2.0, "unknown_time": 2.0, "sha": 1.0, "path": 1.0, "row": 1.0}
    assert winners(rows, df) == expected
    log = dedup_log(df, ["k"])
    chosen = dict((r[0], r[1]) for r in rows(log.where("role = 'selected'").select("k", "v")))
    assert chosen == expected
    reasons = dict((r[0], r[1]) for r in rows(log.where("role = 'dropped'").select("k", "reason")))
    assert reasons == {k: "lower_priority" if k == "priority" else "older_revision" for k in expected}


def test_uncontested_keys_are_not_logged(spark):
    df = spark.createDataFrame([("a", 1.0, 1, AT, "a", "p", 0)], SCHEMA)
    assert dedup_log(df, ["k"]).isEmpty()


def test_equal_copies_have_exactly_one_winner_and_all_are_logged(spark, rows):
    copies = spark.range(3000).select(
        F.lit("hot").alias("k"), F.lit(1.0).alias("v"), F.lit(1).alias("source_priority"),
        F.lit(AT).cast("timestamp_ntz").alias("collected_at"), F.lit("s").alias("source_file_sha256"),
        F.lit("p").alias("parsed_path"), F.col("id").alias("parsed_row"),
    )
    roles = rows(dedup_log(copies, ["k"]).groupBy("role").count(), "role")
    assert roles == [("dropped", 2999), ("selected", 1)]
    assert dedup_revisions(copies, ["k"]).count() == 1


def test_a_hot_key_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([("a", 1.0, 1, AT, "a", "p", 0)], SCHEMA)
    plan = dedup_revisions(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_null_keys_are_one_key(spark, rows):
    df = spark.createDataFrame(
        [(None, 1.0, 1, AT, "a", "p", 0), (None, 2.0, 1, LATER, "b", "p", 1)], SCHEMA
    )
    assert dedup_log(df, ["k"]).count() == 2
    assert rows(dedup_revisions(df, ["k"]).select("v")) == [(2.0,)]


def test_keep_last_and_upsert(spark, rows):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, o int, v double")
    assert rows(keep_last(df, ["k"], ["o"]), "k") == [("a", 2, 2.0), ("b", 1, 3.0)]
    target = df.select("k", "v")
    incoming = spark.createDataFrame([("a", 9.0), ("c", 8.0)], "k string, v double")
    assert rows(upsert(target, incoming, ["k"]), "k") == [("a", 9.0), ("b", 3.0), ("c", 8.0)]
    assert upsert(target, incoming.limit(0), ["k"]).count() == 3


def test_log_selects_the_row_that_is_kept(spark):
    schema = "k int, price double, source_priority int, collected_at timestamp_ntz, source_file_sha256 string, parsed_path string"
    rows = [
        (1, 1.0, 1, None, None, "b"), (1, 2.0, 1, None, "s", "a"),  # null sha loses
        (2, 5.0, 1, None, "s", None), (2, 5.0, 1, None, "s", None),  # exact copies
        (3, 7.0, 2, None, "s", None), (3, 8.0, 2, None, "s", "p"),  # null path loses
        (4, 9.0, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    kept = {r["k"]: r["price"] for r in dedup_revisions(df, ["k"]).collect()}
    log = dedup_log(df, ["k"]).collect()
    chosen = [(r["k"], r["price"]) for r in log if r["role"] == "selected"]
    assert sorted(chosen) == [(1, kept[1]), (2, kept[2]), (3, kept[3])] and len(log) == 6
    assert kept == {1: 2.0, 2: 5.0, 3: 8.0, 4: 9.0}


def test_log_moves_whole_rows_once_and_takes_map_columns(spark, rows):
    df = spark.range(5000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 700).cast("string"))).alias("k"),
        (F.col("id") % 11).cast("double").alias("v"), (F.col("id") % 2).cast("int").alias("source_priority"),
        F.lit(AT).cast("timestamp_ntz").alias("collected_at"), (F.col("id") % 5).cast("string").alias("source_file_sha256"),
        F.lit("p").alias("parsed_path"), F.lit(None).cast("bigint").alias("parsed_row"), F.create_map(F.lit("a"), F.col("id")).alias("extra"),
    )
    log = dedup_log(df, ["k"])
    plain = df.drop("extra")
    want = sorted((r[0], r[1]) for r in dedup_revisions(plain, ["k"]).select("k", "v").collect())
    assert sorted((r[0], r[1]) for r in log.where("role = 'selected'").select("k", "v").collect()) == want
    assert log.count() == 5000
    by_reason = dict(log.groupBy("reason").count().collect())
    assert by_reason[""] == len(want) and by_reason["lower_priority"] > 0 and by_reason["older_revision"] > 0
