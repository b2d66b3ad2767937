"""Set operations: results, nulls, and what a task has to hold."""

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.operators import sets as s


def frame(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k int")


def test_keys_of_both_and_of_one_side_are_told_once_with_nulls_equal(spark, rows):
    a, b = frame(spark, 1, 1, 2, 3, None, None), frame(spark, 2, 2, 4)
    assert rows(s.except_keys(a, b), "k") == [(None,), (1,), (3,)]
    assert rows(s.intersect_keys(a, b), "k") == [(2,)]
    assert rows(s.except_keys(a, frame(spark, None, 3)), "k") == [(1,), (2,)]
    assert rows(s.intersect_keys(a, frame(spark, None, 3)), "k") == [(None,), (3,)]
    assert rows(s.except_keys(a, a)) == [] and rows(s.intersect_keys(a, a), "k") == [(None,), (1,), (2,), (3,)]
    assert s.except_keys(a, b.withColumnRenamed("k", "other")).columns == ["k"]


def test_a_null_key_of_the_base_is_always_missing(spark, rows):
    assert rows(j.missing_keys(frame(spark, 1, None, 2, 2), frame(spark, None, 2), ["k"]), "k") == [(None,), (1,)]


def test_no_side_meets_the_other_with_all_its_rows(spark):
    a, b = (spark.range(n).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")) for n in (1000, 2000))
    left, right = a.select("k"), b.select("k")
    for df in (s.except_keys(left, right), s.intersect_keys(left, right), j.common_keys(a, b, ["k"]), j.missing_keys(a, b, ["k"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "Broadcast" not in plan
