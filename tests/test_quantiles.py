import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles, medians

PROBS = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [20, 100, 900, 10_000])
def test_equal_to_numpy_with_skew_and_outliers(spark, accuracy):
    rng = np.random.default_rng(3)
    data = {
        "flat": rng.normal(size=4001), "hot": np.round(rng.exponential(size=6000), 1),
        "far": np.append(rng.normal(size=999), 1e12), "one": np.array([5.0]), "same": np.full(50, 2.5),
    }
    rows = [(k, float(x)) for k, xs in data.items() for x in xs] + [("flat", None), ("empty", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {(r[0], r[1]): r[2] for r in exact_quantiles(df, ["g"], "v", PROBS, accuracy).collect()}
    assert {g for g, _ in got} == set(data)
    for g, xs in data.items():
        for q in PROBS:
            assert got[g, q] == pytest.approx(np.percentile(xs, q * 100), rel=1e-12, abs=1e-12)


def test_without_groups_and_medians(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), (F.col("id") * 2).alias("b"))
    assert [tuple(r) for r in exact_quantiles(df, [], "a", [0.5]).collect()] == [(0.5, 4.5)]
    assert {r[0]: r[1] for r in medians(df, [], ["a", "b"]).collect()} == {"a": 4.5, "b": 9.0}


def test_null_keys_are_a_group_and_repeated_probabilities_are_one(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0), ("a", 7.0)], "g string, v double")
    assert sorted(map(str, exact_quantiles(df, ["g"], "v", [0.5, 0.5]).collect())) == sorted(
        ["Row(g=None, prob=0.5, quantile=1.5)", "Row(g='a', prob=0.5, quantile=7.0)"]
    )


def test_only_brackets_of_a_large_group_are_ordered(spark):
    df = spark.range(400_000, numPartitions=8).select(F.xxhash64("id").cast("double").alias("v"))
    got = exact_quantiles(df, [], "v", [0.5, 0.9]).collect()
    values = np.sort(np.array([r[0] for r in df.collect()]))
    assert {r[0]: r[1] for r in got} == {p: pytest.approx(np.percentile(values, p * 100), rel=1e-14) for p in (0.5, 0.9)}
