from datetime import date

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scores as sc
from tidemark.operators import splits as sp


def frame(spark, pairs):
    return spark.createDataFrame(
        [("m", i, None if y is None else float(y), None if p is None else float(p)) for i, (y, p) in enumerate(pairs)],
        "model string, t int, y_true double, y_pred double",
    )


def test_metrics_by_hand(spark):
    df = frame(spark, [(10, 12), (20, 18), (0, 1), (None, 3), (5, None)])
    row = sc.all_metrics(df, ["model"], [], "t").collect()[0]
    assert (row.n, row.mae) == (3, pytest.approx(5 / 3))
    assert row.rmse == pytest.approx(3.0**0.5)
    assert row.mape == pytest.approx(15.0)
    assert row.r2 == pytest.approx(1 - 9 / 200)
    assert row.directional_accuracy == 1.0
    assert row.peak_threshold == pytest.approx(18.0)
    assert (row.peak_precision, row.peak_recall, row.peak_f1) == (1.0, 1.0, 1.0)


def test_degenerate_metrics_are_null(spark):
    row = sc.all_metrics(frame(spark, [(0, 0)]), ["model"], [], "t").collect()[0]
    assert row.r2 is None and row.mape is None and row.smape is None and row.directional_accuracy is None
    with pytest.raises(ValueError):
        sc.regression_metrics(frame(spark, [(None, 1)]), ["model"], check=True)


def test_percent_error_floor(spark):
    row = sc.rmse_mape(frame(spark, [(0, 1e-8)]), ["model"]).collect()[0]
    assert row["mape"] == pytest.approx(100.0)


def test_the_two_direction_rules_differ(spark):
    df = frame(spark, [(8, 10), (12, 10)]).withColumn("o", F.lit(10.0))
    strict = sc.delta_metrics(df, ["model"], "o").collect()[0]
    loose = sc.residual_summary(df, ["model"], "o").collect()[0]
    assert strict.delta_direction_accuracy == 0.0
    assert loose.delta_direction_accuracy == 0.5


def series(spark, n, group="a"):
    return spark.range(n).select(
        F.lit(group).alias("area"), F.expr("add_months(date'2010-01-01', cast(id as int))").alias("period_month"),
        F.col("id").cast("double").alias("target"),
    )


def test_fold_sizes(spark, rows):
    folds = sp.ts_folds(series(spark, 182), ["area"], "period_month", 5, 1)
    sizes = rows(folds.groupBy("fold").agg(F.count_if(F.col("role") == "train"), F.count_if(F.col("role") == "valid")), "fold")
    assert sizes == [(1, 31, 30), (2, 61, 30), (3, 91, 30), (4, 121, 30), (5, 151, 30)]
    gap = folds.where("role = 'train'").groupBy("fold").agg(F.max("period_month").alias("t")).join(
        folds.where("role = 'valid'").groupBy("fold").agg(F.min("period_month").alias("v")), "fold"
    )
    assert all(r[0] == 2.0 for r in rows(gap.select(F.months_between("v", "t"))))


def test_folds_without_training_rows_take_no_number(spark, rows):
    folds = sp.ts_folds(series(spark, 6), ["area"], "period_month", 5, 2)
    assert rows(folds.select("fold").distinct(), "fold") == [(1,), (2,), (3,)]
    with pytest.raises(ValueError):
        sp.ts_folds(series(spark, 6), ["area"], "period_month", 1)


def test_chronological_split(spark, rows):
    out = sp.split_chronological(series(spark, 100), ["area"], "period_month")
    assert rows(out.groupBy("split").count(), "split") == [("test", 15), ("train", 70), ("valid", 15)]
    with pytest.raises(Exception, match="too small"):
        sp.split_chronological(series(spark, 10), ["area"], "period_month").collect()


def test_no_label_after_the_cutoff_is_trained_on(spark):
    v = sp.Version("v", "2012-01-01", "2012-01-01", "2012-02-01", "2012-06-01")
    cells = sp.fixed_holdout(series(spark, 60), [v], 1)
    assert cells.where("role = 'train'").agg(F.max("period_month")).collect()[0][0] == date(2011, 12, 1)
    assert cells.where("role = 'test'").count() == 5
    rolling = sp.rolling_validation(series(spark, 60), "2012-06-01", 3, 1)
    ahead = rolling.where("role = 'train' AND add_months(period_month, 1) >= eval_month")
    assert ahead.isEmpty()
    months = sorted(r[0] for r in rolling.where("role = 'test'").select("eval_month").collect())
    assert months == [date(2012, 3, 1), date(2012, 4, 1), date(2012, 5, 1)]


def test_inner_validation_is_the_tail_of_training(spark, rows):
    folds = sp.ts_folds(series(spark, 182), ["area"], "period_month")
    inner = sp.inner_validation(folds, ["area"], "period_month")
    counts = rows(inner.groupBy("fold").agg(F.count_if("is_inner"), F.count("*")), "fold")
    assert counts == [(1, 5, 31), (2, 10, 61), (3, 14, 91), (4, 19, 121), (5, 23, 151)]
