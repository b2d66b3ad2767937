import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models as m


def closed_form(x, y, alpha=1.0):
    mean, std = x.mean(axis=0), x.std(axis=0)
    std = np.where(std == 0, 1.0, std)
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean())) / std
    return np.concatenate([[y.mean() - w @ mean], w])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3)) * [1.0, 10.0, 0.1] + [5.0, -20.0, 0.0]
    y = x @ [2.0, -0.5, 30.0] + rng.normal(size=300)
    group = np.where(np.arange(300) % 3 == 0, "a", "b")
    rows = [(str(g), *map(float, r), 4.0, float(t)) for g, r, t in zip(group, x, y)]
    return x, y, group, spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, c double, y double")


COLUMNS = ["x0", "x1", "x2", "c"]


def test_grouped_ridge_equals_closed_form(data):
    x, y, group, df = data
    spec = m.Ridge(("x0", "x1", "x2"))
    fitted = m.ridge_from_stats(m.gram_stats(df, ["g"], [*COLUMNS, "y"]), {"r": spec}, COLUMNS, "y")
    for g, coef in fitted.select("g", "coef_r").collect():
        assert np.allclose(coef, closed_form(x[group == g], y[group == g]), rtol=1e-9, atol=1e-9)


def test_constant_feature_gets_no_slope(data):
    x, y, _, df = data
    fitted = m.ridge_from_stats(m.gram_stats(df, [], [*COLUMNS, "y"]), {"r": m.Ridge(tuple(COLUMNS))}, COLUMNS, "y")
    coef = fitted.select("coef_r").collect()[0][0]
    assert coef[4] == pytest.approx(0.0, abs=1e-9)
    assert np.allclose(coef[:4], closed_form(x, y), rtol=1e-9, atol=1e-9)


def test_delta_model_equals_a_fit_on_the_change(data):
    x, y, _, df = data
    spec = m.Ridge(("x1", "x2"), delta_from="x0")
    fitted = m.ridge_from_stats(m.gram_stats(df, [], [*COLUMNS, "y"]), {"d": spec}, COLUMNS, "y")
    coef = fitted.select("coef_d").collect()[0][0]
    assert np.allclose(coef, closed_form(x[:, 1:], y - x[:, 0]), rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        m.Ridge(("x0",), delta_from="x0")


def test_one_table_is_fitted_and_applied_in_one_plan(data):
    x, y, _, df = data
    train = F.col("x1") < -15
    spec = m.Ridge(("x0", "x1", "x2"), 2.0)
    rows = m.fit_predict(df, [], {"r": spec, "d": m.delta_wrap(spec, "x0")}, "y", train).select("x0", "x1", "x2", "y_pred_r", "y_pred_d").collect()
    kept = x[:, 1] < -15
    for k, use in (("y_pred_r", [0, 1, 2]), ("y_pred_d", [1, 2])):
        base = 0 if k == "y_pred_r" else x[kept, 0]
        want = closed_form(x[kept][:, use], y[kept] - base, 2.0)
        for r in rows:
            assert r[k] == pytest.approx(want[0] + sum(w * r[f"x{i}"] for w, i in zip(want[1:], use)) + (0 if k == "y_pred_r" else r["x0"]))


def test_cell_without_training_rows_predicts_null(data):
    *_, df = data
    out = m.fit_predict(df, ["g"], {"r": m.Ridge(("x0",))}, "y", F.col("g") == "a")
    counts = dict(out.groupBy("g").agg(F.count("y_pred")).collect())
    assert counts["b"] == 0 and counts["a"] == 100
    assert m.fit_predict(df, [], {"r": m.Ridge(("x0",))}, "y", F.lit(False)).agg(F.count("y_pred")).head()[0] == 0


def test_large_amounts_with_little_spread(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2)) * [3.0, 50.0]
    y = np.round(x @ [4.0, -0.25] * 128) / 128 + 8
    big = np.array([1e13, 3e13])
    shifted = np.round(x * 256) / 256 + big
    exact = shifted - big
    rows = [(i, *map(float, r), float(t + 2e13)) for i, (r, t) in enumerate(zip(shifted, y))]
    df = spark.createDataFrame(rows, "t int, a double, b double, y double").repartition(8)
    want = closed_form(exact, y)
    spec = m.Ridge(("a", "b"))
    coef = m.ridge_from_stats(m.gram_stats(df, [], ["a", "b", "y"]), {"r": spec}, ["a", "b"], "y").select("coef_r").head()[0]
    assert np.allclose(coef[1:], want[1:], rtol=1e-6)
    for stats in (m.expanding_gram(df, [], "t", ["a", "b"], "y"), m.expanding_gram_imputed(df, [], "t", ["a", "b"], "y")):
        last = m.ridge_from_stats(stats, {"r": spec}, ["a", "b"], "y").where("t = 399").select("coef_r").head()[0]
        assert np.allclose(last[1:], closed_form(exact[:399], y[:399])[1:], rtol=1e-6)


@pytest.mark.parametrize("horizon", [1, 3])
def test_imputed_statistics_equal_a_refit_of_every_step(spark, horizon):
    rng = np.random.default_rng(horizon)
    x = np.round(rng.normal(size=(70, 3)) * [1, 100, 5] + [0, 1e4, -3], 2)
    x[rng.random(x.shape) < 0.3] = np.nan
    x[:25, 2] = np.nan
    y = np.nansum(x * [3, 0.01, 1], axis=1) + rng.normal(size=70)
    y[[10, 11, 69]] = np.nan
    rows = [("s", i, *[None if np.isnan(v) else float(v) for v in (*x[i], y[i])]) for i in range(70)]
    rows += [("other", i, 1.0, None, 2.0, 3.0) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, t int, a double, b double, c double, y double").repartition(5)
    names = ["a", "b", "c"]
    fitted = m.ridge_from_stats(m.expanding_gram_imputed(df, ["g"], "t", names, "y", horizon), {"r": m.Ridge(tuple(names))}, names, "y", 5)
    got = {r["t"]: r for r in fitted.where("g = 's'").collect()}
    for t in range(70):
        train = [i for i in range(t - horizon + 1) if not np.isnan(y[i])]
        assert got[t]["n"] == len(train)
        if len(train) < 5:
            assert got[t]["coef_r"] is None
            continue
        part = x[train]
        med = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in part.T])
        want = closed_form(np.where(np.isnan(part), med, part), y[train])
        assert np.allclose(got[t]["coef_r"], want, rtol=1e-8, atol=1e-8)
        assert np.allclose([got[t][f"in_{c}"] for c in names], np.where(np.isnan(x[t]), med, x[t]))


def test_imputed_statistics_of_long_series_in_stretches():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(500, 2)), rng.normal(size=500)
    x[rng.random(x.shape) < 0.2] = np.nan
    for whole, parts in zip(m._imputed_stats(x, y, 2), m._imputed_stats(x, y, 2, chunk=17)):
        assert np.allclose(whole, parts, atol=1e-12)


def test_running_medians():
    rng = np.random.default_rng(9)
    values, known = np.round(rng.normal(size=200), 1), rng.random(200) < 0.7
    got = m.running_medians(values, known)
    for k in range(201):
        part = values[:k][known[:k]]
        assert np.isnan(got[k]) if not len(part) else got[k] == pytest.approx(np.median(part))


def test_series_medians_come_from_training_rows(spark):
    df = spark.createDataFrame(
        [("a", 1.0, None, True), ("a", 4.0, None, True), ("a", None, None, False), ("a", 100.0, 3.0, False), ("b", None, 5.0, True)],
        "g string, v double, w double, t boolean",
    )
    out = m.impute_series(df, ["g"], ["v", "w"], F.col("t"))
    assert sorted((r.g, r.v, r.w) for r in out.collect()) == [
        ("a", 1.0, 0.0), ("a", 2.5, 0.0), ("a", 4.0, 0.0), ("a", 100.0, 3.0), ("b", 0.0, 5.0),
    ]


def test_expanding_fit_equals_refit(spark, data):
    x, y, _, _ = data
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(60)]
    df = spark.createDataFrame(rows, "t int, x0 double, x1 double, x2 double, y double")
    stats = m.expanding_gram(df, [], "t", ["x0", "x1", "x2"], "y")
    fitted = m.ridge_from_stats(stats, {"r": m.Ridge(("x0", "x1", "x2"))}, ["x0", "x1", "x2"], "y", min_rows=10)
    got = {r[0]: r[1] for r in fitted.select("t", "coef_r").collect()}
    assert got[9] is None
    for t in (10, 35, 59):
        assert np.allclose(got[t], closed_form(x[:t], y[:t]), rtol=1e-7, atol=1e-7)


def test_horizon_keeps_unknown_targets_out(spark):
    df = spark.createDataFrame([(i, float(i), float(i)) for i in range(6)], "t int, x double, y double")
    one = [r[0] for r in m.expanding_gram(df, [], "t", ["x"], "y", 1).orderBy("t").select("n").collect()]
    three = [r[0] for r in m.expanding_gram(df, [], "t", ["x"], "y", 3).orderBy("t").select("n").collect()]
    assert one == [0, 1, 2, 3, 4, 5] and three == [0, 0, 0, 1, 2, 3]


def test_boosted_trees_beat_the_mean_and_rank_features(spark, data):
    _, y, _, df = data
    flagged = df.withColumn("inner", F.rand(1) < 0.15)
    model = m.fit_boosted_trees(flagged, ["x0", "x1", "x2"], "y", inner="inner", settings=m.BoostSettings(rounds=40))
    mse = m.apply_model(model, df, ["x0", "x1", "x2"]).agg(F.avg((F.col("y") - F.col("y_pred")) ** 2)).collect()[0][0]
    assert mse < 0.5 * y.var()
    gains = [r[1] for r in m.feature_importance(spark, model, ["x0", "x1", "x2"]).collect()]
    assert gains == sorted(gains, reverse=True) and sum(gains) == pytest.approx(1.0)


def test_imputation_uses_training_rows_only(spark, rows):
    df = spark.createDataFrame(
        [("a", 1.0, None, True), ("a", 4.0, None, True), ("a", None, None, False), ("a", 100.0, 3.0, False)],
        "g string, v double, w double, t boolean",
    )
    out = m.impute_median(df, ["g"], ["v", "w"], F.col("t"))
    assert sorted((r.v, r.w) for r in out.collect()) == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0), (100.0, 3.0)]


def test_feature_pool():
    assert m.feature_pool(["smp_lag_1m", "z"]) == ["smp_lag_1m"]
    assert m.feature_pool(["hour_sin", "z"]) == ["hour_sin"]
    assert m.feature_pool(["capacity_x"]) == ["capacity_x"]
    with pytest.raises(KeyError):
        m.feature_pool(["a"], explicit=["b"])
    with pytest.raises(KeyError):
        m.feature_pool(["a"], ar_only=True)


def test_pool_by_name():
    table = ["area", "period_month", "price", "price_lag_12m", "price_rolling_3m_mean", "month", "is_summer", "hour_sin", "target", "capacity_lag_1y", "lagged"]
    assert m.features_by_name(table, ["price"]) == ["price", "price_lag_12m", "price_rolling_3m_mean", "month", "is_summer", "hour_sin", "capacity_lag_1y"]
    assert m.feature_pool(table[:5]) == ["price_lag_12m", "price_rolling_3m_mean"]
