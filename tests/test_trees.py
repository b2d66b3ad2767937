"""Boosted trees of cells against exhaustive search, and inside the version grid."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees as t
from tidemark.operators.splits import Version
from tidemark.plans import backtests as bt


def best_split(x, r, leaf_rows, cuts):
    """(gain, feature, threshold) by trying everything."""
    best = (0.0, None, None)
    for j in range(x.shape[1]):
        for cut in cuts[j]:
            left = x[:, j] <= cut
            if min(left.sum(), (~left).sum()) < leaf_rows:
                continue
            gain = r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)
            if gain > best[0] * (1 + 1e-9):
                best = (gain, j, cut)
    return best


def tree_by_hand(x, r, new, depth, leaf_rows, cuts):
    gain, j, cut = best_split(x, r, leaf_rows, cuts) if depth and len(r) else (0.0, None, None)
    if j is None or gain <= 1e-9 * 1.0:
        return np.full(len(new), r.mean() if len(r) else 0.0)
    left, there = x[:, j] <= cut, new[:, j] <= cut
    out = np.empty(len(new))
    out[there] = tree_by_hand(x[left], r[left], new[there], depth - 1, leaf_rows, cuts)
    out[~there] = tree_by_hand(x[~left], r[~left], new[~there], depth - 1, leaf_rows, cuts)
    return out


@pytest.mark.parametrize("depth, rounds", [(1, 1), (2, 1), (3, 4)])
def test_boosting_equals_exhaustive_trees(depth, rounds):
    rng = np.random.default_rng(depth)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = np.sin(x[:, 0]) * 5 + (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=120)
    new = np.round(rng.normal(size=(40, 3)), 1)
    got, gains = t.boost(x, y, new, t.Boosting(rounds=rounds, depth=depth, step=0.5, leaf_rows=4))
    cuts = [np.unique(c)[:-1] + np.diff(np.unique(c)) / 2 for c in x.T]
    now, out = np.full(120, y.mean()), np.full(40, y.mean())
    for _ in range(rounds):
        rest = y - now
        out = out + 0.5 * tree_by_hand(x, rest, new, depth, 4, cuts)
        now = now + 0.5 * tree_by_hand(x, rest, x, depth, 4, cuts)
    assert np.allclose(got, out)
    assert gains.sum() == pytest.approx(1.0) and (gains >= 0).all()


def test_many_values_are_binned_and_unknown_ones_go_left():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 1))
    y = np.where(x[:, 0] < 0.2, 1.0, 5.0)
    out, _ = t.boost(x, y, np.array([[0.0], [1.0], [np.nan]]), t.Boosting(rounds=60, depth=1, bins=32))
    assert len(t.bin_edges(x[:, 0], 32)) <= 31
    assert out[0] < 1.6 and out[1] > 4.4 and out[2] == out[0]
    flat, gains = t.boost(np.ones((9, 2)), np.arange(9.0), np.ones((2, 2)), t.Boosting())
    assert flat.tolist() == [4.0, 4.0] and gains.tolist() == [0.0, 0.0]


def test_inner_rows_stop_the_rounds():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(200, 4)), rng.normal(size=200)
    inner = np.arange(200) >= 150
    stopped, _ = t.boost(x, y, x[inner], t.Boosting(rounds=300, step=0.5, patience=5), inner)
    on, _ = t.boost(x[~inner], y[~inner], x[inner], t.Boosting(rounds=300, step=0.5))
    assert np.square(y[inner] - stopped).mean() < np.square(y[inner] - on).mean()


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    rows = []
    for area in "ab":
        level = np.cumsum(rng.normal(size=60)) + 100
        for i in range(60):
            month = date(2018 + i // 12, i % 12 + 1, 1)
            rows.append((area, month, float(level[i]), None if i % 7 == 0 else float(level[i - 1]), float(level[i + 1]) if i < 59 else None))
    return spark.createDataFrame(rows, "area string, period_month date, observed double, lag double, target double")


def test_trees_in_the_version_grid(panel):
    small = t.Boosting(rounds=20, depth=2)
    models = bt.ModelSet(
        naive={"last": "observed"}, trees={"trees": t.Trees(("observed", "lag"), small), "delta": t.Trees(("observed", "lag"), small).delta_wrap("observed")},
        min_train={"trees": 24, "delta": 24},
    )
    versions = [Version("v1", "2021-06-01", "2021-06-01", "2021-07-01", "2021-12-01"), Version("v2", "2018-06-01", "2018-06-01", "2018-07-01", "2018-09-01")]
    rows = {(r["version"], r["model"], r["area"]): r for r in bt.backtest_matrix(panel, ["area"], versions, models, "target").collect()}
    assert len(rows) == 12
    assert rows["v1", "trees", "a"]["n_test"] == 6 and rows["v1", "delta", "b"]["mae"] < 10
    assert rows["v2", "delta", "a"]["skip_reason"] == "n_train=5 < min_train_rows=24"


def test_cells_without_training_rows_and_gains(panel):
    is_train = (F.col("area") == "a") & (F.col("period_month") < "2022-01-01")
    out = t.tree_predictions(panel, ["area"], {"p": t.Trees(("lag",))}, "target", is_train, min_rows=10).groupBy("area").agg(F.count("*"), F.count("p"))
    assert sorted(map(tuple, out.collect())) == [("a", 12, 12), ("b", 60, 0)]
    gains = t.tree_gains(panel, ["area"], t.Trees(("lag", "observed")), "target", is_train).collect()
    assert sum(r["gain"] for r in gains if r["area"] == "a") == pytest.approx(1.0)
    assert all(r["gain"] == 0 for r in gains if r["area"] == "b") and len(gains) == 4
