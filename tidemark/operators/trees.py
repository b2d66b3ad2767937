"""Boosted regression trees for many cells at once.

A cell is one version, fold or step of one gridded series, so the calendar bounds it: each is fitted in one task
from histograms of its residuals, and a grid of any number of cells is a single grouped pass. One large table
without cells is for ``models.fit_boosted_trees``.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Boosting:
    """How trees are grown; ``patience`` counts rounds without a better error on the inner rows."""

    rounds: int = 100
    depth: int = 3
    step: float = 0.1
    leaf_rows: int = 5
    bins: int = 255
    patience: int = 20


@dataclass(frozen=True)
class Trees:
    """Features of a tree model; with ``delta_from`` it predicts the change against that column."""

    features: tuple[str, ...]
    settings: Boosting = field(default_factory=Boosting)
    delta_from: str | None = None

    def delta_wrap(self, observed: str) -> Trees:
        return replace(self, features=tuple(f for f in self.features if f != observed), delta_from=observed)

    @property
    def columns(self) -> list[str]:
        return list(dict.fromkeys([*self.features, *([self.delta_from] if self.delta_from else [])]))


def bin_edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between neighbouring values; of many values only those at even ranks."""
    values = np.unique(x[~np.isnan(x)])
    if len(values) > bins:
        ordered = np.sort(x[~np.isnan(x)])
        values = np.unique(ordered[np.linspace(0, len(ordered) - 1, bins).astype(int)])
    return values[:-1] + (values[1:] - values[:-1]) / 2


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of thresholds below each value; an unknown value counts as smaller than all."""
    known = np.where(np.isnan(x), -np.inf, x)
    return np.column_stack([np.searchsorted(e, known[:, j], side="left") for j, e in enumerate(edges)])


def _grow(codes: np.ndarray, rest: np.ndarray, sizes: list[int], s: Boosting, gains: np.ndarray) -> list[tuple]:
    """Splits of one tree, level by level: ``(node, feature, last bin to the left)``; children of n are 2n + 1 and 2n + 2.

    Of equal gains the first feature and the smallest threshold win.
    """
    node, splits = np.zeros(len(rest), dtype=np.int64), []
    for level in range(s.depth):
        first, count = (1 << level) - 1, 1 << level
        best, chosen = np.full(count, 0.0), [None] * count
        inside = node >= first
        at = node[inside] - first
        total, many = np.bincount(at, rest[inside], count), np.bincount(at, minlength=count)
        for j, size in enumerate(sizes):
            if size < 2:
                continue
            place = at * size + codes[inside, j]
            left = np.bincount(place, rest[inside], count * size).reshape(count, size).cumsum(axis=1)[:, :-1]
            n_left = np.bincount(place, minlength=count * size).reshape(count, size).cumsum(axis=1)[:, :-1]
            n_right = many[:, None] - n_left
            allowed = (n_left >= s.leaf_rows) & (n_right >= s.leaf_rows)
            right = total[:, None] - left
            gain = left**2 / np.maximum(n_left, 1) + right**2 / np.maximum(n_right, 1) - (total**2 / np.maximum(many, 1))[:, None]
            gain = np.where(allowed, gain, 0.0)
            # what rounding makes of an even split is no gain
            top = gain.max(axis=1)
            cut = np.argmax(gain >= top[:, None] * (1 - 1e-9), axis=1)
            for k in np.flatnonzero(top > np.maximum(best * (1 + 1e-9), 1e-9 * float(rest @ rest))):
                best[k], chosen[k] = top[k], (j, int(cut[k]))
        if not any(chosen):
            break
        for k, split in enumerate(chosen):
            if split:
                gains[split[0]] += best[k]
                splits.append((first + k, *split))
                here = node == first + k
                node[here] = 2 * (first + k) + 1 + (codes[here, split[0]] > split[1])
    return splits


def _leaves(codes: np.ndarray, splits: list[tuple]) -> np.ndarray:
    node = np.zeros(len(codes), dtype=np.int64)
    for at, j, cut in splits:
        here = node == at
        node[here] = 2 * at + 1 + (codes[here, j] > cut)
    return node


def boost(x: np.ndarray, y: np.ndarray, new: np.ndarray, s: Boosting, inner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Predictions for the rows ``new`` of trees fitted on ``x`` and ``y``, and each feature's share of the gain.

    Rows flagged ``inner`` are not fitted on; they say after which round to stop.
    """
    fit = np.ones(len(y), dtype=bool) if inner is None or inner.all() or not inner.any() else ~inner
    edges = [bin_edges(x[fit, j], s.bins) for j in range(x.shape[1])]
    codes, new_codes, sizes = _binned(x, edges), _binned(new, edges), [len(e) + 1 for e in edges]
    now, out, gains = np.full(len(y), y[fit].mean()), np.full(len(new), y[fit].mean()), np.zeros(x.shape[1])
    best = (np.inf, 0, out.copy(), gains.copy())
    for turn in range(s.rounds):
        rest = y - now
        splits = _grow(codes[fit], rest[fit], sizes, s, gains)
        if not splits:
            break
        leaf = _leaves(codes, splits)
        sums, many = np.bincount(leaf[fit], rest[fit], leaf.max() + 1), np.bincount(leaf[fit], minlength=leaf.max() + 1)
        value = s.step * sums / np.maximum(many, 1)
        now = now + value[leaf]
        there = _leaves(new_codes, splits)
        out = out + np.where(there < len(value), value[np.minimum(there, len(value) - 1)], 0.0)
        if not fit.all():
            error = float(np.square(y[~fit] - now[~fit]).mean())
            if error < best[0]:
                best = (error, turn, out.copy(), gains.copy())
            elif turn - best[1] >= s.patience:
                break
    if not fit.all() and best[0] < np.inf:
        _, _, out, gains = best
    return out, gains / gains.sum() if gains.sum() else gains


def _numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.zeros((len(table), 0)), *[table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in names]])


def _prepared(df: DataFrame, models: dict[str, Trees], target: str, is_train: Column, inner: Column | None) -> DataFrame:
    used = dict.fromkeys([c for m in models.values() for c in m.columns] + [target])
    flags = {"_train": F.coalesce(is_train, F.lit(False)), "_inner": F.lit(False) if inner is None else F.coalesce(inner, F.lit(False))}
    return df.withColumns({f"_x_{c}": F.col(c).cast("double") for c in used} | flags)


def _fit(table: pa.Table, spec: Trees, target: str, min_rows: int) -> tuple[np.ndarray, np.ndarray]:
    x, y = _numbers(table, [f"_x_{f}" for f in spec.features]), _numbers(table, [f"_x_{target}"])[:, 0]
    base = _numbers(table, [f"_x_{spec.delta_from}"])[:, 0] if spec.delta_from else np.zeros(len(table))
    train, inner = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("_train", "_inner"))
    usable = train & ~np.isnan(y) & ~np.isnan(base)
    if usable.sum() < max(min_rows, 1):
        return np.full(len(table), np.nan), np.zeros(x.shape[1])
    out, gains = boost(x[usable], (y - base)[usable], x, spec.settings, inner[usable])
    return base + out, gains


def tree_predictions(
    df: DataFrame, cell: Sequence[str], models: dict[str, Trees], target: str, is_train: Column, inner: Column | None = None,
    min_rows: int = 1,
) -> DataFrame:
    """The rows that are not trained on, with a column per model: fitted on the cell's training rows.

    Nulls in features are smaller than any value; rows without target (or base of a change) are not trained
    on. A cell with fewer than ``min_rows`` of them predicts null. Rows flagged ``inner`` stop the rounds early.
    """
    kept = [c for c in df.columns]
    schema = T.StructType([*df.schema.fields, *[T.StructField(m, T.DoubleType()) for m in models]])

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        held = pa.array(~table.column("_train").to_numpy(zero_copy_only=False).astype(bool))
        out = table.select(kept)
        for name, spec in models.items():
            predicted, _ = _fit(table, spec, target, min_rows)
            out = out.append_column(name, pa.array(predicted, mask=np.isnan(predicted)))
        return out.filter(held)

    return _prepared(df, models, target, is_train, inner).groupBy(*cell).applyInArrow(run, schema)


def tree_gains(
    df: DataFrame, cell: Sequence[str], spec: Trees, target: str, is_train: Column, inner: Column | None = None
) -> DataFrame:
    """``cell``, ``feature``, ``gain``: each feature's share of what the trees of a cell have gained."""
    keys = [df.schema[c] for c in cell]
    schema = T.StructType([*keys, T.StructField("feature", T.StringType()), T.StructField("gain", T.DoubleType())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        _, gains = _fit(table.combine_chunks(), spec, target, 1)
        columns = {c: pa.array([k.as_py()] * len(gains), table.schema.field(c).type) for c, k in zip(cell, key)}
        return pa.table({**columns, "feature": pa.array(list(spec.features), pa.string()), "gain": pa.array(gains)})

    return _prepared(df, {"m": spec}, target, is_train, inner).groupBy(*cell).applyInArrow(run, schema)
