"""Walk-forward, version-by-model grids, ablations and cross-validation as single plans.

Every cell of a grid (step, version, fold, feature group) is fitted from the same kind of
sufficient statistics, so a grid is one aggregation followed by one scan, not a loop of fits.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import scores as sc
from tidemark.operators.models import (
    Ridge, expanding_gram, expanding_gram_imputed, gram_sets, gram_stats, impute_series,
    linear_prediction, ridge_from_stats, with_refs,
)
from tidemark.operators.splits import Version, split_chronological, ts_folds, version_cells
from tidemark.operators.trees import Trees, tree_predictions


@dataclass(frozen=True)
class ModelSet:
    """Naive models by the column they repeat, linear ones and trees by their specification.

    ``min_train`` is the smallest number of training rows per model.
    """

    naive: Mapping[str, str] = field(default_factory=dict)
    linear: Mapping[str, Ridge] = field(default_factory=dict)
    min_train: Mapping[str, int] = field(default_factory=dict)
    trees: Mapping[str, Trees] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.naive, *self.linear, *self.trees]

    @property
    def columns(self) -> list[str]:
        """Columns the linear models need, each once."""
        used = [c for s in self.linear.values() for c in (*s.features, *([s.delta_from] if s.delta_from else []))]
        return list(dict.fromkeys(used))

    def column_sets(self) -> list[ModelSet]:
        """The linear models by the columns they need: what one set lacks does not cost another its rows."""
        by_columns: dict[frozenset, dict[str, Ridge]] = {}
        for m, spec in self.linear.items():
            by_columns.setdefault(frozenset(ModelSet(linear={m: spec}).columns), {})[m] = spec
        return [ModelSet({}, linear, self.min_train) for linear in by_columns.values()]


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _predictions(df: DataFrame, models: ModelSet, keep: Sequence[str], inputs: str = "", steps: Mapping[str, Column] | None = None) -> DataFrame:
    """Long table of all models' predictions on rows that carry their coefficients.

    ``inputs`` is put before the linear models' feature names; ``steps`` says where a model predicts at all.
    """
    cols: dict[str, Column] = {m: F.col(c).cast("double") for m, c in models.naive.items()}
    cols |= {m: linear_prediction(m, s, inputs) for m, s in models.linear.items()}
    allowed = {m: F.when(steps[m], c) if steps and m in steps else c for m, c in cols.items()}
    wide = df.select(*keep, *[c.alias(m) for m, c in allowed.items()])
    return wide.unpivot(list(keep), list(cols), "model", "y_pred")


def _fitted(df: DataFrame, models: ModelSet, key: Sequence[str], target: str, is_train: Column) -> DataFrame:
    """Coefficients of all linear models per cell: one aggregation for all column sets, each over its own complete rows."""
    sets = models.column_sets()
    stats = gram_sets(df, key, [[*s.columns, target] for s in sets], is_train)
    for k, part in enumerate(sets):
        stats = ridge_from_stats(stats, part.linear, part.columns, target, suffix=str(k))
    return stats.select(*key, *[f"{p}_{m}" for m in models.linear for p in ("coef", "mid")])


def _known(columns: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"`{c}` IS NOT NULL" for c in columns))


def _with_inputs(df: DataFrame, models: ModelSet, cell: Sequence[str], is_train: Column, target: str, period: str) -> DataFrame:
    """``in_<column>``: the linear models' columns with holes filled from the training rows of the cell."""
    names = [f"in_{c}" for c in models.columns]
    copies = df.withColumns({n: F.col(c) for n, c in zip(names, models.columns)})
    return with_refs(impute_series(copies, cell, names, is_train), [*names, target], cell, period)


def _on_inputs(models: ModelSet) -> ModelSet:
    """The same models on the filled columns; naive ones stay on what was observed."""
    linear = {
        m: replace(s, features=tuple(f"in_{f}" for f in s.features), delta_from=s.delta_from and f"in_{s.delta_from}")
        for m, s in models.linear.items()
    }
    return replace(models, linear=linear)


def walk_forward(
    panel: DataFrame, group: Sequence[str], models: ModelSet, target: str, observed: str,
    horizon: int = 1, min_train: int = 24, start: str | None = None, period: str = "period_month",
    impute: bool = False,
) -> DataFrame:
    """Predict every row from ``min_train`` known rows on by models fitted on all rows before it.

    ``panel`` is a gridded series per group. A row is trained on only when its target was
    known at the row to predict, which for one step ahead is every earlier row. Models that need other
    columns do not matter to a model: its steps and training rows are those complete for itself.

    ``impute`` fills holes in features with the median of the step's training rows instead, as a linear
    model would do by itself: all rows with a known target are then trained on.

    All models share one scan and one running window.
    """
    sets = models.column_sets()
    part = f"PARTITION BY {', '.join(f'`{g}`' for g in group)} " if group else ""
    known = F.expr(f"count(`{target}`) OVER ({part}ORDER BY `{period}` ROWS BETWEEN UNBOUNDED PRECEDING AND {horizon} PRECEDING)")
    stats, steps, inputs = panel.withColumn("_known", known), {m: F.col("_known") >= min_train for m in models.naive}, ""
    if impute and sets:
        stats, inputs = expanding_gram_imputed(stats, group, period, models.columns, target, horizon), "in_"
        stats = ridge_from_stats(stats, models.linear, models.columns, target, min_train)
    else:
        for k, some in enumerate(sets):
            stats = expanding_gram(stats, group, period, some.columns, target, horizon, str(k))
        for k, some in enumerate(sets):
            stats = ridge_from_stats(stats, some.linear, some.columns, target, min_train, str(k))
    rows = stats.where(F.col(target).isNotNull())
    if start:
        rows = rows.where(F.col(period) >= F.lit(start).cast("date"))
    named = rows.withColumns({"y_true": F.col(target).cast("double"), "observed_value": F.col(observed).cast("double")})
    keep = [*group, period, "y_true", "observed_value"]
    return _predictions(named, models, keep, inputs, steps).where("y_pred IS NOT NULL").withColumns(
        {
            "forecast_origin_month": F.col(period),
            "target_month": F.add_months(F.col(period), horizon),
            "true_delta": F.col("y_true") - F.col("observed_value"),
            "predicted_delta": F.col("y_pred") - F.col("observed_value"),
        }
    )


def _train_pool(panel: DataFrame, versions: Sequence[Version], horizon: int, group: Sequence[str], period: str) -> DataFrame:
    """Rows per version and group that could be trained on at its cutoff."""
    p = F.col(period)
    counts = [
        F.struct(
            F.lit(v.name).alias("version"),
            F.count_if(
                (F.add_months(p, horizon) <= F.lit(v.cutoff).cast("date"))
                & (p <= F.lit(v.train_end).cast("date"))
            ).alias("n_train"),
        )
        for v in versions
    ]
    return panel.groupBy(*group).agg(F.array(*counts).alias("_c")).select(*group, F.inline("_c"))


def backtest_predictions(
    panel: DataFrame, group: Sequence[str], versions: Sequence[Version], models: ModelSet, target: str,
    horizon: int = 1, period: str = "period_month", impute: bool = False,
) -> DataFrame:
    """Predictions of every (version, model) on its test rows, all from one aggregation of the cells.

    ``impute`` fills holes in the linear models' features with the median of the cell's training rows.
    """
    own = [] if impute else list(dict.fromkeys([*models.columns, target]))
    cells = version_cells(with_refs(panel, own, group, period), versions, horizon, target, period)
    key = ["version", "eval_month", *group]
    # an absent evaluation month must still match in the join below
    keyed = cells.withColumn("eval_month", F.coalesce("eval_month", F.lit("1900-01-01").cast("date")))
    if impute and models.linear:
        keyed, models = _with_inputs(keyed, models, key, F.col("role") == "train", target, period), _on_inputs(models)
    test = keyed.where("role = 'test'").withColumn("y_true", F.col(target).cast("double"))
    keep, found, is_train = ["version", *group, period, "y_true"], [], F.col("role") == "train"
    if models.linear:
        found.append(_predictions(test.join(_fitted(keyed, models, key, target, is_train), key, "left"), models, keep))
    elif models.naive:
        found.append(_predictions(test, models, keep))
    if models.trees:
        grown = tree_predictions(keyed, key, dict(models.trees), target, is_train).withColumn("y_true", F.col(target).cast("double"))
        found.append(grown.unpivot(keep, list(models.trees), "model", "y_pred"))
    return _union(found)


def backtest_matrix(
    panel: DataFrame, group: Sequence[str], versions: Sequence[Version], models: ModelSet, target: str,
    horizon: int = 1, period: str = "period_month", impute: bool = False,
) -> DataFrame:
    """One row per version, model and series: metrics, or the reason the cell was skipped.

    A cell short of training rows, without test rows or without a usable prediction is a row
    with a reason; it never stops the others.
    """
    predicted = backtest_predictions(panel, group, versions, models, target, horizon, period, impute)
    key = ["version", "model", *group]
    steps = sc.with_steps(sc.pairs(predicted), key, [], period)
    scored = steps.groupBy(*key).agg(*sc.error_aggs(), sc.direction_agg())
    needs = F.array(
        *[
            F.struct(F.lit(m).alias("model"), F.lit(models.min_train.get(m, 0)).alias("min_train"))
            for m in models.names
        ]
    )
    modes = F.create_map(*[F.lit(x) for v in versions for x in (v.name, v.mode)])
    planned = _train_pool(panel, versions, horizon, group, period).select("*", F.inline(needs))
    joined = planned.join(scored, key, "left")
    short = F.col("n_train") < F.col("min_train")
    reason = F.when(
        short,
        F.concat(
            F.lit("n_train="), F.col("n_train").cast("string"), F.lit(" < min_train_rows="),
            F.col("min_train").cast("string"),
        ),
    ).when(F.col("n").isNull(), "no rows to evaluate")
    valid = reason.isNull()
    return joined.select(
        *key,
        F.element_at(modes, F.col("version")).alias("evaluation_mode"),
        "n_train",
        F.when(valid, F.col("n")).otherwise(0).alias("n_test"),
        *[F.when(valid, sc.finite(F.col(m))).alias(m) for m in sc.METRICS],
        reason.isNotNull().alias("skipped"),
        reason.alias("skip_reason"),
    )


def ablation(
    panel: DataFrame, group: Sequence[str], groups: Mapping[str, Sequence[str]], target: str, observed: str,
    period: str = "period_month", valid: float = 0.15, test: float = 0.15, min_train: int = 24, alpha: float = 1.0,
) -> DataFrame:
    """Error of each model on each feature group: one imputed table, one set of statistics.

    Persistence and the delta model need the observed column in the group, the delta model
    one more besides it.
    """
    columns = list(dict.fromkeys(c for cols in groups.values() for c in cols))
    rows = split_chronological(panel.where(F.col(target).isNotNull()), group, period, valid, test, min_train)
    doubles = rows.withColumns({c: F.col(c).cast("double") for c in columns})
    filled = impute_series(doubles, group, columns, F.col("split") == "train")
    linear: dict[str, Ridge] = {}
    naive: dict[str, str] = {}
    for name, cols in groups.items():
        linear[f"{name}:ridge"] = Ridge(tuple(cols), alpha)
        if observed in cols:
            naive[f"{name}:persistence_monthly"] = observed
            rest = tuple(c for c in cols if c != observed)
            if rest:
                linear[f"{name}:delta_ridge"] = Ridge(rest, alpha, observed)
    models = ModelSet(naive, linear)
    stats = gram_stats(filled, group, [*columns, target], F.col("split") == "train")
    fitted = ridge_from_stats(stats, linear, columns, target).drop("n", "means", "cov")
    tested = filled.where("split = 'test'").join(fitted, list(group))
    named = tested.withColumns({"y_true": F.col(target).cast("double"), "_observed": F.col(observed)})
    predicted = _predictions(named, models, [*group, period, "y_true", "_observed"])
    key = [*group, "feature_group", "model"]
    split_name = F.split("model", ":")
    labelled = predicted.withColumns({"feature_group": split_name[0], "model": split_name[1]})
    sizes = F.create_map(*[F.lit(x) for n, cols in groups.items() for x in (n, len(cols))])
    return (
        sc.pairs(labelled)
        .groupBy(*key)
        .agg(*sc.error_aggs(), *sc.delta_aggs("_observed"))
        .withColumn("n_features", F.element_at(sizes, F.col("feature_group")))
    )


def cross_validate(
    panel: DataFrame, group: Sequence[str], models: ModelSet, target: str, k: int = 5, embargo: int = 1,
    period: str = "period_month", impute: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions with their fold, and the metrics per fold with its size and range.

    Folds are laid over the rows that are complete for the model. Models that need the same columns
    share them, and every set of columns is a value of ``_set`` in one scan. With ``impute``
    holes do not make a row incomplete for a linear model: they are filled with the median of the fold's training rows.
    """
    sets = [([c], {m: c}, {}) for m, c in models.naive.items()]
    sets += [([] if impute else s.columns, {}, s.linear) for s in models.column_sets()]
    usable = [F.when(_known([*cols, target]), F.lit(i)) for i, (cols, _, _) in enumerate(sets)]
    own = [] if impute or not models.linear else list(dict.fromkeys([*models.columns, target]))
    rows = with_refs(panel, own, group, period).withColumn("_set", F.explode(F.array_compact(F.array(*usable))))
    folds = ts_folds(rows, [*group, "_set"], period, k, embargo)
    key, is_train = [*group, "_set", "fold"], F.col("role") == "train"
    if impute and models.linear:
        folds, models = _with_inputs(folds, models, key, is_train, target, period), _on_inputs(models)
    held_out = folds.where("role = 'valid'").withColumn("y_true", F.col(target).cast("double"))
    if models.linear:
        first_linear = len(models.naive)
        fitted = _fitted(folds.where(F.col("_set") >= first_linear), models, key, target, is_train)
        held_out = held_out.join(fitted, key, "left")
    own = {m: F.col("_set") == i for i, (_, naive, linear) in enumerate(sets) for m in (*naive, *linear)}
    predicted = _predictions(held_out, models, [*group, "_set", "fold", period, "y_true"], steps=own)
    of_set = F.element_at(F.array(*[F.array(*[F.lit(m) for m in (*naive, *linear)]) for _, naive, linear in sets]), F.col("_set") + 1)
    predicted = predicted.where(F.array_contains(of_set, F.col("model"))).drop("_set")
    ranges = folds.groupBy(*key).agg(
        F.count_if(is_train).alias("train_n"),
        F.min(F.when(is_train, F.col(period))).alias("train_from"),
        F.max(F.when(is_train, F.col(period))).alias("train_to"),
        F.min(F.when(~is_train, F.col(period))).alias("valid_from"),
        F.max(F.when(~is_train, F.col(period))).alias("valid_to"),
    ).withColumn("model", F.explode(of_set)).drop("_set")
    named = [*group, "fold", "model"]
    return predicted, sc.rmse_mape(predicted, named).join(ranges, named)
