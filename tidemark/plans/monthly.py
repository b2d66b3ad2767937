"""The monthly feature table: one lazy plan from revisions to a leakage-checked table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arithmetic import unit_price
from tidemark.functions.calendar import calendar_monthly, forecast_contract
from tidemark.operators import checks
from tidemark.operators.aggregates import pivot_mean
from tidemark.operators.grids import (
    MONTHLY_LAGS, MONTHLY_ROLLS, LagSpec, RollSpec, add_lags_and_rolls, exogenous_lag, lead_target, monthly_grid,
)
from tidemark.operators.joins import common_keys, one_row_per_date
from tidemark.operators.revisions import dedup_log, dedup_revisions
from tidemark.sources.files import union_all

PERIOD = "period_month"
TARGET = "target_t_plus_h_months"
OBSERVED = "t_observed"


def price_block(
    volume: DataFrame, amount: DataFrame, pairs: Mapping[str, tuple[str, str]], key: str = PERIOD
) -> DataFrame:
    """Unit prices from lagged amounts and volumes over the months both blocks have.

    ``pairs`` goes from output name to (amount column, volume column). Without a month at
    which both hold a value the result is empty, which the planner finds by itself: the
    overlap is a one-row subquery, not a driver action.
    """
    overlap = common_keys(volume, amount, [key]).agg(F.count("*").alias("n")).scalar()
    joined = volume.join(amount, key, "inner").where(overlap > 0)
    return joined.select(key, *[unit_price(F.col(a), F.col(v)).alias(n) for n, (a, v) in pairs.items()])


def overlap_info(volume: DataFrame, amount: DataFrame, key: str = PERIOD) -> DataFrame:
    """How many months the two blocks share and the warning that follows from none."""
    shared = common_keys(volume, amount, [key]).agg(F.count("*").alias("overlap_months"))
    return shared.withColumn(
        "warning", F.when(F.col("overlap_months") == 0, "no overlap of volume and amount: no price features")
    )


@dataclass(frozen=True)
class MonthlyInputs:
    """Revisions of the target series, settlement prices, and optional month-grained blocks.

    Blocks hold ``period_month`` once per month and only columns that were observable by the
    end of that month; yearly blocks are keyed by month already.
    """

    revisions: DataFrame
    value: str = "price"
    settlement: DataFrame | None = None
    settlement_category: str = "fuel"
    settlement_value: str = "price"
    settlement_categories: Sequence[str] = ()
    blocks: Mapping[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class MonthlyFeatures:
    """The table, and its side information as small frames that are planned on demand."""

    table: DataFrame
    kept: DataFrame
    baseline_features: list[str]
    inputs: MonthlyInputs
    keys: list[str]

    @property
    def features(self) -> list[str]:
        return self.baseline_features + [c for b in self.inputs.blocks.values() for c in b.columns if c != PERIOD]

    def dedup_log(self) -> DataFrame:
        return dedup_log(self.inputs.revisions, self.keys)

    def canary(self) -> DataFrame:
        return checks.leakage_canary(self.kept, TARGET, self.baseline_features)

    def block_info(self) -> DataFrame:
        return _block_info(self.kept, self.inputs.blocks)


def _merge_blocks(blocks: Sequence[DataFrame]) -> DataFrame:
    """All blocks side by side, one row per month: a union and one aggregation instead of a join each.

    Of a block's rows for a month the last in the order of its values stays, as a whole. A column name
    that two blocks share is an error.
    """
    names = [c for block in blocks for c in block.columns if c != PERIOD]
    if len(set(names)) < len(names):
        raise ValueError(f"blocks share columns: {sorted({c for c in names if names.count(c) > 1})}")
    whole = [
        block.select(PERIOD, F.struct(*[c for c in block.columns if c != PERIOD]).alias(f"_block{i}"))
        for i, block in enumerate(blocks)
    ]
    rows = [f"_block{i}" for i in range(len(blocks))]
    last = union_all(whole).groupBy(PERIOD).agg(*[F.max(r).alias(r) for r in rows])
    return last.select(PERIOD, *[f"{r}.*" for r in rows])


def _join_by_month(base: DataFrame, blocks: Sequence[DataFrame]) -> DataFrame:
    """Left join of blocks made unique on their month; the base keeps its rows and partitioning."""
    return base.join(one_row_per_date(_merge_blocks(blocks), [PERIOD]), PERIOD, "left")


def _block_info(base: DataFrame, blocks: Mapping[str, DataFrame]) -> DataFrame:
    """Per block its range and how many base months it lacks: every block and the base are read once."""
    named = [block.select(F.lit(name).alias("block"), PERIOD) for name, block in blocks.items()]
    # one row per month: the names of the blocks that have it, of which there are few
    months = union_all([base.select(F.lit(None).cast("string").alias("block"), PERIOD), *named]).groupBy(PERIOD).agg(
        F.bool_or(F.col("block").isNull()).alias("_asked"), F.collect_set("block").alias("_in")
    )
    every = F.array(*[F.lit(name) for name in blocks]).cast("array<string>")
    held = months.select("*", F.explode(every).alias("block")).withColumn("_has", F.array_contains("_in", F.col("block")))
    return held.groupBy("block").agg(
        F.min(F.when(F.col("_has"), F.col(PERIOD))).alias("period_min"), F.max(F.when(F.col("_has"), F.col(PERIOD))).alias("period_max"),
        F.count_if(F.col("_asked") & ~F.col("_has")).alias("missing_periods"),
    )


def monthly_feature_table(
    inputs: MonthlyInputs, horizon: int = 1, group: Sequence[str] = ("area",), check: bool = False
) -> MonthlyFeatures:
    """Revisions to features, target and forecast contract, for every series at once.

    The baseline columns decide which rows stay; optional blocks are joined afterwards and
    can neither add nor remove a row. With ``check`` a feature that equals the target stops
    the build.
    """
    keys = [PERIOD, *group]
    value = inputs.value
    current = dedup_revisions(inputs.revisions, keys).select(*keys, value)
    grid = monthly_grid(current, group, PERIOD)
    lags = [LagSpec(value, k, f"{value}_lag_{k}m") for k in MONTHLY_LAGS]
    rolls = [RollSpec(value, n, agg, f"{value}_rolling_{n}m_{agg}") for n, agg in MONTHLY_ROLLS]
    wide = lead_target(
        add_lags_and_rolls(grid, group, PERIOD, lags, rolls), group, PERIOD, value, horizon, TARGET
    ).withColumn(OBSERVED, F.col(value))
    dated = calendar_monthly(wide, PERIOD)
    if inputs.settlement is not None:
        names = {c: f"settlement_unit_price_{c}" for c in inputs.settlement_categories}
        pivoted = pivot_mean(
            inputs.settlement, [PERIOD], inputs.settlement_category, inputs.settlement_value, list(names)
        ).withColumnsRenamed(names)
        dated = _join_by_month(dated, [exogenous_lag(pivoted, list(names.values()))])
    book = {*keys, value, TARGET}
    baseline = [c for c in dated.columns if c not in book]
    kept = checks.drop_warmup(dated, baseline, TARGET)
    table = _join_by_month(kept, list(inputs.blocks.values())) if inputs.blocks else kept
    table = forecast_contract(table, horizon, PERIOD)
    if check:
        checks.assert_no_leakage(table, TARGET, baseline)
    return MonthlyFeatures(table, kept, baseline, inputs, keys)
