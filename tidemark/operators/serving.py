"""Tables a service reads: the next forecast, the chosen model, hourly profiles, the registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.models import Ridge, gram_stats, linear_prediction, ridge_from_stats
from tidemark.operators.revisions import keep_last
from tidemark.operators.scores import LATEST
from tidemark.sources.sinks import append_table


def next_forecast(
    panel: DataFrame, group: Sequence[str], spec: Ridge, target: str, observed: str, horizon: int = 1,
    period: str = "period_month",
) -> DataFrame:
    """Forecast of each series' newest complete row, by a model fitted on its labelled rows."""
    columns = list(dict.fromkeys([*spec.features, *([spec.delta_from] if spec.delta_from else [])]))
    fitted = ridge_from_stats(gram_stats(panel, group, [*columns, target]), {"m": spec}, columns, target)
    newest = keep_last(panel.na.drop(subset=columns), group, [period])
    scored = newest.join(fitted.select(*group, "coef_m", "mid_m"), list(group))
    return scored.select(
        *group,
        F.col(period).alias("forecast_origin_month"),
        F.add_months(F.col(period), horizon).alias("target_month"),
        F.round(linear_prediction("m", spec), 3).alias("predicted"),
        F.round(F.col(observed), 3).alias("most_recent_actual"),
    )


def pick_model(df: DataFrame, usable: DataFrame, metric: str = "mae", key: Sequence[str] = ("version", "model")) -> DataFrame:
    """The best usable latest candidate, else the best usable historical cell."""
    tier = F.when(F.col("registry_status") == LATEST, 0).otherwise(1)
    return (
        df.where(~F.col("skipped") & F.col(metric).isNotNull())
        .join(usable.select(*key), list(key), "left_semi")
        .withColumn("tier", tier)
        .orderBy("tier", metric, *key)
        .limit(1)
    )


# fixed values: solar capacity factor by hour of day, and how it shapes the price
SOLAR_CF = (
    0.00, 0.00, 0.00, 0.00, 0.00, 0.00, 0.05, 0.15, 0.30, 0.45, 0.52, 0.55,
    0.55, 0.52, 0.45, 0.35, 0.20, 0.05, 0.00, 0.00, 0.00, 0.00, 0.00, 0.00,
)
SOLAR_ALPHA = 0.45
SURGE_HOURS = (17, 18, 19, 20, 21)
SURGE = 1.25


# fixed values: band labels by part of the day
BAND_DAYTIME = "주간 저가 (태양광 흡수)"
BAND_EVENING = "저녁 피크"
BAND_NIGHT = "야간/심야"
BAND_BETWEEN = "이행기"


#: first and last hour of each part of the day; the bands tile it
BANDS = (
    (0, 5, BAND_NIGHT), (6, 8, BAND_BETWEEN), (9, 15, BAND_DAYTIME), (16, 16, BAND_BETWEEN),
    (17, 21, BAND_EVENING), (22, 23, BAND_NIGHT),
)


def hourly_profile(monthly: DataFrame, value: str) -> DataFrame:
    """24 rows per monthly value: a typical day whose mean is the monthly value."""
    raw = [(SURGE if h in SURGE_HOURS else 1.0) / (1.0 + SOLAR_ALPHA * cf) for h, cf in enumerate(SOLAR_CF)]
    mean = sum(raw) / len(raw)
    hours = F.array(
        *[
            F.struct(
                F.lit(h).alias("hour"),
                F.lit(cf).alias("solar_capacity_factor"),
                F.lit(raw[h] / mean).alias("multiplier"),
                F.lit(next(label for first, last, label in BANDS if first <= h <= last)).alias("band"),
            )
            for h, cf in enumerate(SOLAR_CF)
        ]
    )
    return monthly.select("*", F.inline(hours)).withColumn("predicted", F.col(value) * F.col("multiplier"))


def append_registry(records: DataFrame, path: str) -> None:
    """Add version records; nothing is ever rewritten or promoted here."""
    append_table(records, path)


def registry_history(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """All records, or those of one model."""
    df = spark.read.parquet(path)
    return df if model is None else df.where(F.col("model") == model)


def registry_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("model").agg(F.count("*").alias("records"))
