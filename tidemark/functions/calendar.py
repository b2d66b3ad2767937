"""Calendar columns and the forecast contract."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUMMER = (6, 7, 8)
WINTER = (12, 1, 2)
SPRING = (3, 4, 5)
AUTUMN = (9, 10, 11)


def _cycle(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(period)
    return F.sin(angle), F.cos(angle)


def calendar_monthly(df: DataFrame, ts: str = "period_month") -> DataFrame:
    t = F.col(ts)
    month = F.month(t)
    sin, cos = _cycle(month, 12)
    summer, winter = month.isin(*SUMMER), month.isin(*WINTER)
    return df.withColumns(
        {
            "year": F.year(t),
            "month": month,
            "quarter": F.quarter(t),
            "is_summer": summer,
            "is_winter": winter,
            "is_peak_season": summer | winter,
            "month_sin": sin,
            "month_cos": cos,
        }
    )


def calendar_hourly(df: DataFrame, ts: str = "interval_end") -> DataFrame:
    """Interval ends carry hours 1 to 24: midnight is the 24th hour."""
    t = F.col(ts)
    month = F.month(t)
    hour = F.when(F.hour(t) == 0, 24).otherwise(F.hour(t))
    weekday = F.weekday(t)
    hour_sin, hour_cos = _cycle(hour, 24)
    dow_sin, dow_cos = _cycle(weekday, 7)
    summer, winter = month.isin(*SUMMER), month.isin(*WINTER)
    season = (
        F.when(month.isin(*SPRING), "spring")
        .when(summer, "summer")
        .when(month.isin(*AUTUMN), "autumn")
        .otherwise("winter")
    )
    return df.withColumns(
        {
            "year": F.year(t),
            "month": month,
            "day": F.dayofmonth(t),
            "hour": hour,
            "day_of_week": weekday,
            "is_weekend": weekday.isin(5, 6),
            "season": season,
            "is_summer": summer,
            "is_winter": winter,
            "is_peak_load_season": summer | winter,
            "hour_sin": hour_sin,
            "hour_cos": hour_cos,
            "dow_sin": dow_sin,
            "dow_cos": dow_cos,
        }
    )


def add_holiday_flag(df: DataFrame, ts: str, holidays: DataFrame, day: str = "holiday_date") -> DataFrame:
    """Whether the timestamp's day is in the holiday dimension.

    The dimension is made distinct by day; the planner broadcasts it by its measured size.
    """
    days = holidays.select(F.col(day).cast("date").alias("_holiday")).distinct()
    return (
        df.join(days, F.col(ts).cast("date") == F.col("_holiday"), "left")
        .withColumn("is_holiday", F.col("_holiday").isNotNull())
        .drop("_holiday")
    )


def forecast_contract(df: DataFrame, horizon: int, period: str = "period_month") -> DataFrame:
    """What was known when: origin, target month, last observable instant, horizon label."""
    if horizon <= 0:
        raise ValueError("horizon must be > 0")
    month_end = F.last_day(F.col(period)).cast("timestamp_ntz")
    return df.withColumns(
        {
            "forecast_origin_month": F.col(period),
            "target_month": F.add_months(F.col(period), horizon),
            "information_cutoff": month_end + F.expr("interval '23:59:59' hour to second"),
            "horizon": F.lit(f"{horizon}M"),
        }
    )
