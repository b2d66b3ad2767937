"""Exact quantiles in two scans, for groups of any size.

The built-in exact percentile keeps every distinct value of a group in one aggregation
buffer. Here a mergeable sketch first brackets every wanted rank between two values; a second
scan counts what lies below each bracket and the equal values inside it, with map-side sums. Only the
brackets, a few ten-thousandths of a large group, are then ordered. Both scans are parts of one lazy plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: the sketch is off by at most one rank in so many
ACCURACY = 10_000


def _brackets(rows: DataFrame, value: str, probs: Sequence[float], accuracy: int) -> DataFrame:
    """Per group its size and, for each probability, two values between which its ranks lie."""
    # one share for the sketch's error, one for the rank beside the wanted one, one to spare
    margin = 3.0 / accuracy
    asked = [min(max(p + side * margin, 0.0), 1.0) for p in probs for side in (-1, 1)]
    sketch = F.percentile_approx(value, F.array(*[F.lit(a) for a in asked]), accuracy)
    found = rows.groupBy("_group").agg(
        F.count(F.lit(1)).alias("_total"), F.min(value).alias("_min"), F.max(value).alias("_max"), sketch.alias("_cuts")
    )
    # of a small group the ranks beside each other are further apart than the margin: all of it is kept
    small = F.col("_total") < 4 * accuracy
    ends = [
        F.struct(
            F.when(small | F.lit(asked[2 * i] == 0.0), F.col("_min")).otherwise(F.get("_cuts", F.lit(2 * i))).alias("lo"),
            F.when(small | F.lit(asked[2 * i + 1] == 1.0), F.col("_max")).otherwise(F.get("_cuts", F.lit(2 * i + 1))).alias("hi"),
        )
        for i in range(len(probs))
    ]
    return found.select(F.col("_group").alias("_of"), "_total", F.array(*ends).alias("_ends"))


def exact_quantiles(
    df: DataFrame, by: Sequence[str], value: str, probs: Sequence[float], accuracy: int = ACCURACY
) -> DataFrame:
    """Linearly interpolated quantiles: ``by`` columns, ``prob``, ``quantile``.

    Nulls do not count; a group without values is absent, and null keys are a group. The result is the same
    for any ``accuracy`` of the sketch.
    """
    probs = list(dict.fromkeys(float(p) for p in probs))
    group = F.struct(*by, F.lit(0).alias("_"))
    rows = df.where(F.col(value).isNotNull()).select(group.alias("_group"), F.col(value).cast("double").alias("_value"))
    brackets = _brackets(rows, "_value", probs, accuracy)
    # below a bracket only the number counts; beyond it nothing does
    x = F.col("_value")
    places = [
        F.when(x < F.get("_ends", F.lit(i))["lo"], F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("v")))
        .when(x <= F.get("_ends", F.lit(i))["hi"], F.struct(F.lit(i).alias("i"), x.alias("v")))
        for i in range(len(probs))
    ]
    placed = rows.join(brackets, F.col("_group") == F.col("_of")).select("_group", "_total", F.explode(F.array_compact(F.array(*places))).alias("_p"))
    counted = placed.groupBy("_group", "_total", F.col("_p.i").alias("_i"), F.col("_p.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_group", "_i").orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    prob = F.element_at(F.array(*[F.lit(p) for p in probs]), F.col("_i") + 1)
    ranked = counted.withColumns({"_upto": F.sum("_n").over(upto), "prob": prob}).withColumn("_pos", (F.col("_total") - 1) * F.col("prob"))

    def at(rank):
        return F.max(F.when((rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_n")), F.col("_v")))

    low, high = at(F.floor("_pos")), at(F.ceil("_pos"))
    share = F.max(F.col("_pos") - F.floor("_pos"))
    settled = ranked.groupBy("_group", "prob").agg(low.alias("_low"), high.alias("_high"), share.alias("_share"))
    missed = F.col("_low").isNull() | F.col("_high").isNull()
    quantile = F.when(missed, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double")).when(
        F.col("_low") == F.col("_high"), F.col("_low")
    ).otherwise(F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share"))
    return settled.select(*[F.col(f"_group.{c}").alias(c) for c in by], "prob", quantile.alias("quantile"))


def medians(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of each column per group: ``by``, ``feature``, ``median``."""
    long = df.select(*by, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        list(by), list(columns), "feature", "_value"
    )
    return exact_quantiles(long, [*by, "feature"], "_value", [0.5]).select(
        *by, "feature", F.col("quantile").alias("median")
    )
