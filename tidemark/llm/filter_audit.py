"""What each filter removes under every order of the filters, by intervals of permutation ranks."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import collapsed, materialise

#: fails when the text equals that of a smaller id; the other filters look at one text alone
COPY = "E"


def text_conditions(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of one (non-null) text; words are maximal ``[^\\x20\\x09-\\x0D]+``."""
    flat = F.trim(collapsed(text))
    words = F.when(flat == "", F.array().cast("array<string>")).otherwise(F.split(flat, " "))
    capitals = F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * capitals.cast("long") > 2 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def removal_intervals(filters: int) -> list[tuple[int, int, int, int]]:
    """``(mask, first, end, step)``: masks are removed at ``step`` in the orders of rank ``first`` to ``end`` - 1.

    Orders are ranked lexicographically. Those that begin with the same k filters are neighbours,
    (filters - k)! of them, and the Lehmer digits of the beginning say where they start. A mask is
    removed at step k where k - 1 filters that it passes are followed by one that it fails.
    """
    out = []
    for mask in range(1, 1 << filters):
        passed = [f for f in range(filters) if not mask >> f & 1]
        for k in range(len(passed) + 1):
            for head in permutations(passed, k):
                for last in (f for f in range(filters) if mask >> f & 1):
                    prefix = (*head, last)
                    first = sum(
                        (f - sum(g < f for g in prefix[:i])) * factorial(filters - 1 - i) for i, f in enumerate(prefix)
                    )
                    out.append((mask, first, first + factorial(filters - k - 1), k + 1))
    return out


def failure_masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail (bit 0 is A, bit 4 is E).

    Only a digest of the text travels. Equal texts have equal bits A to D, so of each text and part
    just counts are kept, next to the smallest id and the number of its rows; whether that id is the
    smallest of the text in all parts is settled among those few rows. A text with any number of
    copies is counted before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(text_conditions(text).values())), F.lit(0))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        bits.alias("bits"), F.unhex(F.sha2(text, 256)).alias("digest"),
    )
    marks = labels.groupBy("doc_id").agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    marked = rows.join(marks, "doc_id", "left").fillna(0, ["good", "toxic"])
    ids = marked.groupBy("digest", "doc_id", "part", "bits", "good", "toxic").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("doc_id").isNotNull()
    texts = ids.groupBy("digest", "part", "bits", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(~known, F.col("n")).otherwise(F.lit(0))).alias("no_id"),
        F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"),
    )
    # a text has at most a row per part, and four per mix of labels
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    stay = F.col("no_id") + F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(F.lit(0))
    split = texts.withColumn("stay", stay).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("bits").alias("mask"), F.col("stay").alias("n")),
            F.struct(F.col("bits").bitwiseOR(1 << 4).alias("mask"), (F.col("n") - F.col("stay")).alias("n")),
        )).alias("_m"),
    ).select("part", "_m.mask", "_m.n", (F.col("_m.n") * F.col("good")).alias("good"), (F.col("_m.n") * F.col("toxic")).alias("toxic"))
    return split.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("n", "good", "toxic")])


def order_effects(masks: DataFrame, letters: str) -> DataFrame:
    """One row per part, order of the filters and step, from counts of failure masks.

    A mask is removed at one step in whole intervals of order ranks: its counts are added where an
    interval starts and subtracted where it ends, and sums along the ranks give all orders at once.
    ``masks`` has at most a row per part and mask; the grid has 120 x 5 rows per part for five letters.
    """
    spark, filters = masks.sparkSession, len(letters)
    orders = ["".join(o) for o in permutations(letters)]
    intervals = spark.createDataFrame(removal_intervals(filters), "mask int, first int, stop int, step int")
    counts = ("n", "good", "toxic")
    edges = masks.join(F.broadcast(intervals), "mask").select(
        "part", "step",
        F.explode(F.array(
            F.struct(F.col("first").alias("rank"), *counts), F.struct(F.col("stop").alias("rank"), *[(-F.col(c)).alias(c) for c in counts])
        )).alias("_e"),
    ).select("part", "step", "_e.*").filter(F.col("rank") < len(orders))
    fails = [F.sum(F.when(F.col("mask").bitwiseAND(1 << i) != 0, F.col("n")).otherwise(F.lit(0))) for i in range(filters)]
    alone = [F.sum(F.when(F.col("mask") == 1 << i, F.col("n")).otherwise(F.lit(0))) for i in range(filters)]
    parts = masks.groupBy("part").agg(F.sum("n").alias("total"), F.array(*fails).alias("fails"), F.array(*alone).alias("alone"))
    grid = parts.select(
        "part", F.explode(F.sequence(F.lit(1), F.lit(filters))).alias("step"), *[F.lit(0).cast("long").alias(c) for c in counts]
    ).select("part", "step", F.explode(F.sequence(F.lit(0), F.lit(len(orders) - 1))).alias("rank"), *counts)
    summed = edges.unionByName(grid).groupBy("part", "step", "rank").agg(*[F.sum(c).alias(c) for c in counts])
    along = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    removed = summed.select("part", "step", "rank", *[F.sum(c).over(along).alias(c) for c in counts])
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    names = removed.withColumn("filter_order", F.element_at(F.array(*[F.lit(o) for o in orders]), F.col("rank") + 1))
    lettered = names.withColumn("at", F.instr(F.lit(letters), F.substring("filter_order", F.col("step"), F.lit(1))))
    total = F.sum("n").over(Window.partitionBy("part", "at"))
    return (
        lettered.withColumns({"gone": F.sum("n").over(steps), "shapley": total})
        .join(parts, "part")
        .select(
            "part", "filter_order", F.col("step").cast("int").alias("step"),
            (F.col("total") - F.col("gone")).alias("kept"), F.col("n").alias("removed"),
            (F.element_at("fails", F.col("at")) - F.col("n")).alias("redundant"),
            F.element_at("alone", F.col("at")).alias("unique_fails"),
            F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
        )
    )


def audit_filters(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  part_col: str = "source") -> DataFrame:
    """How five filters overlap, for every part, order and step (zeros included).

    A: under 200 words, B: few distinct words, C: many capitals, D: one of ``#$%&*|``, E: the text of
    a smaller id, anywhere in the table. Null texts are empty and fail A (and E, but for the first);
    a null part is the empty string. Rows repeated under one id count each, and none of them is a
    smaller id of the other. A null id is no smaller id and has none. An id with several labels is good or toxic
    if one of them says so; null labels say nothing. Empty tables give no rows. Other columns are ignored.
    """
    # a few rows per part; written once, as both uses below would read all texts again
    masks = materialise(failure_masks(docs, labels, id_col, text_col, part_col), "masks")
    return order_effects(masks, "ABCD" + COPY)
