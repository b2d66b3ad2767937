"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialise


def _state(edges: DataFrame) -> tuple:
    """Number and order-free digest of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, component``: the smallest node that edges (``a``, ``b``) lead to, for every node of an edge.

    Each round links the neighbours of a node to the smallest of them, first upwards, then downwards; edges
    never grow in number, and long chains shrink geometrically. A round's edges are written to the
    shared folder, so lineage stays short. Nothing but two numbers a round comes to the driver. Null
    ends and loops are ignored; no edges give an empty result.
    """
    pairs = edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    current = materialise(
        pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "components"
    )
    before = None
    while (state := _state(current)) != before and state[0]:
        before = state
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = materialise(small, "components")
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches over the links (a, b) of one task."""
    label = np.arange(n)
    while len(a) and (label[a] != label[b]).any():
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        jumped = label[label]
        while (jumped != label).any():
            label, jumped = jumped, jumped[jumped]
    return label
