"""Sorting, limits and set operations on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import sets as s
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.sources.files import union_all


@query(
    "o1_sort_mixed",
    with_shapes("SNAP")
    + " SELECT period_month, area, source_priority, collected_at, parsed_path FROM SNAP",
)
def sort_mixed(spark, d):
    snap = shapes.revisions(spark, d).select("period_month", "area", "source_priority", "collected_at", "parsed_path")
    keys = ["period_month", "area", "source_priority", "collected_at", "parsed_path"]
    return s.sort_mixed(snap, keys, [True, True, True, False, True])


@query(
    "o2_latest_rows",
    with_shapes("M") + " SELECT * FROM M ORDER BY period_month DESC, area LIMIT 12",
)
def latest_rows(spark, d):
    return s.latest_rows(shapes.monthly_price(spark, d), "period_month", 12, ["area"])


@query(
    "o3_union_all",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS o_totalprice FROM orders",
)
def union_halves(spark, d):
    orders = read_table(spark, d, "orders")
    even = orders.where("o_orderkey % 2 = 0").select("o_orderkey", "o_totalprice")
    odd = orders.where("o_orderkey % 2 = 1").select("o_orderkey")
    return union_all([even, odd])


@query(
    "o4_intersect_keys",
    """SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month FROM orders
INTERSECT SELECT CAST(date_trunc('month', l_shipdate) AS DATE) FROM lineitem""",
)
def intersect_keys(spark, d):
    a = read_table(spark, d, "orders").select(shapes.month_of("o_orderdate").alias("period_month"))
    b = read_table(spark, d, "lineitem").select(shapes.month_of("l_shipdate").alias("period_month"))
    return s.intersect_keys(a, b)


@query(
    "o5_except_keys",
    """SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period_month FROM lineitem
EXCEPT SELECT CAST(date_trunc('month', o_orderdate) AS DATE) FROM orders""",
)
def except_keys(spark, d):
    a = read_table(spark, d, "orders").select(shapes.month_of("o_orderdate").alias("period_month"))
    b = read_table(spark, d, "lineitem").select(shapes.month_of("l_shipdate").alias("period_month"))
    return s.except_keys(b, a)
