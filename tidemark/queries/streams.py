"""Streaming jobs, run to the end of the available data and compared with the batch result."""

from __future__ import annotations

from tidemark.operators.checks import assert_unique
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.queries.windows import RANKED
from tidemark.session import scratch_path
from tidemark.sources.spec import Category, Period, SourceSpec
from tidemark.streaming.current import current_view, follow_revisions
from tidemark.streaming.inbox import ingest_inbox

ORDER_SPEC = SourceSpec(
    source_id="orders_inbox",
    schema="source_id string, order_id bigint, trade_date date, area string, price double, source_file string",
    mapping={"order_id": "o_orderkey", "trade_date": "o_orderdate", "area_raw": "o_orderpriority", "price": "o_totalprice"},
    period=Period("day", ("trade_date",), "%Y-%m-%d %H:%M:%S", out="trade_date"),
    measures=("price",),
    category=Category(("area_raw",), "area", {"1-URGENT": "mainland", "2-HIGH": "jeju", "3-MEDIUM": "integrated"}),
    required=("price",),
)


@query(
    "g1_ingest_inbox",
    """SELECT 'orders_inbox' AS source_id, o_orderkey AS order_id, CAST(o_orderdate AS DATE) AS trade_date,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'mainland' WHEN '2-HIGH' THEN 'jeju' ELSE 'integrated' END AS area,
  o_totalprice AS price, 'orders.parquet' AS source_file
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def ingest(spark, d):
    table, checkpoint = scratch_path(spark, "inbox_table"), scratch_path(spark, "inbox_state")
    schema = read_table(spark, d, "orders").schema
    for _ in range(2):
        # the second run finds nothing new
        ingest_inbox(
            spark, ORDER_SPEC, d, table, checkpoint, schema, "parquet", "orders.parquet"
        ).awaitTermination()
    loaded = spark.read.parquet(table).drop("batch_id")
    assert_unique(loaded, ["order_id"], "orders")
    return loaded


@query(
    "g2_current_view",
    with_shapes("SNAP") + RANKED + " SELECT * EXCLUDE (rn) FROM R WHERE rn = 1",
)
def current(spark, d):
    inbox, table = scratch_path(spark, "revisions_inbox"), scratch_path(spark, "revisions_table")
    state = scratch_path(spark, "revisions_state")
    snap = shapes.revisions(spark, d)
    keys = ["period_month", "area"]
    newer = "collected_at >= timestamp_ntz'1998-06-01 00:00:00'"
    # the newer half arrives first, then the older one as late revisions
    for part in (newer, f"NOT ({newer})"):
        snap.where(part).write.mode("append").parquet(inbox)
        follow_revisions(spark, inbox, snap.schema, keys, table, state).awaitTermination()
    return current_view(spark, table)
