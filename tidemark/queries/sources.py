"""Sources and sinks on the test tables: what is written is read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.aggregates import pivot_sum
from tidemark.operators.revisions import upsert
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.session import apply_settings, scratch_path
from tidemark.sources import digests, files, payloads, sinks, tables

AREAS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_file(lines):
    """A vendor file carries its header in front of its rows; monthly rows are few."""
    return lines.repartition(1).sortWithinPartitions("part").select("line")


def _csv_of_months(spark, d, label):
    path = scratch_path(spark, label) + ".csv"
    prices = shapes.monthly_price(spark, d).select(
        F.date_format("period_month", "yyyy/MM").alias(" period "), "area", F.col("price").cast("string").alias("price")
    )
    sinks.write_csv_report(prices, path)
    return path


@query(
    "s1_read_delimited",
    with_shapes("M") + " SELECT strftime(period_month, '%Y/%m') AS period, area, price FROM M",
)
def read_delimited(spark, d):
    apply_settings(spark)
    df = files.read_delimited(spark, _csv_of_months(spark, d, "csv"), "csv")
    return df.withColumn("price", F.col("price").cast("double"))


@query(
    "s1_read_delimited_offsets",
    with_shapes("M") + """ SELECT strftime(period_month, '%Y/%m') AS period, area, price FROM M""",
)
def read_delimited_offsets(spark, d):
    """Two rows above the header and a separator row under it, tab-separated, in cp949."""
    apply_settings(spark)
    path = scratch_path(spark, "tsv") + ".tsv"
    body = shapes.monthly_price(spark, d).select(
        F.concat_ws("\t", F.date_format("period_month", "yyyy/MM"), "area", F.col("price").cast("string")).alias("line"),
        F.lit(1).alias("part"),
    )
    head = spark.createDataFrame(
        [("보고서", -4), ("단위: 원", -3), (" period \tarea\tprice", -2), ("---\t---\t---", -1)],
        "line string, part int",
    )
    _one_file(head.unionByName(body)).write.option("sep", "\u0001").option("quote", "").option("encoding", "cp949").csv(path)
    df = files.read_delimited(spark, path, "tsv", encoding="cp949", skip_rows=2, skip_after_header=1)
    return df.withColumn("price", F.col("price").cast("double"))


@query(
    "s2_read_multi_header",
    with_shapes("M")
    + """ SELECT strftime(period_month, '%Y/%m') AS "period|", """
    + ", ".join(f"max(CASE WHEN area = '{a}' THEN price END) AS \"price|{a}\"" for a in AREAS)
    + """, 'x' AS "other|" FROM M GROUP BY 1""",
)
def read_multi_header(spark, d):
    path = scratch_path(spark, "header") + ".csv"
    wide = pivot_sum(shapes.monthly_price(spark, d), ["period_month"], "area", "price", AREAS)
    body = wide.select(
        F.concat_ws(
            ",", F.date_format("period_month", "yyyy/MM"),
            *[F.coalesce(F.col(f"`{a}`").cast("string"), F.lit("")) for a in AREAS], F.lit("x"),
        ).alias("line"),
        F.lit(1).alias("part"),
    )
    head = spark.createDataFrame(
        [("period,price" + "," * len(AREAS) + "other", -2), ("," + ",".join(AREAS) + ",", -1)], "line string, part int"
    )
    _one_file(head.unionByName(body)).write.text(path)
    df = files.read_multi_header(spark, path, header_rows=2, file_format="csv")
    return df.withColumns({f"price|{a}": F.col(f"`price|{a}`").cast("double") for a in AREAS})


def _two_snapshots(spark, d):
    root = scratch_path(spark, "snapshots")
    prices = shapes.monthly_price(spark, d)
    at = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00.000001"))
    sinks.write_snapshot(
        prices.withColumns({"collected_at": at, "source_priority": F.lit(1)}), root, "official", "a"
    )
    later = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00.000002"))
    recent = prices.where("year(period_month) >= 1998").withColumns(
        {"price": F.col("price") + 1, "collected_at": later, "source_file_sha256": F.lit("ff")}
    )
    sinks.write_snapshot(recent, root, "official", "b")
    sinks.write_snapshot(prices.select("period_month", "area", "price"), root, "fallback", "c")
    return root


SNAPSHOT_SQL = with_shapes("M") + """, S AS (
  SELECT area, period_month, price, TIMESTAMP '2024-01-01 00:00:00.000001' AS collected_at, 1 AS source_priority,
    '' AS source_file_sha256, 'official' AS source_id FROM M
  UNION ALL
  SELECT area, period_month, price + 1, TIMESTAMP '2024-01-01 00:00:00.000002', 5, 'ff', 'official'
  FROM M WHERE year(period_month) >= 1998
  UNION ALL
  SELECT area, period_month, price, NULL, 9, '', 'fallback' FROM M)
"""
SNAPSHOT_COLUMNS = ["area", "period_month", "price", "collected_at", "source_priority", "source_file_sha256", "source_id"]


@query("s3_read_snapshots", SNAPSHOT_SQL + " SELECT * FROM S WHERE source_id = 'official'")
def read_snapshots(spark, d):
    df = files.read_snapshots(spark, _two_snapshots(spark, d), "official", default_priority=5)
    return df.select(*SNAPSHOT_COLUMNS)


@query("s4_read_sources", SNAPSHOT_SQL + " SELECT * FROM S")
def read_sources(spark, d):
    df = files.read_sources(spark, _two_snapshots(spark, d), {"official": 5, "fallback": 9, "absent": 99})
    return df.select(*SNAPSHOT_COLUMNS)


@query(
    "s5_explode_json_items",
    """SELECT event_id, json_extract_string(props, '$.k') AS k FROM events
UNION ALL SELECT event_id, json_extract_string(props, '$.k') FROM events WHERE event_id % 7 IN (0, 1, 2)""",
)
def explode_json_items(spark, d):
    payload = F.expr(
        """CASE event_id % 7
        WHEN 0 THEN concat('{"response":{"header":{"resultCode":"00"},"body":{"items":{"item":[', props, ',', props, ']},"totalCount":2}}}')
        WHEN 1 THEN concat('{"items":[', props, ',', props, ']}')
        WHEN 2 THEN concat('[', props, ',', props, ']')
        WHEN 3 THEN concat('{"response":{"body":{"items":{"item":', props, '}}}}')
        WHEN 4 THEN concat('{"response":{"total":"1","data":[', props, ']}}')
        WHEN 5 THEN concat('{"items":{"item":', props, '}}')
        ELSE concat('{"data":[', props, ']}') END"""
    )
    events = read_table(spark, d, "events").select("event_id", payload.alias("payload"))
    rows = payloads.explode_json_items(events, "payload")
    return rows.select("event_id", F.try_element_at("record", F.lit("k")).alias("k"))


@query(
    "s6_parse_xml_items",
    """SELECT o_orderkey, o_orderpriority AS area, o_totalprice AS price FROM orders
UNION ALL SELECT o_orderkey, 'total', o_totalprice FROM orders""",
)
def parse_xml_items(spark, d):
    payload = F.expr(
        "concat('<response><body><items><item><area>', o_orderpriority, '</area><price>', o_totalprice, "
        "'</price></item><item><area>total</area><price>', o_totalprice, '</price></item></items></body></response>')"
    )
    orders = read_table(spark, d, "orders").select("o_orderkey", payload.alias("payload"))
    rows = payloads.parse_xml_items(orders, "payload", "area: string, price: double")
    return rows.select("o_orderkey", "record.area", "record.price")


@query("s7_write_snapshot", with_shapes("M") + " SELECT area, period_month, price, (SELECT max(period_month) FROM M) AS event_date FROM M")
def write_snapshot(spark, d):
    root = scratch_path(spark, "snapshot")
    prices = shapes.monthly_price(spark, d)
    path = sinks.write_snapshot(prices, root, "monthly", "20240101T000000_000001_ab12")
    return spark.read.parquet(path).select("area", "period_month", "price", "event_date")


def run_log_rows(spark, d):
    items = read_table(spark, d, "lineitem")
    per_flag = items.groupBy(F.concat(F.lit("source_"), "l_returnflag").alias("source_id"), "l_linestatus").agg(
        F.count("*").alias("rows"), F.count_if(F.col("l_discount") == 0).alias("zeros"), F.max("l_shipdate").alias("last")
    )
    return per_flag.select(
        "source_id",
        F.col("last").alias("started_at"),
        F.col("last").alias("collected_at"),
        F.concat(F.lit("file_"), "l_linestatus").alias("source_file"),
        F.lit("ok").alias("status"),
        "rows",
        F.lit("MWh").alias("unit"),
        F.array(F.lit("sample")).alias("limitations"),
        F.array(F.lit("sub_b"), F.lit("sub_a")).alias("dropped_columns"),
        F.array().cast("array<string>").alias("missing_categories"),
        F.create_map(F.col("l_linestatus"), F.col("zeros")).alias("zero_rows"),
    )


@query(
    "s8_append_run_log",
    """SELECT 'source_' || l_returnflag AS source_id, max(l_shipdate) AS collected_at, 'file_' || l_linestatus AS source_file,
  count(*) AS rows, count(*) FILTER (l_discount = 0) AS zero_rows, 'sub_b,sub_a' AS dropped
FROM lineitem GROUP BY l_returnflag, l_linestatus""",
)
def append_run_log(spark, d):
    path = scratch_path(spark, "runs")
    runs = run_log_rows(spark, d)
    sinks.append_run_log(runs.where("source_file = 'file_F'"), path)
    sinks.append_run_log(runs.where("source_file <> 'file_F'"), path)
    return sinks.read_run_log(spark, path).select(
        "source_id", "collected_at", "source_file", "rows",
        F.element_at(F.map_values("zero_rows"), 1).alias("zero_rows"),
        F.concat_ws(",", "dropped_columns").alias("dropped"),
    )


@query("s9_write_csv_report", with_shapes("M") + " SELECT * FROM M")
def write_csv_report(spark, d):
    path = scratch_path(spark, "report_csv")
    sinks.write_csv_report(shapes.monthly_price(spark, d), path)
    return spark.read.schema("area string, period_month date, price double").csv(path, header=True)


@query("s10_write_json_report", with_shapes("M") + " SELECT * FROM M")
def write_json_report(spark, d):
    path = scratch_path(spark, "report_json")
    sinks.write_json_report(shapes.monthly_price(spark, d), path)
    return spark.read.schema("area string, period_month date, price double").json(path)


@query(
    "s11_upsert",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0""",
)
def upsert_orders(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    fifth = orders.where("o_orderkey % 5 = 0")
    incoming = fifth.withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(
        fifth.withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)
    )
    return upsert(orders, incoming, ["o_orderkey"])


@query(
    "s11_upsert_committed",
    """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN -1.0 WHEN o_orderkey % 5 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 = 0""",
)
def upsert_committed(spark, d):
    """The table in a folder: loaded, changed twice, and the first change sent again."""
    root = scratch_path(spark, "orders_table")
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    tables.create_table(spark, root, orders.schema, ["o_orderkey"], buckets=16)
    fifth = orders.where("o_orderkey % 5 = 0")
    changes = [
        orders,
        fifth.withColumn("o_totalprice", F.col("o_totalprice") + 1).unionByName(fifth.withColumn("o_orderkey", F.col("o_orderkey") + 1000000000)),
        orders.where("o_orderkey % 7 = 0").withColumn("o_totalprice", F.lit(-1.0)),
    ]
    for n, change in [*enumerate(changes), (1, changes[1])]:
        tables.upsert_table(change, root, ("orders", n))
    return tables.read_table(spark, root)


@query("s12_fingerprints", "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS bytes FROM documents")
def fingerprints(spark, d):
    return read_table(spark, d, "documents").select(
        "doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("bytes")
    )


@query(
    "s12_file_fingerprints",
    """SELECT CAST((doc_id * 2654435761) % 64 AS INTEGER) AS part, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS bytes,
  sha256(string_agg(coalesce(text, '') || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""",
)
def file_fingerprints(spark, d):
    """All documents in 64 text files by a hash of their id."""
    path = scratch_path(spark, "texts")
    part = (F.col("doc_id") * 2654435761 % 64).cast("int")
    texts = read_table(spark, d, "documents").select(part.alias("part"), "doc_id", F.coalesce("text", F.lit("")).alias("value"))
    placed = texts.repartition("part").sortWithinPartitions("part", "doc_id")
    placed.select("part", "value").write.partitionBy("part").text(path)
    found = digests.file_fingerprints(spark, path, ("txt",))
    return found.select(F.regexp_extract("path", "part=([0-9]+)", 1).cast("int").alias("part"), "bytes", "sha256")


@query(
    "s13_quarantine_manifest",
    """SELECT 'pages' AS source_id, 'pending_schema_verification' AS status, 'filename_content_mismatch' AS reason,
  url AS original_path, sha256(html) AS sha256, 'checked by hand' AS notes FROM pages
WHERE regexp_matches(url, '^.*/fr/.*$') OR regexp_matches(url, '^https://m\\..*[#]top$')""",
)
def quarantine_manifest(spark, d):
    pages = read_table(spark, d, "pages").select("url", F.sha2("html", 256).alias("sha256"))
    held = files.quarantine_manifest(
        pages, ["*/fr/*", "https://m.*[#]top"], "pages", "filename_content_mismatch", ["checked by hand"],
        name="url", path="url",
    )
    return held.withColumn("notes", F.concat_ws(",", "notes"))


@query(
    "s14_archive_payload",
    """SELECT 'events' AS source_id, strftime(ts, '%Y%m%dT%H%M%SZ__%f') || '_' || left(sha256(CASE WHEN event_type = 'error' THEN '' ELSE props END), 8) AS payload_id,
  ts AS collected_at, CAST(ts AS DATE) AS event_date, 'user=' || user_id AS request,
  CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_type = 'error' THEN NULL ELSE props END AS payload FROM events""",
)
def archive_payload(spark, d):
    path = scratch_path(spark, "bronze")
    failed = F.col("event_type") == "error"
    events = read_table(spark, d, "events").withColumn("payload", F.when(~failed, F.col("props")))
    rows = payloads.archive_rows(
        events, "payload", "events", F.concat(F.lit("user="), F.col("user_id").cast("string")),
        F.when(failed, 500).otherwise(200), F.col("ts"),
    )
    sinks.append_archive(rows, path)
    return spark.read.parquet(path)


@query(
    "s15_payload_schema_profile",
    "SELECT 'OBJECT<k: BIGINT>' AS schema, count(props) AS parsed, count(*) AS payloads FROM events",
)
def payload_schema(spark, d):
    return payloads.payload_schema(read_table(spark, d, "events"), "props")


@query(
    "s15_payload_key_profile",
    """SELECT * FROM (VALUES ('body', 'object'), ('body.items', 'list'), ('body.items.k', 'number'), ('code', 'text')) v(path, kind),
(SELECT count(*) AS payloads FROM events)""",
)
def payload_key_profile(spark, d):
    payload = F.expr("""concat('{"code":"ok","body":{"items":[', props, ']}}')""")
    return payloads.payload_key_profile(read_table(spark, d, "events").select(payload.alias("payload")), "payload")
