"""Projection, cleaning and canonicalisation on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import parsing as p
from tidemark.operators import cleaning as c
from tidemark.operators.aggregates import pivot_sum
from tidemark.plans import shapes
from tidemark.plans.shapes import read_table, with_shapes
from tidemark.queries.registry import query
from tidemark.queries.scalars import FUELS, MONTHLY_FUEL, monthly_fuel
from tidemark.sources.spec import Category, Melt, Period, SourceSpec, conform_source

COLLECTED = "2024-01-02 03:04:05.000006"


@query(
    "p1_apply_mapping",
    "SELECT o_orderkey AS id, o_orderpriority AS area, o_totalprice AS price, o_custkey FROM orders",
)
def apply_mapping(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey")
    return c.apply_mapping(orders, {"id": "o_orderkey", "area": "o_orderpriority", "price": "o_totalprice"})


@query(
    "p2_coerce_numeric",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber <> 6 THEN l_quantity END AS quantity FROM lineitem""",
)
def coerce_numeric(spark, d):
    text = read_table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.when(F.col("l_linenumber") == 7, "n/a").otherwise(F.format_number("l_extendedprice", 2)).alias("price"),
        F.when(F.col("l_linenumber") == 6, "12d").otherwise(F.col("l_quantity").cast("string")).alias("quantity"),
    )
    return c.coerce_numeric(text, ["price", "quantity", "not_there"])


@query(
    "p3_coerce_percent",
    "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 5 THEN round(l_discount * 100) END AS change_pct FROM lineitem",
)
def coerce_percent(spark, d):
    text = F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("%"))
    rows = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 5, "-").otherwise(text).alias("change_pct")
    )
    return c.coerce_percent(rows, "change_pct")


@query(
    "p4_to_month",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month FROM orders WHERE o_orderkey % 97 <> 0",
)
def to_month(spark, d):
    text = F.when(F.col("o_orderkey") % 97 == 0, "total").otherwise(F.date_format("o_orderdate", "yyyy/MM"))
    rows = read_table(spark, d, "orders").select("o_orderkey", p.to_month(text, "%Y/%m").alias("period_month"))
    return rows.where(F.col("period_month").isNotNull())


@query(
    "p4_to_month_strict",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_month FROM orders",
)
def to_month_strict(spark, d):
    text = F.date_format("o_orderdate", "yyyy-MM")
    return read_table(spark, d, "orders").select(
        "o_orderkey", p.to_month(text, "%Y-%m", strict=True).alias("period_month")
    )


@query(
    "p5_month_from_parts",
    """SELECT o_orderkey, make_date(CAST(year(o_orderdate) AS INTEGER), CAST(month(o_orderdate) AS INTEGER), 1) AS period_month
FROM orders WHERE o_orderkey % 11 <> 0""",
)
def month_from_parts(spark, d):
    year = F.when(F.col("o_orderkey") % 11 != 0, F.date_format("o_orderdate", "yyyy"))
    parts = c.coerce_numeric(
        read_table(spark, d, "orders").select(
            "o_orderkey", year.alias("y"), F.date_format("o_orderdate", "M").alias("m")
        ),
        ["y", "m"],
    )
    return c.drop_missing(parts, ["y", "m"]).select(
        "o_orderkey", p.month_from_parts(F.col("y"), F.col("m")).alias("period_month")
    )


@query(
    "p6_to_trade_date",
    "SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS trade_date FROM lineitem WHERE l_linenumber <> 4",
)
def to_trade_date(spark, d):
    text = F.when(F.col("l_linenumber") == 4, "02/30/1999").otherwise(
        F.concat(F.lit("  "), F.date_format("l_shipdate", "MM/dd/yyyy"), F.lit(" "))
    )
    rows = read_table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", p.to_trade_date(text, "%m/%d/%Y").alias("trade_date")
    )
    return rows.where(F.col("trade_date").isNotNull())


@query(
    "p7_period_from_filename",
    """SELECT page_id, CAST(nullif(regexp_extract(url, '/(\\d{3,4})', 1), '') AS INTEGER) AS period_year FROM pages""",
)
def period_from_filename(spark, d):
    pages = read_table(spark, d, "pages")
    return pages.select("page_id", p.from_filename(F.col("url"), r"/(\d{3,4})", strict=False).cast("int").alias("period_year"))


TYPE_MAP = {"ECONOMY": "coal", "LARGE": "nuclear", "PROMO": "lng", "SMALL": "oil"}


def _case(column: str, mapping: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + " END"


@query(
    "p8_map_category",
    f"SELECT p_partkey, {_case('p_type', TYPE_MAP)} AS fuel_type FROM part WHERE {_case('p_type', TYPE_MAP)} IS NOT NULL",
)
def map_category(spark, d):
    raw = read_table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), "p_type", F.lit(" ")).alias("raw"))
    return c.map_category(raw, "raw", TYPE_MAP, "fuel_type").drop("raw")


HIER_MAP = {"ECONOMY|Brand#1": "steam_a", "ECONOMY": "steam", "LARGE|Brand#2": "combined_b", "PROMO": "other"}


@query(
    "p9_map_category_hier",
    f"""SELECT p_partkey, coalesce({_case("p_type || '|' || p_brand", HIER_MAP)}, {_case('p_type', HIER_MAP)}) AS kind
FROM part""",
)
def map_category_hier(spark, d):
    part = read_table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return c.map_category_hier(part, "p_type", "p_brand", HIER_MAP, "kind").select("p_partkey", "kind")


WIDE = "," + """ WIDE AS (SELECT period_month, """ + ", ".join(
    f"max(CASE WHEN fuel = '{f}' THEN volume END) AS \"{f}\"" for f in FUELS
) + " FROM MF GROUP BY 1)"


@query(
    "p10_melt",
    with_shapes("FUEL") + MONTHLY_FUEL + WIDE + """ SELECT w.period_month, f.fuel, m.volume
FROM WIDE w CROSS JOIN (SELECT unnest(['""" + "','".join(FUELS) + """']) AS fuel) f
LEFT JOIN MF m ON m.period_month = w.period_month AND m.fuel = f.fuel""",
)
def melt(spark, d):
    wide = pivot_sum(monthly_fuel(spark, d), ["period_month"], "fuel", "volume", FUELS)
    return c.melt(wide, ["period_month"], FUELS, "fuel", "volume")


#: nested headers of all fuels
HEADERS = {
    "ECONOMY": "thermal|coal", "LARGE": "nuclear", "MEDIUM": "renewable|hydro", "PROMO": "thermal|gas|peak",
    "SMALL": "renewable|solar", "STANDARD": "thermal|oil",
}


@query(
    "p11_melt_hier",
    with_shapes("FUEL") + MONTHLY_FUEL + """ SELECT m.period_month, split_part(f.name, '|', 1) AS level1,
  CASE WHEN position('|' IN f.name) = 0 THEN '' ELSE substr(f.name, position('|' IN f.name) + 1) END AS level2, m2.volume
FROM (SELECT DISTINCT period_month FROM MF) m
CROSS JOIN (VALUES """ + ", ".join(f"('{f}', '{n}')" for f, n in HEADERS.items()) + """) f(fuel, name)
LEFT JOIN MF m2 ON m2.period_month = m.period_month AND m2.fuel = f.fuel""",
)
def melt_hier(spark, d):
    wide = pivot_sum(monthly_fuel(spark, d), ["period_month"], "fuel", "volume", FUELS)
    named = wide.select(
        "period_month",
        *[F.col(f).cast("string").alias(n) for f, n in HEADERS.items()],
    )
    return c.melt_hier(named, ["period_month"], "volume")


@query(
    "p12_zero_is_missing",
    """SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE l_discount IS NOT NULL AND abs(l_discount) >= 1e-9""",
)
def zero_is_missing(spark, d):
    items = read_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    return c.zero_is_missing(items, "l_discount")


@query(
    "p12_zero_counts",
    "SELECT l_returnflag, count(*) AS zero_rows FROM lineitem WHERE abs(l_discount) < 1e-9 GROUP BY 1",
)
def zero_counts(spark, d):
    return c.zero_counts(read_table(spark, d, "lineitem"), "l_discount", ["l_returnflag"])


@query(
    "p13_keep_total_rows",
    "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus = 'O'",
)
def keep_total_rows(spark, d):
    filters = {"l_returnflag": "R ", "l_linestatus": "O", "absent": "x"}
    return c.keep_total_rows(read_table(spark, d, "lineitem"), filters).select("l_orderkey", "l_linenumber")


@query(
    "p14_drop_missing",
    with_shapes("SNAP")
    + """ SELECT area, parsed_path, price FROM SNAP
WHERE CAST(parsed_path AS BIGINT) % 5 <> 0 AND CAST(parsed_path AS BIGINT) % 7 <> 0""",
)
def drop_missing(spark, d):
    snap = shapes.revisions(spark, d)
    key = F.col("parsed_path").cast("bigint")
    holed = snap.select(
        F.when(key % 5 != 0, F.col("area")).alias("area"), "parsed_path",
        F.when(key % 7 != 0, F.col("price")).alias("price"),
    )
    return c.drop_missing(holed, ["area", "price"])


@query(
    "p15_stamp_provenance",
    f"""SELECT o_orderkey, 'orders_file' AS source_id, 2 AS source_priority,
  TIMESTAMP '{COLLECTED}' AS collected_at, 'orders.parquet' AS source_file,
  sha256(CAST(o_orderkey AS VARCHAR)) AS source_file_sha256, 'orders.parquet' AS parsed_path FROM orders""",
)
def stamp_provenance(spark, d):
    orders = read_table(spark, d, "orders").select("o_orderkey", "_metadata.file_name")
    return c.stamp_provenance(
        orders, "orders_file", F.lit(COLLECTED), F.col("file_name"),
        F.sha2(F.col("o_orderkey").cast("string"), 256), 2,
    ).drop("file_name")


@query(
    "p16_conform",
    "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day, o_totalprice AS price FROM orders",
)
def conform(spark, d):
    schema = T.StructType.fromDDL("id bigint, day date, price double")
    orders = c.apply_mapping(
        read_table(spark, d, "orders"), {"id": "o_orderkey", "day": "o_orderdate", "price": "o_totalprice"}
    )
    if "o_custkey" not in c.unknown_columns(orders, schema):
        raise AssertionError("unknown columns must be reported")
    return c.conform(c.require_rows(orders, "orders"), schema)


@query(
    "p17_column_diff",
    """SELECT e.p_type FROM (VALUES ('ECONOMY'), ('JUMBO'), ('PROMO'), ('WRAP')) e(p_type)
WHERE e.p_type NOT IN (SELECT p_type FROM part)""",
)
def column_diff(spark, d):
    return c.absent_categories(read_table(spark, d, "part"), "p_type", ["ECONOMY", "JUMBO", "PROMO", "WRAP"])


@query(
    "p18_trade_hour_interval",
    with_shapes("H")
    + """, T AS (SELECT area, CAST(interval_end - INTERVAL 1 HOUR AS DATE) AS trade_date,
  CAST(hour(interval_end - INTERVAL 1 HOUR) + 1 AS INTEGER) AS trade_hour, interval_end FROM H)
SELECT area, trade_date, trade_hour, interval_end, interval_end - INTERVAL 1 HOUR AS interval_start FROM T""",
)
def trade_hour_interval(spark, d):
    start = F.col("interval_end") - F.expr("interval 1 hour")
    keyed = shapes.hourly_price(spark, d).select(
        "area", start.cast("date").alias("trade_date"), (F.hour(start) + 1).alias("trade_hour")
    )
    date, hour = F.col("trade_date"), F.col("trade_hour")
    return keyed.withColumns({"interval_end": p.interval_end(date, hour), "interval_start": p.interval_start(date, hour)})


_LETTER_CASE = "CASE month(o_orderdate) " + " ".join(
    f"WHEN {m} THEN '{letter}'" for letter, m in p.MONTH_LETTERS.items()
) + " END"
_MONTH_CASE = "CASE letter " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in p.MONTH_LETTERS.items()) + " END"


@query(
    "p19_contract_month",
    f"""WITH T AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS quote, {_LETTER_CASE} AS letter,
  CAST(o_orderkey % 10 AS INTEGER) AS digit, month(o_orderdate) AS mo, year(o_orderdate) AS yr FROM orders),
C AS (SELECT *, CAST(floor(yr / 10) * 10 AS INTEGER) AS decade, {_MONTH_CASE} AS code_month FROM T)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN make_date(CAST(yr AS INTEGER), CAST(mo AS INTEGER), 1)
  WHEN o_orderkey % 3 = 1 THEN NULL
  WHEN make_date(decade + digit, code_month, 1) < quote - 30 THEN make_date(decade + 10 + digit, code_month, 1)
  ELSE make_date(decade + digit, code_month, 1) END AS contract_month FROM C""",
)
def contract_month(spark, d):
    letters = {str(m): letter for letter, m in p.MONTH_LETTERS.items()}
    third = F.col("o_orderkey") % 3
    label = F.when(third == 0, F.upper(F.date_format("o_orderdate", "MMM yyyy"))).otherwise("")
    code = F.when(third == 1, "JKM?5").otherwise(
        F.concat(
            F.lit("JKM"), p.lookup(F.month("o_orderdate").cast("string"), letters),
            (F.col("o_orderkey") % 10).cast("string"),
        )
    )
    return read_table(spark, d, "orders").select(
        "o_orderkey", p.contract_month(label, code, F.col("o_orderdate")).alias("contract_month")
    )


@query(
    "p20_explode_leads",
    with_shapes("M")
    + """ SELECT area AS reg_id, CAST(period_month + CAST(k AS INTEGER) AS DATE) AS forecast_date,
  CAST(k AS INTEGER) AS lead_days, CASE WHEN k <> 6 THEN price + k END AS ta_min,
  CASE WHEN k <> 5 THEN price + 10 * k END AS ta_max
FROM M, range(3, 11) r(k) WHERE k <> 7""",
)
def explode_leads(spark, d):
    pairs = []
    for k in range(3, 11):
        if k == 7:
            continue
        if k != 5:
            pairs += [F.lit(f"taMax{k}"), (F.col("price") + 10 * k).cast("string")]
        if k != 6:
            pairs += [F.lit(f"taMin{k}"), (F.col("price") + k).cast("string")]
    wide = shapes.monthly_price(spark, d).select(
        F.col("area").alias("reg_id"),
        F.date_format("period_month", "yyyyMMdd'0600'").alias("tm_fc"),
        F.create_map(*pairs).alias("record"),
    )
    return c.explode_leads(wide, "record", "tm_fc").drop("tm_fc")


@query(
    "p21_eav_numeric",
    """WITH T AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'none' ELSE json_extract_string(props, '$.k') END AS fcst_value
  FROM events)
SELECT event_id, fcst_value, TRY_CAST(fcst_value AS DOUBLE) AS fcst_value_numeric FROM T""",
)
def eav_numeric(spark, d):
    value = F.when(F.col("event_id") % 10 == 0, "none").otherwise(F.get_json_object("props", "$.k"))
    rows = read_table(spark, d, "events").select("event_id", value.alias("fcst_value"))
    return c.eav_numeric(rows, "fcst_value")


@query(
    "p22_series_rows",
    with_shapes("M")
    + """ SELECT 'macro' AS source_id, period_month, area AS series_id, price AS value,
  CASE WHEN month(period_month) = 1 THEN '' ELSE 'unit' END AS units FROM M WHERE month(period_month) <> 2""",
)
def series_rows(spark, d):
    month = F.month("period_month")
    payload = shapes.monthly_price(spark, d).select(
        F.date_format("period_month", "yyyy-MM").alias("period"),
        F.col("area").alias("seriesId"),
        F.when(month == 2, "--").otherwise(F.col("price").cast("string")).alias("value"),
        F.when(month != 1, "unit").alias("unit"),
    )
    return c.series_rows(payload, "macro")


@query("p23_filter_area", with_shapes("M") + " SELECT * FROM M WHERE area = '2-HIGH'")
def filter_area(spark, d):
    aliases = {"high": "2-HIGH", "urgent": "1-URGENT"}
    return c.filter_area(shapes.monthly_price(spark, d), "high", aliases)


@query("p24_event_date", with_shapes("M") + " SELECT max(period_month) AS event_date FROM M")
def event_date(spark, d):
    return c.event_date(shapes.monthly_price(spark, d))


PRICE_SPEC = SourceSpec(
    source_id="wide_price_file",
    schema="source_id string, period_month date, area string, price double, source_priority int, source_file string",
    mapping={"period": "Period", "mainland": "A", "jeju": "B", "integrated": "C", "island": "D", "north": "E"},
    period=Period("month", ("period",), "%Y/%m"),
    ids=("period_month",),
    melt=Melt("price", ("mainland", "jeju", "integrated", "island", "north"), var="area"),
    zero_is_missing="price",
    priority=1,
)
VOLUME_SPEC = SourceSpec(
    source_id="hourly_volume_file",
    schema="source_id string, trade_date date, trade_hour int, interval_end timestamp_ntz, fuel_type_raw string, "
    "fuel_type string, volume double",
    mapping={"trade_date": "Day", "trade_hour": "Hour", "fuel_type_raw": "Fuel", "volume": "MWh"},
    period=Period("day", ("trade_date",), "%Y-%m-%d", out="trade_date"),
    hour="trade_hour",
    measures=("volume",),
    category=Category(("fuel_type_raw",), "fuel_type", TYPE_MAP),
)
CAPACITY_SPEC = SourceSpec(
    source_id="capacity_file",
    schema="source_id string, period_month date, level1 string, level2 string, kind string, capacity_mw double",
    mapping={"period": "Period", "region": "Region"},
    period=Period("month", ("period",), "%Y%m"),
    totals={"region": "all"},
    ids=("period_month", "region"),
    melt=Melt("capacity_mw"),
    category=Category(("level1", "level2"), "kind", {"thermal": "steam", "thermal|gas": "combined"}, required=False),
    required=("capacity_mw",),
)


@query(
    "p25_conform_source_price",
    with_shapes("M")
    + """, W AS (SELECT period_month, area, CASE WHEN month(period_month) = 6 THEN 0 ELSE price END AS price FROM M)
SELECT 'wide_price_file' AS source_id, period_month,
  CASE area WHEN '1-URGENT' THEN 'mainland' WHEN '2-HIGH' THEN 'jeju' WHEN '3-MEDIUM' THEN 'integrated'
    WHEN '4-NOT SPECIFIED' THEN 'island' ELSE 'north' END AS area, price,
  1 AS source_priority, 'price.csv' AS source_file
FROM W WHERE price <> 0""",
)
def conform_price(spark, d):
    prices = shapes.monthly_price(spark, d)
    zeroed = prices.withColumn("price", F.when(F.month("period_month") == 6, 0.0).otherwise(F.col("price")))
    areas = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = pivot_sum(zeroed, ["period_month"], "area", "price", areas)
    vendor = wide.select(
        F.date_format("period_month", "yyyy/MM").alias("Period"),
        *[F.col(f"`{a}`").cast("string").alias(n) for a, n in zip(areas, "ABCDE")],
    )
    return conform_source(vendor, PRICE_SPEC, F.lit(COLLECTED), F.lit("price.csv"), F.lit("0"))


@query(
    "p25_conform_source_volume",
    f"""WITH T AS (SELECT CAST(l_shipdate AS DATE) AS trade_date, CAST(1 + l_orderkey % 24 AS INTEGER) AS trade_hour,
  p_type, l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT 'hourly_volume_file' AS source_id, trade_date, trade_hour,
  CAST(trade_date AS TIMESTAMP) + to_hours(trade_hour) AS interval_end, p_type AS fuel_type_raw,
  {_case('p_type', TYPE_MAP)} AS fuel_type, l_quantity AS volume
FROM T WHERE {_case('p_type', TYPE_MAP)} IS NOT NULL""",
)
def conform_volume(spark, d):
    items = read_table(spark, d, "lineitem").join(
        read_table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")
    )
    vendor = items.select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Day"),
        (1 + F.col("l_orderkey") % 24).cast("string").alias("Hour"),
        F.col("p_type").alias("Fuel"),
        F.format_number("l_quantity", 1).alias("MWh"),
    )
    return conform_source(vendor, VOLUME_SPEC, F.lit(COLLECTED), F.lit("volume.csv"), F.lit("0"))


@query(
    "p25_conform_source_capacity",
    with_shapes("FUEL") + MONTHLY_FUEL + """ SELECT 'capacity_file' AS source_id, m.period_month, f.level1, f.level2,
  f.kind, m.volume AS capacity_mw
FROM MF m JOIN (VALUES ('ECONOMY', 'thermal', 'coal', 'steam'), ('LARGE', 'nuclear', '', NULL), ('MEDIUM', 'renewable', 'hydro', NULL),
  ('PROMO', 'thermal', 'gas', 'combined'), ('SMALL', 'renewable', 'solar', NULL), ('STANDARD', 'thermal', 'oil', 'steam')) f(fuel, level1, level2, kind)
  ON m.fuel = f.fuel""",
)
def conform_capacity(spark, d):
    wide = pivot_sum(monthly_fuel(spark, d), ["period_month"], "fuel", "volume", FUELS)
    vendor = wide.select(
        F.date_format("period_month", "yyyyMM").alias("Period"),
        F.explode(F.array(F.lit("all"), F.lit("north"))).alias("Region"),
        *[F.format_number(f, 2).alias(n.removesuffix("|peak")) for f, n in HEADERS.items()],
    )
    return conform_source(vendor, CAPACITY_SPEC, F.lit(COLLECTED), F.lit("capacity.csv"), F.lit("0"))


@query(
    "p26_select_columns",
    with_shapes("FUEL") + MONTHLY_FUEL + WIDE + ' SELECT period_month, "ECONOMY", "SMALL", "STANDARD" FROM WIDE',
)
def select_columns(spark, d):
    wide = pivot_sum(monthly_fuel(spark, d), ["period_month"], "fuel", "volume", FUELS)
    return c.select_columns(wide, names=["ECONOMY"], prefixes=["S"], keep=["period_month"])


@query(
    "p27_numeric_matrix",
    with_shapes("PANEL")
    + """ SELECT area, period_month, observed, lag_1m, lag_12m,
  CAST(month(period_month) IN (6, 7, 8) AS DOUBLE) AS is_summer FROM PANEL""",
)
def numeric_matrix(spark, d):
    panel = shapes.backtest_panel(spark, d).withColumn("is_summer", F.month("period_month").isin(6, 7, 8))
    return c.numeric_matrix(panel, "target", keep=("area", "period_month"))
