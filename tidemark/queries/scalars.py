"""Scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arithmetic as a
from tidemark.functions import calendar as cal
from tidemark.functions import parsing as p
from tidemark.functions import redaction as red
from tidemark.operators.aggregates import pivot_sum
from tidemark.plans import shapes
from tidemark.plans.shapes import with_shapes
from tidemark.queries.registry import query
from tidemark.queries.tools import rounded

FUELS = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
SLOTS = ["0200", "0500", "0800", "1100", "1400", "1700", "2000", "2300"]
SECRETS = [
    "f33e61083db5dbdf4bd2369d2f80176e57f7fda2",
    "anon@example.com/reports?id=7",
    "the the and the",
    "short",
]

MONTHLY_FUEL = """, MF AS (
  SELECT CAST(date_trunc('month', trade_date) AS DATE) AS period_month, fuel,
         CAST(sum(CAST(round(volume * 100) AS BIGINT)) AS DOUBLE) / 100 AS volume,
         CAST(sum(CAST(round(amount * 100) AS BIGINT)) AS DOUBLE) / 100 AS amount
  FROM FUEL GROUP BY 1, 2)"""


def monthly_fuel(spark, d):
    trades = shapes.fuel_trades(spark, d)
    return trades.groupBy(shapes.month_of("trade_date").alias("period_month"), "fuel").agg(
        shapes.exact_sum("volume").alias("volume"), shapes.exact_sum("amount").alias("amount")
    )


@query(
    "x1_calendar_monthly",
    with_shapes("M")
    + """ SELECT area, period_month, CAST(year(period_month) AS INTEGER) AS year,
  CAST(month(period_month) AS INTEGER) AS month, CAST(quarter(period_month) AS INTEGER) AS quarter,
  month(period_month) IN (6, 7, 8) AS is_summer, month(period_month) IN (12, 1, 2) AS is_winter,
  month(period_month) IN (6, 7, 8, 12, 1, 2) AS is_peak_season,
  round(sin(2 * pi() * month(period_month) / 12), 9) AS month_sin,
  round(cos(2 * pi() * month(period_month) / 12), 9) AS month_cos FROM M""",
)
def calendar_monthly(spark, d):
    return rounded(cal.calendar_monthly(shapes.monthly_price(spark, d).drop("price")), 9)


@query(
    "x2_calendar_hourly",
    with_shapes("H")
    + """, T AS (SELECT area, interval_end, month(interval_end) AS mo,
  CASE WHEN hour(interval_end) = 0 THEN 24 ELSE hour(interval_end) END AS hr,
  isodow(interval_end) - 1 AS dow FROM H)
SELECT area, interval_end, CAST(year(interval_end) AS INTEGER) AS year, CAST(mo AS INTEGER) AS month,
  CAST(day(interval_end) AS INTEGER) AS day, CAST(hr AS INTEGER) AS hour,
  CAST(dow AS INTEGER) AS day_of_week, dow IN (5, 6) AS is_weekend,
  CASE WHEN mo IN (3, 4, 5) THEN 'spring' WHEN mo IN (6, 7, 8) THEN 'summer'
       WHEN mo IN (9, 10, 11) THEN 'autumn' ELSE 'winter' END AS season,
  mo IN (6, 7, 8) AS is_summer, mo IN (12, 1, 2) AS is_winter,
  mo IN (6, 7, 8, 12, 1, 2) AS is_peak_load_season,
  round(sin(2 * pi() * hr / 24), 9) AS hour_sin, round(cos(2 * pi() * hr / 24), 9) AS hour_cos,
  round(sin(2 * pi() * dow / 7), 9) AS dow_sin, round(cos(2 * pi() * dow / 7), 9) AS dow_cos
FROM T""",
)
def calendar_hourly(spark, d):
    return rounded(cal.calendar_hourly(shapes.hourly_price(spark, d).drop("price", "demand")), 9)


HOLIDAYS = ["2024-01-01", "2024-02-09", "2024-03-01", "2024-05-05"]


@query(
    "x3_is_holiday",
    with_shapes("H")
    + " SELECT area, interval_end, CAST(interval_end AS DATE) IN ("
    + ", ".join(f"DATE '{h}'" for h in HOLIDAYS)
    + ") AS is_holiday FROM H",
)
def is_holiday(spark, d):
    holidays = spark.createDataFrame([(h,) for h in HOLIDAYS], "holiday_date string")
    hours = shapes.hourly_price(spark, d).drop("price", "demand")
    return cal.add_holiday_flag(hours, "interval_end", holidays)


@query(
    "x4_forecast_contract",
    with_shapes("M")
    + """ SELECT area, period_month, period_month AS forecast_origin_month,
  CAST(period_month + INTERVAL 3 MONTH AS DATE) AS target_month,
  CAST(last_day(period_month) AS TIMESTAMP) + INTERVAL '23:59:59' HOUR TO SECOND AS information_cutoff,
  '3M' AS horizon FROM M""".replace("INTERVAL '23:59:59' HOUR TO SECOND", "INTERVAL 86399 SECOND"),
)
def forecast_contract(spark, d):
    return cal.forecast_contract(shapes.monthly_price(spark, d).drop("price"), 3)


@query(
    "x5_safe_ratio",
    with_shapes("FUEL")
    + MONTHLY_FUEL
    + """, S AS (SELECT period_month, fuel, volume, volume - 500 AS den FROM MF)
SELECT period_month, fuel, round(CASE WHEN den > 0 THEN volume / den END, 6) AS ratio FROM S""",
)
def safe_ratio(spark, d):
    ratio = a.safe_ratio(F.col("volume"), F.col("volume") - 500)
    return monthly_fuel(spark, d).select("period_month", "fuel", F.round(ratio, 6).alias("ratio"))


@query(
    "x6_unit_price",
    with_shapes("FUEL")
    + MONTHLY_FUEL
    + " SELECT period_month, fuel, round(CASE WHEN volume > 0 THEN amount / volume END / 1000, 9) AS unit_price FROM MF",
)
def unit_price(spark, d):
    price = a.unit_price(F.col("amount"), F.col("volume"))
    return monthly_fuel(spark, d).select("period_month", "fuel", F.round(price, 9).alias("unit_price"))


WIDE_FUEL = (
    """, W AS (SELECT period_month, """
    + ", ".join(f'max(CASE WHEN fuel = \'{f}\' AND volume % 3 <> 0 THEN volume END) AS "{f}"' for f in FUELS)
    + " FROM MF GROUP BY 1)"
)


def wide_fuel(spark, d):
    kept = monthly_fuel(spark, d).withColumn("volume", F.when(F.col("volume") % 3 != 0, F.col("volume")))
    return pivot_sum(kept, ["period_month"], "fuel", "volume", FUELS)


@query(
    "x7_row_sum",
    with_shapes("FUEL")
    + MONTHLY_FUEL
    + WIDE_FUEL
    + """ SELECT period_month, coalesce("PROMO", 0) + coalesce("SMALL", 0) AS zero_filled,
  CASE WHEN "PROMO" IS NOT NULL OR "SMALL" IS NOT NULL
       THEN coalesce("PROMO", 0) + coalesce("SMALL", 0) END AS null_kept FROM W""",
)
def row_sum(spark, d):
    parts = [F.col("PROMO"), F.col("SMALL")]
    return wide_fuel(spark, d).select(
        "period_month", a.row_sum(parts).alias("zero_filled"), a.row_sum(parts, 1).alias("null_kept")
    )


@query(
    "x8_null_sum",
    with_shapes("FUEL") + MONTHLY_FUEL + WIDE_FUEL + ' SELECT period_month, "LARGE" + "MEDIUM" AS coal_total FROM W',
)
def null_sum(spark, d):
    return wide_fuel(spark, d).select(
        "period_month", a.null_sum(F.col("LARGE"), F.col("MEDIUM")).alias("coal_total")
    )


_SLOT_CASE = " ".join(f"WHEN hhmm >= '{s}' THEN '{s}'" for s in reversed(SLOTS))


@query(
    "x9_latest_slot",
    f"""WITH C AS (SELECT event_id, ts - INTERVAL 10 MINUTE AS c FROM events),
T AS (SELECT event_id, CAST(c AS DATE) AS day, strftime(c, '%H%M') AS hhmm FROM C)
SELECT event_id, CAST(CASE WHEN hhmm >= '{SLOTS[0]}' THEN day ELSE day - 1 END AS DATE) AS base_date,
  CASE {_SLOT_CASE} ELSE '{SLOTS[-1]}' END AS base_time FROM T""",
)
def latest_slot(spark, d):
    day, slot = p.latest_slot(F.col("ts"), SLOTS, 10)
    return shapes.read_table(spark, d, "events").select(
        "event_id", day.alias("base_date"), slot.alias("base_time")
    )


@query(
    "x10_delta",
    with_shapes("PRED")
    + """ SELECT area, period_month, model, round(y_true - base, 6) AS true_delta,
  round(y_pred - base, 6) AS predicted_delta, round(base + (y_pred - base), 6) AS rebuilt FROM PRED""",
)
def delta(spark, d):
    pred = shapes.predictions(spark, d)
    predicted = a.delta_target(F.col("y_pred"), F.col("base"))
    return rounded(
        pred.select(
            "area", "period_month", "model",
            a.delta_target(F.col("y_true"), F.col("base")).alias("true_delta"),
            predicted.alias("predicted_delta"),
            a.reconstruct(F.col("base"), predicted).alias("rebuilt"),
        ),
        6,
    )


@query(
    "x11_classify_model",
    with_shapes("PRED")
    + """, N AS (SELECT DISTINCT CASE WHEN version % 3 = 0 THEN 'delta_ridge' WHEN version % 3 = 1 THEN model
  ELSE 'model_' || version END AS model FROM PRED)
SELECT model, CASE WHEN model IN ('persistence_monthly', 'naive_lag_1m', 'seasonal_naive_lag_12m') THEN 'baseline'
  WHEN model = 'delta_ridge' THEN 'trainable' ELSE 'unknown' END AS kind FROM N""",
)
def classify_model(spark, d):
    version = F.col("version")
    name = (
        F.when(version % 3 == 0, "delta_ridge")
        .when(version % 3 == 1, F.col("model"))
        .otherwise(F.concat(F.lit("model_"), version.cast("string")))
    )
    names = shapes.predictions(spark, d).select(name.alias("model")).distinct()
    return names.withColumn("kind", a.classify_model(F.col("model")))


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


# RE2 counts only ASCII as white space; Spark's functions run with Unicode classes
_SPACES = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _redacted(source: str, key: str) -> str:
    """CTEs from ``source`` (``key``, ``text``) to ``CLEAN``: the rule for credentials, spelled out piece by piece.

    Texts are cut at the word Authorization, then at every ``=`` and ``:``. What stands left of a cut is looked
    at as a name, what stands right of it as a value: mode 1 says that a value is due, 2 that one goes on across the cut.
    """
    some, none = f"[{_SPACES}]+", f"[{_SPACES}]*"
    stops = f"\"'&,;}}\\]<{_SPACES}"
    words = ", ".join(_sql_text(w) for w in red.CREDENTIAL_WORDS.split("|"))
    # escaped characters of a quoted value are hidden at equal length, so that the next quote ends it
    hidden = "g.body"
    for escape in ("\\\\", '\\"', "\\'"):
        hidden = f"replace({hidden}, {_sql_text(escape)}, '~~')"
    quoted, line = f"^[\"']{none}:{none}[\"']", f"^{none}:{none}[A-Za-z0-9_+-]+{some}"
    value, stop, start = (_sql_text(p) for p in (f"^[^{stops}]+", f"[{stops}]", f"^[^{stops}]"))
    name = _sql_text(f'([A-Za-z0-9_-]*)"?{none}$')
    behind = "substr(p[i], length(lead[i]) + 1)"
    left = f"""CASE acc.mode WHEN 2 THEN regexp_replace(p[i], {value}, '') WHEN 1 THEN regexp_replace({behind}, {value}, '') ELSE p[i] END"""
    return f"""CUT AS (
  SELECT {key}, regexp_split_to_array(text, '(?i)authorization') AS part, regexp_extract_all(text, '(?i)authorization') AS word FROM {source}),
HEADED AS (
  SELECT {key}, part, word, list_transform(range(2, len(part) + 1), lambda i: {{
    'before': right(part[i - 1], 1), 'text': part[i], 'quoted': regexp_extract(part[i], {_sql_text(quoted)}),
    'line': regexp_extract(part[i], {_sql_text(line)})}}) AS found FROM CUT),
BODIED AS (
  SELECT {key}, part, word, list_transform(found, lambda f: {{'f': f, 'body': substr(f.text, length(f.quoted) + 1)}}) AS found FROM HEADED),
VALUED AS (
  SELECT {key}, part, word, list_transform(found, lambda g: {{
    'f': g.f, 'body': g.body, 'ends': length(regexp_extract({hidden}, {_sql_text("^[^\"'" + chr(92) * 2 + "]*")}))}}) AS found FROM BODIED),
HEADERS AS (
  SELECT {key}, part[1] || array_to_string(list_transform(list_zip(word, found), lambda z: z[1] || CASE
    WHEN z[2].f.quoted <> '' AND z[2].f.before IN ('"', '''') AND z[2].ends > 0 AND substr(z[2].body, z[2].ends + 1, 1) IN ('"', '''')
      THEN z[2].f.quoted || '<REDACTED>' || substr(z[2].body, z[2].ends + 1)
    WHEN z[2].f.line <> '' AND length(z[2].f.text) > length(z[2].f.line)
      THEN z[2].f.line || '<REDACTED>' || regexp_extract(substr(z[2].f.text, length(z[2].f.line) + 1), '[\\r\\n](?s:.*)$')
    ELSE z[2].f.text END), '') AS text FROM VALUED),
SPLIT AS (SELECT {key}, text, regexp_split_to_array(text, '[=:]') AS p, regexp_extract_all(text, '[=:]') AS s FROM HEADERS),
NAMED AS (SELECT {key}, p, s, list_transform(p, lambda x: regexp_extract(x, {_sql_text(f'^{none}"?')})) AS lead FROM SPLIT),
WALKED AS (
  SELECT {key}, list_reduce(range(1, len(p) + 1), lambda acc, i: {{
    'out': acc.out || CASE WHEN i = 1 OR acc.mode = 2 THEN '' ELSE s[i - 1] END || CASE
      WHEN acc.mode = 2 THEN {left}
      WHEN acc.mode = 1 AND ({behind} = '' AND i < len(p) OR regexp_matches({behind}, {start})) THEN lead[i] || '<REDACTED>' || {left}
      ELSE p[i] END,
    'mode': CASE
      WHEN acc.mode = 2 AND NOT regexp_matches(p[i], {stop}) OR acc.mode = 1 AND NOT regexp_matches({behind}, {stop}) THEN 2
      WHEN len(list_filter([{words}], lambda w: contains(lower(regexp_extract({left}, {name}, 1)), w))) > 0 THEN 1 ELSE 0 END}},
    {{'out': '', 'mode': 0}}).out AS text FROM NAMED),
CLEAN AS (
  SELECT {key}, regexp_replace(text, '\\beyJ[A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}[.][A-Za-z0-9_-]{{8,}}', '<REDACTED>', 'g') AS text FROM WALKED)"""


@query("x12_redact_credentials", f"WITH {_redacted('documents', 'doc_id')} SELECT doc_id, text FROM CLEAN")
def redact_credentials(spark, d):
    return shapes.read_table(spark, d, "documents").select(
        "doc_id", red.redact_credentials(F.col("text")).alias("text")
    )


@query(
    "x12_redact_headers",
    "WITH T AS (SELECT page_id, CASE page_id % 5 "
    """WHEN 0 THEN '{"Authorization":"Bearer ' || md5(url) || '","url":"' || url || '"}' """
    """WHEN 1 THEN 'Authorization: Basic ' || md5(url) || chr(10) || url """
    """WHEN 2 THEN url || '&api_key=' || md5(url) || '&x=1' """
    """WHEN 3 THEN 'error eyJ' || md5(url) || '.' || md5(html) || '.' || md5(url) || ' ' || html """
    """ELSE html || ' session: ' || md5(url) END AS text FROM pages), """
    f"{_redacted('T', 'page_id')} SELECT page_id, text FROM CLEAN",
)
def redact_headers(spark, d):
    text = F.expr(
        """CASE page_id % 5
        WHEN 0 THEN concat('{"Authorization":"Bearer ', md5(url), '","url":"', url, '"}')
        WHEN 1 THEN concat('Authorization: Basic ', md5(url), char(10), url)
        WHEN 2 THEN concat(url, '&api_key=', md5(url), '&x=1')
        WHEN 3 THEN concat('error eyJ', md5(url), '.', md5(html), '.', md5(url), ' ', html)
        ELSE concat(html, ' session: ', md5(url)) END"""
    )
    return shapes.read_table(spark, d, "pages").select("page_id", red.redact_credentials(text).alias("text"))


_LONG = """CASE doc_id % 40 WHEN 0 THEN concat('{{"Authorization": "', repeat('x', 100000), '"}} ', text)
  WHEN 1 THEN concat('{{"Authorization": "', repeat(concat('y', chr(92), chr(34)), 30000), '"}} ', text) ELSE text END"""


@query(
    "x12_redact_long_values",
    f"WITH T AS (SELECT doc_id, {_LONG.format()} AS text FROM documents), {_redacted('T', 'doc_id')} SELECT doc_id, text FROM CLEAN",
)
def redact_long_values(spark, d):
    """All documents, some of them behind header values of 100,000 characters, plain and escaped."""
    text = F.expr(_LONG.format())
    return shapes.read_table(spark, d, "documents").select("doc_id", red.redact_credentials(text).alias("text"))


def _mask_sql(column: str) -> str:
    out = column
    for form in red.secret_forms(SECRETS):
        out = f"replace({out}, {_sql_text(form)}, '<REDACTED>')"
    return out


@query("x13_mask_known_values", f"SELECT doc_id, {_mask_sql('text')} AS text FROM documents")
def mask_known_values(spark, d):
    return shapes.read_table(spark, d, "documents").select(
        "doc_id", red.mask_known_values(F.col("text"), SECRETS).alias("text")
    )


@query(
    "x14_redact_url_param",
    """SELECT page_id, CASE WHEN position('page=' IN url) = 0 THEN url ELSE
  left(url, position('page=' IN url) + 4) || '<REDACTED>' ||
  CASE WHEN position('&' IN substr(url, position('page=' IN url))) = 0 THEN ''
       ELSE substr(url, position('page=' IN url) + position('&' IN substr(url, position('page=' IN url))) - 1) END
  END AS url FROM pages""",
)
def redact_url_param(spark, d):
    return shapes.read_table(spark, d, "pages").select(
        "page_id", red.redact_url_param(F.col("url"), "page").alias("url")
    )


@query(
    "x15_scrub_params",
    """WITH Q AS (SELECT page_id, string_split(regexp_extract(url, '\\?([^#]*)', 1) || '&api_token=' || md5(url), '&') AS parts
  FROM pages),
P AS (SELECT page_id, unnest(parts) AS part FROM Q),
K AS (SELECT page_id, split_part(part, '=', 1) AS name, split_part(part, '=', 2) AS value FROM P WHERE part <> '')
SELECT page_id, name, CASE WHEN regexp_matches(name, '(?i)(key|token|secret|auth|password|passwd|pwd|credential|cookie|session|sso)')
  THEN '<REDACTED>' ELSE value END AS value FROM K""",
)
def scrub_params(spark, d):
    query_text = F.concat(
        F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&api_token="), F.md5(F.col("url").cast("binary"))
    )
    params = F.str_to_map(F.ltrim(query_text, F.lit("&")), F.lit("&"), F.lit("="))
    return shapes.read_table(spark, d, "pages").select(
        "page_id", F.explode(red.scrub_params(params)).alias("name", "value")
    )
