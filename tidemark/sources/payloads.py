"""Records inside JSON and XML payloads, the payload archive and key profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RECORD = "map<string,string>"

# the list sits under one of these; a nested value is read as its raw text
_ENVELOPE = (
    "response struct<body:struct<items:string,item:string,data:string>,data:string,items:string>,"
    "items string, item string, data string"
)


def _records(raw: Column, record: str, single: bool = False) -> Column:
    """Records of a raw JSON list, or of one object where that is allowed; null if it has none."""
    text = F.ltrim(raw)
    many = F.when(text.startswith("["), F.from_json(text, f"array<{record}>"))
    if single:
        many = F.coalesce(many, F.when(text.startswith("{"), F.array(F.from_json(text, record))))
    kept = F.filter(many, lambda r: r.isNotNull())
    return F.when(F.size(kept) > 0, kept)


def _list_or_wrapped(raw: Column, record: str) -> Column:
    """A list of records, or an object holding them under ``item``."""
    inner = F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, "item string")["item"])
    return F.coalesce(_records(raw, record), _records(inner, record, single=True))


def record_array(payload: Column, record: str = RECORD) -> Column:
    """The record list of an API payload in any of its usual envelopes.

    ``response.body.items.item``, ``items``, ``data``, one object instead of a list, or the
    bare list. The envelope is parsed once, its leaves as raw text.
    """
    outer = F.from_json(payload, _ENVELOPE)
    body = outer["response"]["body"]
    return F.coalesce(
        _list_or_wrapped(body["items"], record),
        _records(body["item"], record),
        _list_or_wrapped(body["data"], record),
        _list_or_wrapped(outer["response"]["items"], record),
        _list_or_wrapped(outer["response"]["data"], record),
        _list_or_wrapped(outer["items"], record),
        _records(outer["item"], record),
        _list_or_wrapped(outer["data"], record),
        _records(payload, record),
    )


def explode_json_items(df: DataFrame, payload: str, out: str = "record", record: str = RECORD) -> DataFrame:
    """One row per record of the JSON payload; the payload column itself is dropped."""
    others = [c for c in df.columns if c != payload]
    return df.select(*others, F.explode(record_array(F.col(payload), record)).alias(out))


def parse_xml_items(df: DataFrame, payload: str, record_schema: str, out: str = "record") -> DataFrame:
    """One row per ``<item>`` of an XML payload shaped ``response/body/items/item``."""
    others = [c for c in df.columns if c != payload]
    schema = f"body struct<items: struct<item: array<struct<{record_schema}>>>>"
    parsed = F.from_xml(F.col(payload), schema)
    return df.select(*others, F.explode(parsed["body"]["items"]["item"]).alias(out))


def archive_rows(
    df: DataFrame, payload: str, source_id: str, request: Column, status: Column, collected_at: Column
) -> DataFrame:
    """Verbatim payloads with request and status, also of failed calls, under a unique id.

    The id joins the collection time in microseconds with a prefix of the payload's digest.
    """
    at = collected_at.cast("timestamp_ntz")
    stamp = F.date_format(at, "yyyyMMdd'T'HHmmss'Z__'SSSSSS")
    text = F.coalesce(F.col(payload), F.lit(""))
    return df.select(
        F.lit(source_id).alias("source_id"),
        F.concat(stamp, F.lit("_"), F.left(F.sha2(text, 256), F.lit(8))).alias("payload_id"),
        at.alias("collected_at"),
        at.cast("date").alias("event_date"),
        request.alias("request"),
        status.alias("status"),
        F.col(payload).alias("payload"),
    )


def payload_schema(df: DataFrame, payload: str) -> DataFrame:
    """One row: the merged schema of all payloads, to read before a mapping is written."""
    parsed = F.try_parse_json(F.col(payload))
    return df.agg(
        F.schema_of_variant_agg(parsed).alias("schema"),
        F.count(parsed.cast("string")).alias("parsed"),
        F.count("*").alias("payloads"),
    )


def payload_key_profile(df: DataFrame, payload: str, depth: int = 3) -> DataFrame:
    """Key paths down to a depth with the kind of value and how many payloads hold them.

    Of a list the first element stands for all.
    """
    level = df.select(F.lit("").alias("path"), F.col(payload).alias("node"))
    found: DataFrame | None = None
    for _ in range(depth):
        node = F.ltrim("node")
        first = F.when(node.startswith("["), F.get_json_object(node, "$[0]")).otherwise(node)
        keys = level.select("path", F.explode(F.from_json(first, RECORD)).alias("key", "node"))
        level = keys.select(
            F.when(F.col("path") == "", F.col("key")).otherwise(F.concat_ws(".", "path", "key")).alias("path"),
            "node",
        )
        found = level if found is None else found.unionByName(level)
    value = F.ltrim("node")
    kind = (
        F.when(value.isNull(), "null")
        .when(value.startswith("{"), "object")
        .when(value.startswith("["), "list")
        .when(value.isin("true", "false"), "boolean")
        .when(value.try_cast("double").isNotNull(), "number")
        .otherwise("text")
    )
    return found.groupBy("path", kind.alias("kind")).agg(F.count("*").alias("payloads"))
