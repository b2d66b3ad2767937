import hashlib
import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import cleaning as c
from tidemark.operators.checks import unlagged_columns
from tidemark.sources import digests, files, payloads, sinks
from tidemark.sources.catalog import SETTLEMENT_FUELS, SPECS
from tidemark.sources.spec import load_source

AT = "2024-01-02 03:04:05"


def load(spark, tmp_path, source, text, name="file.csv", encoding="cp949"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return load_source(spark, SPECS[source], str(path), F.lit(AT), name, F.lit("ab12"))


def test_wide_prices_with_year_and_month(spark, tmp_path, rows):
    text = "년도,월,육지계통한계가격,제주계통한계가격,통합계통한계가격\n2024,1,100.5,\"1,200\",0\n2024,2,0.00,90,80\n"
    out = load(spark, tmp_path, "smp_monthly_official", text)
    assert rows(out.select("period_month", "area", "smp_krw_per_kwh"), "period_month", "area") == [
        (date(2024, 1, 1), "jeju", 1200.0), (date(2024, 1, 1), "mainland", 100.5),
        (date(2024, 2, 1), "integrated", 80.0), (date(2024, 2, 1), "jeju", 90.0),
    ]
    row = out.first()
    assert (row.source_id, row.source_priority, row.source_file) == ("smp_monthly_official", 1, "file.csv")
    assert row.collected_at == datetime(2024, 1, 2, 3, 4, 5)


def test_two_header_rows_and_a_footer(spark, tmp_path, rows):
    text = "기간,SMP,,,BLMP\n,육지,제주,통합,\n2024/01,1,2,3,9\n2024/02,4,5,6,9\n총계,5,7,9,18\n"
    out = load(spark, tmp_path, "smp_monthly_fallback", text)
    got = rows(out.select("period_month", "area", "smp_krw_per_kwh"), "period_month", "area")
    assert len(got) == 6 and got[0] == (date(2024, 1, 1), "integrated", 3.0)


def test_header_flattening_leaves_the_leaf_row_alone():
    assert files.flatten_headers([["기간", "SMP", "", "", "BLMP"], ["", "육지", "제주", "통합", ""]]) == [
        "기간|", "SMP|육지", "SMP|제주", "SMP|통합", "BLMP|",
    ]


def test_settlement_with_byte_order_mark(spark, tmp_path):
    dropped = ["신재생_연료전지", "신재생_석탄가스화", "신재생_태양", "신재생_풍력", "신재생_수력", "신재생_해양",
               "신재생_바이오", "신재생_폐기물"]
    header = ["기간", *SETTLEMENT_FUELS, *dropped]
    text = ",".join(header) + "\n" + ",".join(["2024/01", *["1.5"] * (len(header) - 1)]) + "\n"
    out = load(spark, tmp_path, "settlement_monthly", text, encoding="utf-8-sig")
    assert out.count() == 10
    raw = files.read_delimited(spark, str(tmp_path / "file.csv"))
    assert c.dropped_columns(raw, ["기간", *SETTLEMENT_FUELS]) == sorted(dropped)


def test_capacity_by_fuel_keeps_totals_and_known_fuels(spark, tmp_path, rows):
    text = (
        "기간,회원구분,급전방식,사업구분,지역,원자력,신재생,,미상\n,,,,,,태양,풍력,\n"
        "2024/01,합계,합계,합계,합계,\"1,000\",10,20,5\n2024/01,회원,합계,합계,합계,1,1,1,1\n"
    )
    out = load(spark, tmp_path, "capacity_monthly_by_fuel", text)
    assert rows(out.select("fuel_type", "capacity_mw"), "fuel_type") == [
        ("nuclear", 1000.0), ("renewable_solar", 10.0), ("renewable_wind", 20.0),
    ]


def test_capacity_by_type_falls_back_to_the_first_level(spark, tmp_path, rows):
    text = (
        "기간,회원구분,급전방식,사업구분,지역,기력,,신재생,기타\n,,,,,유연탄,가스,태양,\n2024/01,합계,합계,합계,합계,1,2,3,\n"
    )
    out = load(spark, tmp_path, "capacity_monthly_by_generation_type", text)
    got = rows(out.select("capacity_type_level2", "capacity_type_canonical", "capacity_mw"), "capacity_mw")
    assert got == [("유연탄", "steam_coal_bituminous", 1.0), ("가스", "steam_gas", 2.0), ("태양", "renewable", 3.0)]


def test_yearly_capacity_takes_the_year_from_the_name(spark, tmp_path, rows):
    text = "구분,원자력,기력,\n,,유연탄,계\n총계,1,2,3\n ,4,5,6\n"
    out = load(spark, tmp_path, "capacity_yearly_by_energy_source", text, name="설비 (2021).csv")
    got = rows(out.select("period_year", "capacity_category_level1", "capacity_category_level2", "capacity_mw"), "capacity_mw")
    assert got == [(2021, "원자력", "", 1.0), (2021, "기력", "유연탄", 2.0), (2021, "기력", "계", 3.0)]


def test_hourly_volume(spark, tmp_path, rows):
    text = "거래일,거래시간,연료원,전력거래량(MWh)\n2024-01-31,24, LNG ,700\n2024-01-31,23,수수께끼,1\n,1,LNG,1\n"
    out = load(spark, tmp_path, "transaction_volume_hourly", text)
    assert rows(out.select("interval_end", "fuel_type", "transaction_volume_mwh")) == [
        (datetime(2024, 2, 1), "lng", 700.0)
    ]


def test_daily_history_and_curve(spark, tmp_path, rows):
    daily = '"Date","Price","Open","High","Low","Vol.","Change %"\n"01/31/2024","1,010.5","1","2","3","1.2K","-1.5%"\n'
    out = load(spark, tmp_path, "lng_daily_history", daily, encoding="utf-8-sig")
    assert rows(out.select("trade_date", "close", "volume", "change_pct")) == [(date(2024, 1, 31), 1010.5, None, -1.5)]
    curve = "Date,Time_CT,Month,Code,Prior_Settle,Volume\n24 May 2026,10:00,JUL 2026,JKMN6,18.81,5\n24 May 2026,10:00,,JKMQ6,18.37,6\n"
    out = load(spark, tmp_path, "lng_futures_curve", curve, encoding="utf-8")
    assert rows(out.select("contract_month", "prior_settle"), "contract_month") == [
        (date(2026, 7, 1), 18.81), (date(2026, 8, 1), 18.37),
    ]


def test_open_mapping_entries_and_missing_headers_are_refused(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(ValueError, match="filled in"):
        c.apply_mapping(df, {"x": c.TBD})
    with pytest.raises(ValueError, match="not in the file"):
        c.apply_mapping(df, {"x": "b"})


def test_empty_file_is_an_error(spark, tmp_path):
    with pytest.raises(ValueError, match="no rows"):
        load(spark, tmp_path, "lng_price_monthly", "period_month,lng_price_usd_per_mmbtu\n2024-01-01,\n", encoding="utf-8")


def test_snapshots_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(date(2024, 1, 1), 1.0)], "period_month date, v double")
    sinks.write_snapshot(df, str(tmp_path), "s", "one")
    with pytest.raises(FileExistsError):
        sinks.write_snapshot(df, str(tmp_path), "s", "one")
    back = files.read_snapshots(spark, str(tmp_path), "s", 7).first()
    assert (back.source_priority, back.source_file_sha256, back.parsed_row) == (7, "", 0)
    assert files.read_snapshots(spark, str(tmp_path), "absent") is None
    with pytest.raises(FileNotFoundError):
        files.read_sources(spark, str(tmp_path), {"absent": 1})


def test_quarantine_matches_decomposed_names(spark, rows):
    name = unicodedata.normalize("NFD", "발전량_2021.csv")
    df = spark.createDataFrame([(name, "p", "s"), ("other.csv", "p", "s")], "file_name string, path string, sha256 string")
    held = files.quarantine_manifest(df, ["발전량_*.csv"], "src", "filename_content_mismatch")
    assert rows(held.select("source_id", "original_path")) == [("src", "p")]


@pytest.mark.parametrize(
    "payload, n",
    [
        ('{"response":{"body":{"items":{"item":[{"a":"1"},{"a":"2"}]}}}}', 2), ('{"response":{"body":{"items":[{"a":"1"}]}}}', 1),
        ('{"response":{"body":{"items":{"item":{"a":"1"}}}}}', 1), ('{"response":{"data":[{"a":1},{"a":2},{"a":3}]}}', 3),
        ('[{"a":"1"},{"a":"2"}]', 2), ('{"items":[]}', 0), ('{"message":"none"}', 0), ("not json", 0),
    ],
)
def test_envelopes(spark, payload, n):
    df = spark.createDataFrame([(payload,)], "payload string")
    assert payloads.explode_json_items(df, "payload").count() == n


def test_naming_contract_of_lagged_columns():
    assert unlagged_columns(["period_month", "a_lag_1m", "b_lag_1y", "c"], exempt=["period_month"]) == ["c"]


def test_unknown_area_and_areas_without_rows(spark):
    df = spark.createDataFrame([("mainland",)], "area string")
    aliases = {"육지": "mainland", "제주": "jeju"}
    assert c.filter_area(df, "육지", aliases).count() == 1
    with pytest.raises(ValueError, match="unknown area"):
        c.filter_area(df, "moon", aliases)
    assert [r[0] for r in c.missing_areas(df, aliases).collect()] == ["jeju"]


def test_inbox_takes_names_with_blanks_and_signs(spark, tmp_path):
    from tidemark.sources.spec import Period, SourceSpec
    from tidemark.streaming.inbox import ingest_inbox

    spec = SourceSpec(
        source_id="x", schema="source_id string, trade_date date, price double, source_file string, source_file_sha256 string",
        mapping={"trade_date": "day", "price": "price"}, period=Period("day", ("trade_date",), "%Y-%m-%d", out="trade_date"), measures=("price",),
    )
    inbox = tmp_path / "in"
    inbox.mkdir()
    for name in ("a b.csv", "c+d%20.csv", "한글.csv"):
        (inbox / name).write_text("day,price\n2024-01-01,1.5\n")
    for _ in range(2):
        ingest_inbox(spark, spec, str(inbox), str(tmp_path / "table"), str(tmp_path / "state"), "day string, price string").awaitTermination()
    rows = spark.read.parquet(str(tmp_path / "table")).collect()
    assert sorted(r["source_file"] for r in rows) == ["a b.csv", "c+d%20.csv", "한글.csv"]
    assert len({r["source_file_sha256"] for r in rows}) == 3


def test_fingerprints_of_files_with_odd_names(spark, tmp_path):
    contents = {"a.csv": b"x", "b c+%41é.CSV": bytes(range(256)) * 40, "empty.csv": b"", "deep/d.csv": b"1\n2", "skip.txt": b"no"}
    (tmp_path / "deep").mkdir()
    for name, content in contents.items():
        (tmp_path / name).write_bytes(content)
    got = {r["file_name"]: (r["bytes"], r["sha256"]) for r in digests.file_fingerprints(spark, str(tmp_path), ("csv",)).collect()}
    assert got == {n.split("/")[-1]: (len(c), hashlib.sha256(c).hexdigest()) for n, c in contents.items() if c and n != "skip.txt"}
    assert digests.file_fingerprints(spark, str(tmp_path), ("none",)).collect() == []


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = (1 << 31) + 12_345
    with open(tmp_path / "big.csv", "wb") as out:
        # without blocks on disk
        out.truncate(size)
    digest = hashlib.sha256()
    for _ in range(size // (1 << 20)):
        digest.update(bytes(1 << 20))
    digest.update(bytes(size % (1 << 20)))
    row = digests.file_fingerprints(spark, str(tmp_path), ("csv",)).collect()[0]
    assert (row["bytes"], row["sha256"]) == (size, digest.hexdigest())


def test_stores_that_tasks_cannot_open_are_left_to_spark(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_bytes(b"abc")
    monkeypatch.setattr(digests, "reachable", lambda _: False)
    row = digests.file_fingerprints(spark, str(tmp_path), ("csv",)).collect()[0]
    assert (row["file_name"], row["bytes"], row["sha256"]) == ("a.csv", 3, hashlib.sha256(b"abc").hexdigest())
