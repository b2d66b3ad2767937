"""Specifications of the market and weather files, by source.

Everything below is configuration: fixed vendor headers, labels and formats, and the
canonical columns they become. Spreadsheets are to be exported to delimited text first.
"""

from __future__ import annotations

from tidemark.sources.spec import Category, Melt, Period, SourceSpec

_META = "source_id string, collected_at timestamp_ntz, source_file string, source_file_sha256 string, source_priority int"


def _schema(columns: str) -> str:
    return f"{columns}, {_META}"


# fixed values: labels of areas, totals and fuels
AREA_ALIASES = {
    "mainland": "mainland", "육지": "mainland", "jeju": "jeju", "제주": "jeju",
    "integrated": "integrated", "통합": "integrated",
}
TOTAL = "합계"
YEARLY_TOTAL = "총계"
COMMON_FUELS = {
    "원자력": "nuclear", "유류": "oil", "LNG": "lng", "양수": "pumped_storage", "기타": "other",
}
COALS = {"유연탄": "coal_bituminous", "무연탄": "coal_anthracite"}
SETTLEMENT_FUELS = {
    **COMMON_FUELS, "석탄_유연탄": "coal_bituminous", "석탄_무연탄": "coal_anthracite", "석탄_계": "coal_total",
    "신재생_계": "renewable", TOTAL: "total",
}
CAPACITY_FUELS = {
    **COMMON_FUELS, **COALS, TOTAL: "total",
    "신재생|태양": "renewable_solar", "신재생|풍력": "renewable_wind", "신재생|수력": "renewable_hydro",
    "신재생|해양": "renewable_marine", "신재생|바이오": "renewable_bio", "신재생|폐기물": "renewable_waste",
    "신재생|연료전지": "renewable_fuel_cell", "신재생|석탄가스화": "renewable_igcc",
}
GENERATION_TYPES = {
    "원자력": "nuclear", "양수": "pumped_storage", "신재생": "renewable", "기타": "other", TOTAL: "total",
    "기력|유연탄": "steam_coal_bituminous", "기력|무연탄": "steam_coal_anthracite",
    "기력|유류": "steam_oil", "기력|가스": "steam_gas",
    "복합화력|유류": "combined_oil", "복합화력|가스": "combined_gas",
    "내연력|유류": "internal_combustion_oil", "내연력|가스": "internal_combustion_gas",
}
HOURLY_FUELS = {**COMMON_FUELS, **COALS, "신재생": "renewable"}
DAILY_FUELS = {
    **COMMON_FUELS, **COALS, "태양광": "renewable_solar", "풍력": "renewable_wind", "수력": "renewable_hydro",
    "해양": "renewable_marine", "연료전지": "renewable_fuel_cell", "폐기물": "renewable_waste",
    "바이오가스": "renewable_biogas", "바이오매스": "renewable_biomass", "바이오SRF": "renewable_bio_srf",
}
YEARLY_COLUMNS = {
    "원자력": "capacity_yearly_nuclear_mw", "신재생": "capacity_yearly_renewable_mw", YEARLY_TOTAL: "capacity_yearly_total_mw",
    "기력|계": "capacity_yearly_steam_total_mw", "복합화력|계": "capacity_yearly_combined_total_mw",
}

_AREAS = {"smp_mainland": "mainland", "smp_jeju": "jeju", "smp_integrated": "integrated"}
_MEMBER = {
    "period": "기간", "member_type": "회원구분", "dispatch_type": "급전방식", "business_type": "사업구분", "region": "지역",
}
_MEMBER_IDS = ("period_month", "member_type", "dispatch_type", "business_type", "region")
_ALL_MEMBERS = {c: TOTAL for c in ("member_type", "dispatch_type", "business_type", "region")}
_MEMBER_SCHEMA = "period_month date, member_type string, dispatch_type string, business_type string, region string"


def _area_prices(source_id: str, mapping: dict[str, str], period: Period, priority: int, header_rows: int) -> SourceSpec:
    return SourceSpec(
        source_id=source_id,
        schema=_schema("period_month date, area string, smp_krw_per_kwh double"),
        mapping=mapping,
        period=period,
        ids=("period_month",),
        melt=Melt("smp_krw_per_kwh", tuple(_AREAS), var="area_raw"),
        category=Category(("area_raw",), "area", _AREAS),
        zero_is_missing="smp_krw_per_kwh",
        priority=priority,
        encoding="cp949",
        file_format="csv",
        header_rows=header_rows,
    )


def _monthly_series(source_id: str, value: str) -> SourceSpec:
    return SourceSpec(
        source_id=source_id,
        schema=_schema(f"period_month date, {value} double"),
        mapping={"period_month": "period_month", value: value},
        period=Period("day", ("period_month",), "%Y-%m-%d"),
        measures=(value,),
        required=(value,),
        priority=1,
        file_format="csv",
    )


WEATHER_MEASURES = (
    "hour_count", "temp_mean", "temp_std", "temp_min", "temp_max", "humidity_mean", "cloud_cover_mean",
    "wind_speed_mean", "rainfall_sum",
)
REC_HEADERS = {
    "trade_date": "거래일", "rec_volume": "체결 수량", "avg_price_krw": "평균가", "total_amount_krw": "체결총액",
    "open_price_krw": "시작가", "close_price_krw": "종가", "base_price_krw": "기준가", "high_price_krw": "최고가",
    "low_price_krw": "최저가",
}
_REC_MEASURES = tuple(c for c in REC_HEADERS if c != "trade_date")
GRID_HEADERS = {
    "kind": "구분", "admin_code": "행정구역코드", "level1": "1단계", "level2": "2단계", "level3": "3단계",
    "nx": "격자 X", "ny": "격자 Y", "lng_deg": "경도(시)", "lng_min": "경도(분)", "lng_sec": "경도(초)",
    "lat_deg": "위도(시)", "lat_min": "위도(분)", "lat_sec": "위도(초)",
}
_GRID_MEASURES = tuple(c for c in GRID_HEADERS if c.split("_")[0] in ("nx", "ny", "lng", "lat"))

_SPECS = (
    _area_prices(
        "smp_monthly_official",
        {"year": "년도", "month": "월", "smp_mainland": "육지계통한계가격", "smp_jeju": "제주계통한계가격",
         "smp_integrated": "통합계통한계가격"},
        Period("parts", ("year", "month")), 1, 0,
    ),
    _area_prices(
        "smp_monthly_fallback",
        {"period": "기간", "smp_mainland": "SMP|육지", "smp_jeju": "SMP|제주", "smp_integrated": "SMP|통합"},
        Period("month", ("period",), "%Y/%m"), 2, 2,
    ),
    SourceSpec(
        source_id="settlement_monthly",
        schema=_schema("period_month date, fuel_type string, settlement_unit_price_krw_per_kwh double"),
        mapping={"period": "기간"},
        period=Period("month", ("period",), "%Y/%m", strict=True),
        ids=("period_month",),
        melt=Melt("settlement_unit_price_krw_per_kwh", tuple(SETTLEMENT_FUELS), var="fuel_type_raw"),
        category=Category(("fuel_type_raw",), "fuel_type", SETTLEMENT_FUELS),
        required=("settlement_unit_price_krw_per_kwh",),
        priority=1,
        file_format="csv",
    ),
    SourceSpec(
        source_id="rec_trading_day",
        schema=_schema("trade_date date, " + ", ".join(f"{c} double" for c in _REC_MEASURES)),
        mapping=REC_HEADERS,
        period=Period("day", ("trade_date",), "%Y-%m-%d", out="trade_date"),
        measures=_REC_MEASURES,
        priority=1,
        encoding="cp949",
        file_format="csv",
    ),
    SourceSpec(
        source_id="capacity_yearly_by_energy_source",
        schema=_schema(
            "period_year int, row_category string, capacity_category_level1 string, "
            "capacity_category_level2 string, capacity_mw double"
        ),
        mapping={"row_category": "구분"},
        period=Period("filename_year", fmt=r"\((\d{4})\)", out="period_year"),
        ids=("period_year", "row_category"),
        melt=Melt("capacity_mw", level1="capacity_category_level1", level2="capacity_category_level2"),
        required=("row_category", "capacity_mw"),
        priority=1,
        encoding="cp949",
        file_format="csv",
        header_rows=2,
    ),
    SourceSpec(
        source_id="capacity_monthly_by_generation_type",
        schema=_schema(
            f"{_MEMBER_SCHEMA}, capacity_type_level1 string, capacity_type_level2 string, "
            "capacity_type_canonical string, capacity_mw double"
        ),
        mapping=_MEMBER,
        totals=_ALL_MEMBERS,
        period=Period("month", ("period",), "%Y/%m", strict=True),
        ids=_MEMBER_IDS,
        melt=Melt("capacity_mw", level1="capacity_type_level1", level2="capacity_type_level2"),
        category=Category(
            ("capacity_type_level1", "capacity_type_level2"), "capacity_type_canonical", GENERATION_TYPES, required=False
        ),
        required=("capacity_mw",),
        priority=1,
        encoding="cp949",
        file_format="csv",
        header_rows=2,
    ),
    SourceSpec(
        source_id="capacity_monthly_by_fuel",
        schema=_schema(f"{_MEMBER_SCHEMA}, fuel_type_raw string, fuel_type string, capacity_mw double"),
        mapping=_MEMBER,
        totals=_ALL_MEMBERS,
        period=Period("month", ("period",), "%Y/%m", strict=True),
        ids=_MEMBER_IDS,
        melt=Melt("capacity_mw", joined="fuel_type_raw"),
        category=Category(("fuel_type_raw",), "fuel_type", CAPACITY_FUELS),
        required=("capacity_mw",),
        priority=1,
        encoding="cp949",
        file_format="csv",
        header_rows=2,
    ),
    SourceSpec(
        source_id="transaction_volume_hourly",
        schema=_schema(
            "trade_date date, trade_hour int, interval_end timestamp_ntz, fuel_type_raw string, fuel_type string, "
            "transaction_volume_mwh double"
        ),
        mapping={"trade_date": "거래일", "trade_hour": "거래시간", "fuel_type_raw": "연료원",
                 "transaction_volume_mwh": "전력거래량(MWh)"},
        period=Period("day", ("trade_date",), "%Y-%m-%d", out="trade_date"),
        hour="trade_hour",
        measures=("transaction_volume_mwh",),
        category=Category(("fuel_type_raw",), "fuel_type", HOURLY_FUELS),
        priority=1,
        encoding="cp949",
        file_format="csv",
    ),
    SourceSpec(
        source_id="transaction_amount_daily",
        schema=_schema("trade_date date, fuel_type_raw string, fuel_type string, transaction_amount_krw double"),
        mapping={"trade_date": "거래일", "fuel_type_raw": "연료원", "transaction_amount_krw": "전력거래금액(원)"},
        period=Period("day", ("trade_date",), "%Y-%m-%d", out="trade_date"),
        measures=("transaction_amount_krw",),
        category=Category(("fuel_type_raw",), "fuel_type", DAILY_FUELS),
        priority=1,
        encoding="cp949",
        file_format="csv",
    ),
    _monthly_series("lng_price_monthly", "lng_price_usd_per_mmbtu"),
    _monthly_series("oil_price_monthly", "oil_price_usd_per_bbl"),
    _monthly_series("fx_usd_krw_monthly", "usd_krw_monthly_avg"),
    SourceSpec(
        source_id="lng_daily_history",
        schema=_schema("trade_date date, close double, open double, high double, low double, volume double, change_pct double"),
        mapping={"trade_date": "Date", "close": "Price", "open": "Open", "high": "High", "low": "Low",
                 "volume": "Vol.", "change_pct": "Change %"},
        period=Period("day", ("trade_date",), "%m/%d/%Y", out="trade_date"),
        measures=("close", "open", "high", "low", "volume"),
        percents=("change_pct",),
        required=("close",),
        priority=1,
        file_format="csv",
    ),
    SourceSpec(
        source_id="lng_futures_curve",
        schema=_schema(
            "quote_date date, quote_time_ct string, contract_code string, contract_month_label string, "
            "contract_month date, prior_settle double, volume double"
        ),
        mapping={"quote_date": "Date", "quote_time_ct": "Time_CT", "contract_code": "Code",
                 "contract_month_label": "Month", "prior_settle": "Prior_Settle", "volume": "Volume"},
        period=Period("day", ("quote_date",), "%d %b %Y", out="quote_date"),
        measures=("prior_settle", "volume"),
        contract=("contract_month_label", "contract_code", "quote_date"),
        required=("contract_month", "prior_settle"),
        priority=1,
        file_format="csv",
    ),
    SourceSpec(
        source_id="weather_monthly",
        schema=_schema("period_month date, region_name string, " + ", ".join(f"{c} double" for c in WEATHER_MEASURES)),
        mapping={c: c for c in ("period_month", "region_name", *WEATHER_MEASURES)},
        period=Period("day", ("period_month",), "%Y-%m-%d"),
        measures=WEATHER_MEASURES,
        required=("region_name",),
        priority=1,
        file_format="csv",
    ),
    SourceSpec(
        source_id="forecast_grid",
        schema=_schema(
            "kind string, admin_code string, level1 string, level2 string, level3 string, nx int, ny int, "
            + ", ".join(f"{c} double" for c in _GRID_MEASURES if c not in ("nx", "ny"))
        ),
        mapping=GRID_HEADERS,
        measures=_GRID_MEASURES,
        required=("nx", "ny", "level1"),
        priority=1,
        file_format="csv",
    ),
)

SPECS = {s.source_id: s for s in _SPECS}
