"""Registered queries against their SQL in DuckDB.

A few of every section by default; all of them with TIDEMARK_ALL_QUERIES=1.
"""

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT / "tools"))

from check import compare, connect  # noqa: E402

from tidemark.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"
SOME = [
    "flagship_leaderboard", "s1_read_delimited_offsets", "s5_explode_json_items", "p19_contract_month",
    "p25_conform_source_capacity", "x12_redact_headers", "w4_lag_hourly", "w13_dedup_log", "j5_curve_points",
    "a8_volume_mix", "o5_except_keys", "v1_duplicate_keys", "b7_backtest_matrix", "m8_ridge_from_stats", "b6_walk_forward_imputed", "b7_backtest_matrix_imputed", "m11_cross_validate_imputed",
    "e11_annotate_status", "f1_next_forecast", "f6_hourly_feature_table", "g1_ingest_inbox", "g2_current_view",
]
# the ranges of the operator inventory
INVENTORY = {"s": 15, "p": 27, "x": 15, "w": 18, "j": 12, "a": 20, "o": 5, "v": 8, "b": 8, "m": 11, "e": 13, "f": 6, "g": 2}

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("TIDEMARK_ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, con, name):
    ok, note, _ = compare(spark, con, name, SF_DIR)
    assert ok, note


def test_every_operator_of_the_inventory_has_a_query():
    heads = {name.split("_")[0] for name in QUERIES}
    wanted = {f"{letter}{i}" for letter, n in INVENTORY.items() for i in range(1, n + 1)}
    assert not wanted - heads
    assert set(ORACLES) <= set(QUERIES)


def test_entry_points(spark):
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.queries()) >= set(QUERIES) and set(entry.oracle_sql()) >= set(ORACLES)
