"""Registered queries of the subpackage against their SQL."""

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path.insert(0, str(ROOT / "tools"))

import check  # noqa: E402

from tidemark.llm.queries import ORACLES, QUERIES  # noqa: E402

SF_DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, monkeypatch, name):
    monkeypatch.setattr(check, "QUERIES", QUERIES)
    monkeypatch.setattr(check, "ORACLES", ORACLES)
    ok, note, _ = check.compare(spark, check.connect(SF_DIR), name, SF_DIR)
    assert ok, note


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(entry.queries())
