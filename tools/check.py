"""Run registered queries next to their SQL in DuckDB and compare names, types and values.

    python tools/check.py [--sf DIR] [--plan] [prefix ...]
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import SparkSession  # noqa: E402

from tidemark.queries import ORACLES, QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "NaN" if math.isnan(value) else repr(value + 0.0)
    return repr(value)


def _rows(table) -> tuple[list[str], dict[str, str], list[tuple]]:
    names = sorted(table.column_names)
    types = {n: str(table.schema.field(n).type).replace("large_", "") for n in names}
    columns = [table.column(n).to_pylist() for n in names]
    rows = sorted(tuple(_cell(v) for v in row) for row in zip(*columns)) if columns else []
    return names, types, rows


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> tuple[bool, str, float]:
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = df.toArrow()
    took = time.time() - start
    if name not in ORACLES:
        return got.num_rows > 0, f"rows only: {got.num_rows}", took
    want = con.sql(ORACLES[name]).to_arrow_table()
    g_names, g_types, g_rows = _rows(got)
    w_names, w_types, w_rows = _rows(want)
    if g_names != w_names:
        return False, f"columns {g_names} != {w_names}", took
    note = "; ".join(f"{n}: {g_types[n]} vs {w_types[n]}" for n in g_names if g_types[n] != w_types[n])
    if len(g_rows) != len(w_rows):
        return False, f"rows {len(g_rows)} != {len(w_rows)}", took
    if g_rows != w_rows:
        bad = [(g, w) for g, w in zip(g_rows, w_rows) if g != w]
        cols = [n for i, n in enumerate(g_names) if any(g[i] != w[i] for g, w in bad)]
        return False, f"{len(bad)} rows differ in {cols}\n   got  {bad[0][0]}\n   want {bad[0][1]}", took
    if not g_rows:
        return False, "no rows", took
    return True, f"{len(g_rows)} rows" + (f"; TYPES {note}" if note else ""), took


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("--plan", action="store_true")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    bad = 0
    chosen = [n for n in QUERIES if not args.names or any(n.startswith(p) for p in args.names)]
    for name in chosen:
        if args.plan:
            print("==", name)
            QUERIES[name](spark, args.sf).explain("formatted")
            continue
        try:
            ok, note, took = compare(spark, con, name, args.sf)
        except Exception as exc:  # noqa: BLE001 - a failing query must not hide the others
            ok, note, took = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:34s} {took:6.2f}s {note}", flush=True)
    print(f"{len(chosen) - bad}/{len(chosen)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
