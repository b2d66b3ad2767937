"""Time the headline queries and print one JSON line.

Every query is planned and run to the end into the no-op sink, so all rows and columns are
computed. Settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_QUERIES (comma-separated names).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.queries import QUERIES  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINE = [
    "flagship_leaderboard", "w1_hourly_grid", "w4_lag_hourly", "w6_roll_hourly", "w7_roll_monthly",
    "w9_exogenous_lag", "w12_dedup_revisions", "w13_dedup_log", "w16_top_k_per_group", "a1_hourly_to_monthly",
    "a3_daily_price_lags", "a6_capacity_mix", "a8_volume_mix", "a17_seasonal_quartiles", "j1_join_blocks",
    "j4_asof_latest", "j5_curve_points", "v1_duplicate_keys", "v4_leakage_canary", "p2_coerce_numeric",
    "p25_conform_source_volume", "x12_redact_credentials", "s11_upsert", "b6_walk_forward", "b7_backtest_matrix",
    "m5_fit_ridge", "m8_ridge_from_stats", "m11_cross_validate", "e5_peak_scores", "e11_annotate_status",
    "f5_monthly_feature_table", "f6_hourly_feature_table", "g1_ingest_inbox",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    conf = {
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        # call sites of every column expression are only of use while debugging
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    spark = build_session("tidemark-bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderpriority").count().collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
