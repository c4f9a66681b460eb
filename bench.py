"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs per query (after one warm-up; the median counts) and ``BENCH_QUERIES`` a comma-separated
choice of queries, or ``all``.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewell.catalog import QUERIES  # noqa: E402
from tidewell.session import get_session  # noqa: E402

HEADLINE = (
    "q05_covered_call_portfolio",
    "q11_normalize_and_drawdown",
    "q15_downside_risk_table",
    "q16_capm_table",
    "q18_tail_dependence_table",
    "q21_weekly_net_flows",
    "q24_weekly_new_users",
    "q28_directed_crossover",
    "q31_log_histogram_swaps_per_wallet",
    "q32_inverse_cdf_swaps",
    "q35_top_assets",
    "q36_top_assets_by_dex",
    "q37_canonical_pool_swaps",
    "q40_origination_share_volume",
    "q41_tvl_metrics",
    "q45_reconcile_tvl",
    "q46_value_lp_positions",
    "q49_league_table_pool",
    "q50_lp_density_pool",
    "q50_lp_ecdf_pool",
    "q50_lp_histogram_pool",
    "q55_asset_flow_summary",
    "q56_weekly_dense_counts_from",
    "q57_focus_groups",
    "u1_wallet_swap_stats",
    "u5_ledger_balances",
    "w13_number_rows",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = get_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": "8" if cpus == "*" else cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, sf_dir, name)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
