"""Times the headline queries: one warm-up, then the median of three runs each, one JSON line at the end."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketlens.registry import spark_queries  # noqa: E402
from marketlens.session import build_session  # noqa: E402

HEADLINE = [
    "fair_prices",
    "devig",
    "edges",
    "selection_best",
    "market_hold",
    "odds_board",
    "board_as_of",
    "price_history",
    "recent_moves",
    "movement_features",
    "append_changes",
    "replay_changes",
    "trader_scores",
    "market_flow",
    "build_candidates",
    "calibration_curves",
    "label_snapshots",
    "grade_selections",
    "strategy_performance",
    "accrue_positions",
    "schedule_context",
    "resolve_teams",
    "resolve_events",
    "web_overview",
    "top_products",
    "sale_pricing",
    "stream_quote_changes",
]
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def timed(build) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("marketlens-bench", cpus, int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    runs = spark_queries()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        timed(lambda: runs[name](spark, sf_dir))
        seconds[name] = round(statistics.median(timed(lambda: runs[name](spark, sf_dir)) for _ in range(RUNS)), 3)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}
        )
    )


if __name__ == "__main__":
    main()
