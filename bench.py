"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR  folder of the tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)

Each query runs once to warm up and once timed, into a sink that keeps nothing, so plans
are executed completely and results are not collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerline.plans import fork_queries, mine_queries  # noqa: E402
from ledgerline.plans.queries import QUERIES  # noqa: E402
from ledgerline.session import build_session  # noqa: E402

HEADLINES = (
    "daily_spend",
    "corpus_summary",
    "token_classes",
    "attribution",
    "attribution_context",
    "session_usage",
    "idle_gaps",
    "turn_buckets",
    "growth_fifths",
    "compaction_asof",
    "billing_dedup",
    "structure_union",
    "price_lookup",
    "lane_count",
    "lanes",
    "activity_bands",
    "live_spans",
    "replay_fold",
    "export_roundtrip",
    "fork_edges",
    "mine_turns",
    "mine_replay",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINES
    spark = build_session("ledgerline-bench", os.environ.get("BENCH_CPUS", "8"))
    seconds = {}
    for name in wanted:
        for _ in range(2):
            # Mined grains and resolved forks are normally shared; here every run is whole.
            mine_queries._DONE.clear()
            fork_queries._DONE.clear()
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
