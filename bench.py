"""Times the headline queries over whole tables and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default 8).
Every result is written to the no-op sink, so each row is computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "orders_per_minute", "revenue_by_product_location", "fulfillment_success_rate", "fulfillment_latency",
    "inventory_reservation_failure_rate", "stockout_frequency", "late_order_rate", "product_demand_by_window",
    "dead_letter_volume", "lakehouse_orders_per_minute", "silver_routed_counts", "dq_rates", "causation_orphans",
    "stock_sufficiency", "node_selection", "reservation_allocation", "state_replay", "transition_audit",
    "idempotency_resolution", "order_lifecycle", "request_rate", "latency_summary", "rate_limit_replay",
    "demand_history", "lag_rolling_features", "forecast_metrics", "baseline_forecast",
)


def main() -> None:
    from tidewater.plans.catalog import QUERIES
    from tidewater.session import build_session

    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus),
        extra={"spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
               "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in wanted:
        started = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": Path(root).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
