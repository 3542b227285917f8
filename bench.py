"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed to completion with the ``noop`` sink (full plan, no
driver collect): one discarded warm-up run, then the median of
$BENCH_RUNS timed runs. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "daily_sales", "top_products", "customer_metrics", "sales_summary", "sales_report",
    "low_stock", "inventory_value", "inventory_summary", "customer_acquisition", "top_customers",
    "region_directory", "shipping_option_directory", "region_audit", "store_directory",
    "region_survivor", "dedupe_region_children", "upsert_countries", "patch_rows",
    "order_enriched", "purchase_conversion", "ga_purchase", "cart_enriched", "ga_add_to_cart",
    "request_rate_windows", "seed_catalog",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]

    from cartwheel.plans.registry import queries
    from cartwheel.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    qs = queries()
    names = only or HEADLINE
    timings: dict[str, float] = {}
    for name in names:
        fn = qs[name]

        def once() -> float:
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()  # warm-up: JIT, file listing, codegen caches
        timings[name] = round(statistics.median(once() for _ in range(runs)), 4)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_median_query_time",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": int(cpus),
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
