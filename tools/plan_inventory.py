"""Summarise the physical plan of every registered query (docs/PLANS.md).

For each key: shuffles (Exchange), broadcast exchanges, join strategies,
partial aggregations, whether scans carry pushed filters, and the widest
ReadSchema. Plans are the pre-execution plans at the given scale, so
AQE may still turn a sort-merge join into a broadcast join at run time.

    python tools/plan_inventory.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cartwheel.plans import registry  # noqa: E402
from cartwheel.session import local_session  # noqa: E402

SKIP = {"conversion_outbox", "report_sink", "table_writeback", "load_tables", "event_delivery", "dead_letters", "daily_sales_rollup",
        "limiter_windows", "patch_by_file", "seed_documents", "customers_in_periods", "top_products_bucketed"}  # these run jobs while building the frame
# dedupe_regions / dedupe_region_children checkpoint their survivor mapping first, so their plans start
# from the checkpointed rows.


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(8)
    print(f"# Physical plans at {os.path.basename(sf_dir)}\n")
    print("Generated by `tools/plan_inventory.py`. Columns: shuffles = `Exchange` nodes (hash/range/single), "
          "bcast = `BroadcastExchange`, joins by strategy, partial = partial aggregations (map-side combine), "
          "pushed = scans with pushed filters / all scans.\n")
    print("| key | shuffles | bcast | SMJ | BHJ | partial aggs | pushed / scans |")
    print("|---|---|---|---|---|---|---|")
    for name, fn in sorted(registry.queries().items()):
        if name in SKIP:
            continue
        buf = io.StringIO()
        with contextlib.redirect_stdout(buf):
            fn(spark, sf_dir).explain("formatted")
        plan = buf.getvalue()
        tree = plan.split("\n\n")[0]
        shuffles = len(re.findall(r"(?<![A-Za-z])Exchange \(", tree))
        bcast = len(re.findall(r"BroadcastExchange \(", tree))
        smj = tree.count("SortMergeJoin")
        bhj = tree.count("BroadcastHashJoin")
        partial = len(re.findall(r"Aggregate \(\d+\)", tree)) // 2
        scans = len(re.findall(r"^\(\d+\) Scan parquet", plan, flags=re.M))
        pushed = len([ln for ln in plan.splitlines() if ln.startswith("PushedFilters") and ln.strip() != "PushedFilters: []"])
        print(f"| `{name}` | {shuffles} | {bcast} | {smj} | {bhj} | {partial} | {pushed} / {scans} |")
    spark.stop()


if __name__ == "__main__":
    main()
