"""Per-stage times of one registered query from Spark's event log.

Runs the query (noop sink) with the event log written to a fresh scratch
folder, then reads the log's stage-completion events: duration, task count,
input, shuffle read and shuffle write per stage. No UI or REST endpoint is
used.

    python tools/stage_times.py <query_key> [sf_dir]
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    key = sys.argv[1]
    sf_dir = sys.argv[2] if len(sys.argv) > 2 else "/root/testdata/sf0.1"
    log_dir = tempfile.mkdtemp(prefix="cartwheel-eventlog-")
    from pyspark.sql import SparkSession

    from cartwheel.plans.registry import queries
    from cartwheel.session import RUNTIME_CONF
    b = (SparkSession.builder.master("local[8]").appName("stage-times")
         .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.python.sql.dataFrameDebugging.enabled", "false")
         .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
         .config("spark.eventLog.compress", "false"))
    for k, v in RUNTIME_CONF.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries()[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.stop()

    stages = []
    files = [p for p in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(p) and "events_" in os.path.basename(p)]
    for path in files:
        with open(path) as f:
            for line in f:
                ev = json.loads(line)
                if ev.get("Event") != "SparkListenerStageCompleted":
                    continue
                info = ev["Stage Info"]
                acc = {a.get("Name"): a.get("Value") for a in info.get("Accumulables", [])}
                stages.append((info["Stage ID"], info["Number of Tasks"],
                               info["Completion Time"] - info["Submission Time"],
                               acc.get("internal.metrics.input.bytesRead", 0),
                               acc.get("internal.metrics.shuffle.read.remoteBytesRead", 0)
                               + acc.get("internal.metrics.shuffle.read.localBytesRead", 0),
                               acc.get("internal.metrics.shuffle.write.bytesWritten", 0),
                               info["Stage Name"].split(" at ")[0]))
    print(f"| stage | tasks | ms | input KB | shuffle read KB | shuffle write KB | op |")
    print("|---|---|---|---|---|---|---|")
    for s in sorted(stages):
        print(f"| {s[0]} | {s[1]} | {s[2]} | {s[3] // 1024} | {s[4] // 1024} | {s[5] // 1024} | {s[6]} |")
    print(f"\n{len(stages)} stages, {sum(s[2] for s in stages)} ms summed stage time")


if __name__ == "__main__":
    main()
