"""Hot-key check: one site holds a third of the rows.

Builds site events from the lineitem table (every third line goes to site
``HOT``), runs the one-pass site table, the first-row dedupe, per-site token
frequencies and per-site counts with the large-input plan (small-input
switch off), and reports per-stage task counts, longest task and
shuffle-read skew from Spark's event log.

Usage: ``python tools/skew_check.py [sf_dir] [event_log_dir]``.
"""

from __future__ import annotations

import glob
import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    log_dir = sys.argv[2] if len(sys.argv) > 2 else tempfile.mkdtemp(prefix="skew-")
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    spark = (SparkSession.builder.master("local[8]").appName("skew-check")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.sql.shuffle.partitions", "16")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", log_dir)
             .config("spark.eventLog.compress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from shoreline.operators.aggregate import site_lists_with_counts
    from shoreline.operators.dedupe import first_by
    from shoreline.sources.readers import read_table

    li = read_table(spark, sf, "lineitem").repartition(16)  # several map tasks, as at scale
    ev = li.select(
        F.when(F.col("l_orderkey") % 3 == 0, F.lit("HOT"))
         .otherwise(F.concat(F.lit("s"), F.col("l_partkey").cast("string"))).alias("site"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"),
        F.concat(F.col("l_returnflag"), F.lit(","), F.col("l_linestatus")).alias("flags"),
        F.col("l_quantity").cast("long").alias("qty"))
    runs = {}
    from shoreline.operators.aggregate import summarize_counts
    from shoreline.operators.explode import token_frequency

    for name, df in [
        ("site_table", site_lists_with_counts(ev, ["site"], "site", {"flags": "flags"}, "ord",
                                              "n", {"qty": "qty"})),
        ("first_by", first_by(ev, ["site"], "ord")),
        ("token_frequency", token_frequency(ev, "flags", by=["site"])),
        ("summarize_counts", summarize_counts(ev, ["site"], "n", {"qty": "qty"})),
    ]:
        t0 = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        runs[name] = round(time.perf_counter() - t0, 2)
    spark.stop()

    tasks: dict[int, list[tuple[int, int]]] = {}
    names = {}
    files = [f for f in glob.glob(os.path.join(log_dir, "**", "*"), recursive=True) if os.path.isfile(f)]
    for f in files:
        for line in open(f):
            e = json.loads(line)
            if e.get("Event") == "SparkListenerTaskEnd":
                m = e.get("Task Metrics") or {}
                read = (m.get("Shuffle Read Metrics") or {})
                rbytes = read.get("Remote Bytes Read", 0) + read.get("Local Bytes Read", 0)
                info = e["Task Info"]
                tasks.setdefault(e["Stage ID"], []).append((info["Finish Time"] - info["Launch Time"], rbytes))
            if e.get("Event") == "SparkListenerStageCompleted":
                names[e["Stage Info"]["Stage ID"]] = e["Stage Info"]["Stage Name"][:40]
    print(json.dumps({"seconds": runs}))
    for sid in sorted(tasks):
        t = tasks[sid]
        if len(t) < 2:
            continue
        reads = sorted(b for _, b in t)
        med = reads[len(reads) // 2] or 1
        print(f"stage {sid:3d} tasks {len(t):3d} longest {max(d for d, _ in t):5d} ms "
              f"shuffle read max {reads[-1]:9d} B, max/median {reads[-1] / med:7.2f}")


if __name__ == "__main__":
    main()
