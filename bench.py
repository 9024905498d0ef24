"""Times the headline queries: prints one JSON line. BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS are read from the environment."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = [
    "item_shards", "item_rank", "text_clean_scoring", "text_audit", "match_strict_relaxed", "completeness", "referential_both_ways", "describe_lengths", "per_split", "lexicon_topk",
    "validate_rules", "box_clip", "box_number", "last_wins", "regroup_nested", "layouts", "latency_summary", "score_by_type", "resize_plan", "resume_todo",
]


def main() -> None:
    os.environ["PYTHONPATH"] = f"{os.path.dirname(os.path.abspath(__file__))}:{os.environ.get('PYTHONPATH', '')}"
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillspark.plans import catalog

    took = {}
    for name in HEADLINE:
        times = []
        for i in range(RUNS + 1):  # the first is a warm-up
            began = time.perf_counter()
            catalog.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        took[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "sum of median query seconds", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF_DIR.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
