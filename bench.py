"""Benchmark: run the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is executed completely with the no-op sink (no driver collect).
The table store lives in a fresh scratch folder per run, so the ingest query
pays for extraction and both state writes.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "ingest_two_runs",          # extraction of both snapshots + dedup + upsert + soft delete, written
    "extract_promotions",       # full normalisation of the feed (T/M/D/X/U1)
    "discount_stats",
    "upsert_run_counts",
    "upsert_batch_repeats",
    "filter_combined",
    "page_title_asc_p2",
    "facets",
    "coverage_report",
    "missing_merchant_samples",
    "run_state_fold",
    "repeated_failures",
    "page_tiles",
    "payload_items",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    scratch = tempfile.mkdtemp(prefix="promospark-bench-")
    from promospark.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2,
                      extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                             "spark.driver.memory": "16g"})
    from promospark.plans.catalog import REGISTRY
    from promospark.plans import ingest as I
    times: dict[str, float] = {}
    for name in HEADLINE:
        t0 = time.time()
        if name == "ingest_two_runs":
            I.promotions_table(spark, sf_dir).write.format("noop").mode("overwrite").save()
        elif name in REGISTRY:
            REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        else:
            continue
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
