"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built and fully computed end to end (fits included) and its
result is consumed by Spark's ``noop`` sink, so every column is produced
without shipping rows to the driver. A small warm-up run on sf0.001 (JVM
start, first code generation) is not counted. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["features", "dq_errors", "schema_report", "batch_results", "top_factors", "reports",
            "cv_summary", "attributions_gbt"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [a for a in sys.argv[1:]] or HEADLINE
    from nightjar.plans import catalog
    from nightjar.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="nightjar-bench")
    queries = catalog.queries()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        queries["batch_results"](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
