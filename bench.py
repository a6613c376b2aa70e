"""Time the registered queries and print one JSON line.

Settings: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_QUERIES (names, comma separated).
Each query runs in full into Spark's discarding sink; the best of BENCH_RUNS (2) runs counts.
"""

import json
import os
import re
import time

from mascate.plans.registry import QUERIES
from mascate.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "2"))
NAMES = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)


def main() -> None:
    spark = local_session(CPUS, app="bench")
    spark.read.parquet(f"{SF_DIR}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    timings: dict[str, float] = {}
    for name in NAMES:
        best = float("inf")
        for _ in range(RUNS):
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        timings[name] = round(best, 3)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(
        json.dumps(
            {
                "metric": "total time of all report queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale[1]) if scale else None,
            }
        ),
        flush=True,
    )
    spark.stop()


if __name__ == "__main__":
    main()
