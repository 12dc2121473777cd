"""Benchmark: headline fusion queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value", "unit", "queries", "sf"}.
Each query is fully executed into Spark's no-op sink (no collect).  The JVM is
warm (one small query runs first); caches are cleared before every query.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from rankmix.plans import catalog  # noqa: E402
from rankmix.session import get_spark  # noqa: E402

HEADLINE = [
    "base_accuracy",
    "weights_all",
    "layer_accuracy",
    "score_combination",
    "rank_combination",
    "vote_fused_accuracy",
    "vote_combinations",
    "per_class_accuracy",
    "reg_fusion",
    "reg_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_spark(f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # warm the JVM once (class loading, first codegen) on the smallest query
    catalog.QUERIES["base_accuracy"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        spark.catalog.clearCache()
        t0 = time.time()
        df = catalog.QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "fusion_headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
