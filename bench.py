"""Wall-clock of the headline queries; prints one JSON line.

Each query is computed in full by writing it to Spark's no-op sink. One small query warms the
session up first, then each query is run twice and the better time counts.
"""

from __future__ import annotations

import json
import os
import re
import time

from wearpath.plans import catalog
from wearpath.session import local_session

HEADLINE = [
    "flagship_enrich",
    "w1_w2_trailing",
    "w1_w2_line_items",
    "w3_forward_by_mode",
    "w4_p14_full_window_filled",
    "p12_rul_truth",
    "j1_attach_mode",
    "m3_minmax",
    "a3_describe",
    "a6_correlations",
    "a7_histogram",
    "a8_density",
    "a9_quadratic_trend",
    "a17_report",
    "l5_pick_units",
    "s1_text_scan",
    "job_prepare_train",
    "m1_modes",
    "m6_logistic",
    "m8_forest",
]


def run(query, spark, folder) -> float:
    start = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, name="bench")
    run(catalog.QUERIES["p9_labels"], spark, folder)
    seconds = {}
    for name in HEADLINE:
        query = catalog.QUERIES[name]
        seconds[name] = round(min(run(query, spark, folder) for _ in range(2)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if (scale := re.search(r"sf(\d+(?:\.\d+)?)/?$", folder)) else None,
            }
        )
    )


if __name__ == "__main__":
    main()
