"""Headline queries, timed once each after a warm-up on the smallest data.

Environment: ``BENCH_SF_DIR`` (default sf0.1), ``BENCH_CPUS`` (default 8). Prints one JSON
line. Every query is run to the end: all columns of all result rows are produced.
"""

from __future__ import annotations

import json
import os
import re
import tempfile
import time

from teleskein.plans import registry
from teleskein.session import build_session

HEADLINE = [
    "d01_traces_unnest",
    "d02_metrics_unnest",
    "d03_logs_unnest",
    "d10_attr_flatten",
    "s04_reject_malformed",
    "s07_sink_batches",
    "s08_signal_routing",
    "q01_traces_scan",
    "q04_service",
    "q05_since",
    "q07_conjunction",
    "q09_limit",
    "q14_json_result",
    "a01_metric_aggregate",
    "a01_metric_aggregate_filtered",
    "a01_metric_aggregate_by_name",
    "a03_counts",
    "s05_table_append",
    "s11_tail_append",
    "s16_ingest_report",
    "p01_prune_dry_run",
    "p02_prune_delete",
    "p03_prune_service",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=f"file://{tempfile.mkdtemp(prefix='teleskein-bench-')}",
    )
    spark.sparkContext.setLogLevel("ERROR")
    run = registry.queries()
    smallest = re.sub(r"sf[0-9.]+/?$", "sf0.001", sf_dir)
    warm = smallest if os.path.isdir(smallest) else sf_dir

    def finish(name: str, folder: str) -> float:
        begin = time.perf_counter()
        run[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    for name in HEADLINE:
        finish(name, warm)
    seconds = {name: finish(name, sf_dir) for name in HEADLINE}
    found = re.search(r"sf([0-9.]+)/?$", sf_dir)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found[1]) if found else None,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
