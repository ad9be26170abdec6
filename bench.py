"""Time the headline queries: one JSON line, seconds per query (median of the timed runs after a warm-up run)."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "sanitise_documents",
    "sanitise_pages",
    "extract_links",
    "html_lang",
    "dedupe_global",
    "dataset_stats",
    "site_funnel",
    "policy_crawl",
    "taxonomy_tag",
    "site_profile",
    "eps_neighbours",
    "dbscan",
    "tf_neighbours",
    "cluster_chunks",
    "label_clusters",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    from clausework.operators.lineage import drop_stages
    from clausework.session import build_session
    from workload.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    stages = tempfile.mkdtemp(prefix="bench-stages-")
    spark = build_session(
        app="bench",
        master=f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g",
        spark__checkpoint__dir=stages,
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        drop_stages(spark)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    spark.stop()
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
