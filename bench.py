"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from veristrata.plans import catalog
from veristrata.session import local_session

HEADLINES = ("flagship_gate", "matched_versions", "risk_tiers", "cvss_v3_score", "merge_resolve", "dep_type_merge", "kev_epss_enrich", "ignore_antijoin", "alias_components", "project_scan", "call_paths")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = catalog.queries(), {}
    catalog.flagship(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm
    for name in HEADLINES:
        runs = []
        for _ in range(3):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - start)
        seconds[name] = round(sorted(runs)[1], 3)
    print(json.dumps({"metric": "headline queries, median of 3", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
