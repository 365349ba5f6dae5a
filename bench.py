"""Wall time of the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from webweave.catalog import QUERIES
from webweave.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "split_url", "match_domain", "crawl_counters", "ingest_backlinks", "ingest_queue", "upsert_all",
    "extract_pages", "page_known_links", "pick_response", "apply_scrape", "edges_hosts", "degrees",
    "components", "component_stats", "domain_info", "remove_node", "cluster_backlinks", "cluster_info",
    "detect_language", "tfidf", "core_distance", "cluster_mean_distance", "hdbscan", "recluster",
]


def main() -> None:
    spark = local_session(CPUS)
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["sql_adhoc"](spark, SF_DIR).collect()  # start the session's machinery
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total wall time of headline queries",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
