"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` (comma-separated, or
``all``) the queries. Every query is planned and run to the end once, into Spark's no-op sink, after
one small query that starts the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

from railbeam.session import local_session
from registry.queries import QUERIES

HEADLINE = [
    "decode_messages",
    "decode_schedules",
    "flatten_stops",
    "stations",
    "schedule_search",
    "schedule_search_requests",
    "search_primary_secondary",
    "association_match",
    "join_stitch",
    "divide_stitch",
    "activation_asof",
    "movement_log",
    "history_header",
    "history_pairs",
    "history_batch",
    "range_subscribers",
    "notifications",
    "feed_fold_stanox",
    "feed_fold_schedule",
    "subscribe_dedupe",
    "route_counts_per_minute",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(cpus)
    QUERIES["tiploc_map"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
