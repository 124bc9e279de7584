"""Times headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from tessera.plans import catalogue
from tessera.session import local_session

NAMES = (
    "tpch_q1", "tpch_q3", "tpch_q5", "tpch_q10", "hashjoin", "mergejoin", "equijoin", "filter_pushdown", "sortby", "ksmallest", "groupby", "krdup", "spatial_join", "distance_join", "matchbelow",
    "matchbelow_by_key", "sliding_window", "extend_last", "connected_components", "shortest_paths", "page_rank", "trip_length", "atinstant", "stream_counts", "keywords", "oplang_join_group", "dialect_subquery",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, "bench")
    wanted = sys.argv[1:] or NAMES
    spark.range(10).selectExpr("sum(id)").collect()
    times = {}
    for name in wanted:
        best = None
        for _ in range(2):
            start = time.perf_counter()
            catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(json.dumps({"metric": "total seconds, best of two runs each", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": folder.rstrip("/").rpartition("/")[2]}))


if __name__ == "__main__":
    main()
