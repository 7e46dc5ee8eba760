"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line, medians of three runs after a warm-up."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marlstone.plans.registry import QUERIES, load  # noqa: E402
from marlstone.session import session  # noqa: E402

HEADLINE = (
    "tpch_q1", "tpch_q3", "tpch_q4", "tpch_q5", "tpch_q6", "tpch_q7", "tpch_q8", "tpch_q10", "tpch_q12", "tpch_q13", "tpch_q14", "tpch_q15", "tpch_q17", "tpch_q18", "tpch_q19", "tpch_q21", "tpch_q22",
    "hits_count", "hits_min_max", "hits_sum_avg", "hits_top_users", "hits_distinct_per_type", "hits_host_regexp", "hits_like_scan", "hits_group_by_url", "hits_wide_sums", "hits_top_n_wide",
    "join_as_of", "join_range", "window_running_sum", "window_sessions", "window_rank", "group_cube", "group_multi_distinct", "set_intersect", "udf_arrow_scalar",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    load()
    spark = session("bench", f"local[{cpus}]", cpus, spark__ui__enabled="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name in HEADLINE:
        times = []
        for _ in range(4):
            began = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - began)
        found[name] = round(statistics.median(times[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in sf_dir else None}))


if __name__ == "__main__":
    main()
