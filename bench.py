"""Benchmark the headline queries; prints ONE JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_REPEAT (default 3, best run kept; the first runs pay JIT and codegen warm-up). Each query runs to completion
through the ``noop`` sink (full execution, nothing collected). ``growth`` is each
query's time over its time on BENCH_SMALL_DIR (default sf0.01, a tenth of the rows).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "join_multi", "join_chain", "join_fanout", "join_anti", "join_theta", "group_month", "count_distinct",
    "running_customer", "rank_segments", "lag_month", "topk_orders", "dedup_lineitem", "join_overlap",
    "bag_intersect", "avg_ship_days", "dq_report", "dup_documents", "grade", "leaderboard", "gen_fk_tenant",
    "gen_order_math", "tfidf_topk", "vector_topk", "fk_hops",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    from quarry.session import get_session
    from quarry.plans import REGISTRY
    spark = get_session(f"local[{cpus}]", shuffle_partitions=cpus * 2, app_name="quarry-bench")
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").write.format("noop").mode("overwrite").save()  # warm-up

    def best_of(name: str, path: str, n: int) -> float:
        took = []
        for _ in range(n):
            t0 = time.perf_counter()
            REGISTRY[name].build(spark, path).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - t0)
        return round(min(took), 3)

    times = {name: best_of(name, sf_dir, repeat) for name in HEADLINE}
    # Growth from the smaller fixture (compiled code by now), where there is one.
    small_dir = os.environ.get("BENCH_SMALL_DIR", "/root/testdata/sf0.01")
    small = {name: best_of(name, small_dir, 1) for name in HEADLINE} if os.path.isdir(small_dir) else {}
    growth = {name: round(times[name] / max(t, 1e-3), 2) for name, t in small.items()}
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "growth": growth, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
