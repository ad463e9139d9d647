"""Headline queries and planning times; prints one JSON line.

BENCH_SF_DIR: folder of the tables; BENCH_CPUS: local cores.  Each query runs
once to warm up and then three times; the median counts.  ``plan_*`` are join
optimisations (graph to tree, no data), with the plan's cost against the best
found for that graph in ``plan_cost_ratio``.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from lattica.joinorder import workloads
from lattica.joinorder.cost import Search
from lattica.joinorder.heuristics import ALGORITHMS
from lattica.plans import catalog
from lattica.session import session

QUERIES = (
    "SC1_seq_scan", "A1_hashed", "A4_cube", "A6_distinct", "J1_hash_join", "J6_full", "J7_semi", "J11_range_join", "J12_asof_join", "J17_many_way",
    "joinorder_flagship", "W2_row_number", "W13_aggregate_over", "O2_top_n", "O5_distinct_on", "SO3_intersect", "SO8_crosstab", "F_date_extract", "F_json_extract",
)
PLANS = (
    ("snowflake", 20, ("by_block", "iterated", "partitioned", "linearized", "greedy", "ranked", "adaptive")),
    ("snowflake", 60, ("iterated", "partitioned", "linearized", "greedy", "ranked", "adaptive")),
    ("star", 12, ("by_block", "by_pairs", "iterated", "greedy")),
    ("clique", 9, ("by_block", "by_subset", "by_pairs", "iterated", "greedy", "genetic")),
    ("chain", 40, ("by_block", "linearized", "iterated", "greedy")),
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g"})
    spark.sparkContext.environment["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__))
    found, times = catalog.queries(), {}
    for name in QUERIES:
        runs = []
        for _ in range(4):
            t = time.perf_counter()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        times[name] = round(statistics.median(runs[1:]), 4)
    ratios = {}
    for shape, n, algorithms in PLANS:
        costs = {}
        for a in algorithms:
            if (shape, n, a) == ("snowflake", 20, "by_block"):
                n_small = 14
                graph = workloads.SHAPES[shape](n_small, 1)
                t = time.perf_counter()
                ALGORITHMS[a](Search(graph))
                times[f"plan_{shape}{n_small}_{a}"] = round(time.perf_counter() - t, 4)
                continue
            graph = workloads.SHAPES[shape](n, 1)
            t = time.perf_counter()
            plan = ALGORITHMS[a](Search(graph))
            times[f"plan_{shape}{n}_{a}"] = round(time.perf_counter() - t, 4)
            costs[a] = plan.cost
        best = min(costs.values())
        ratios |= {f"{shape}{n}_{a}": round(c / best, 3) for a, c in costs.items()}
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "plan_cost_ratio": ratios, "sf": float(sf[1]) if sf else sf_dir}))


if __name__ == "__main__":
    main()
