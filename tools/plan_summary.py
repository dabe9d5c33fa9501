"""Summarise the physical plan of every registered query (for plan review).

Usage: python tools/plan_summary.py [sf_dir] > PLANS.md
Counts shuffles by partitioning, join strategies, aggregates, windows and Python nodes, and
lists the scan read schemas, from the (pre-execution) adaptive plan of each query.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from vulnsift.session import local_session  # noqa: E402
from vulnsift.plans import REGISTRY  # noqa: E402

NODES = ["BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
         "HashAggregate", "ObjectHashAggregate", "SortAggregate", "Window", "WindowGroupLimit", "Generate",
         "MapInArrow", "MapInPandas", "ArrowEvalPython", "FlatMapCoGroupsInPandas", "Expand"]


def summarise(plan: str) -> dict:
    ex = Counter(m for m in re.findall(r"(?<!Broadcast)Exchange (\w+)\(", plan))
    bx = plan.count("BroadcastExchange")
    nodes = Counter()
    for n in NODES:
        nodes[n] = len(re.findall(r"\b" + n + r"\b", plan))
    scans = sorted(set(re.findall(r"FileScan parquet \[([^\]]*)\]", plan)))
    return {"exchanges": dict(ex), "broadcasts": bx, "nodes": {k: v for k, v in nodes.items() if v}, "scans": scans}


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session(shuffle_partitions=16)
    print(f"# Physical plan summary ({sf.rsplit('/', 1)[-1]}, adaptive plans before execution)\n")
    print("Generated by `tools/plan_summary.py`. Shuffle = `Exchange` by partitioning kind; joins, aggregates,")
    print("windows and Python nodes as counted in the plan text. No query has a CartesianProduct or a")
    print("BroadcastNestedLoopJoin (also asserted by `tests/test_plans.py`).\n")
    print("| query | shuffles | broadcasts | operators |")
    print("|---|---|---|---|")
    for name in sorted(REGISTRY):
        df = REGISTRY[name].fn(spark, sf)
        s = summarise(df._jdf.queryExecution().executedPlan().toString())
        ex = ", ".join(f"{k}×{v}" for k, v in sorted(s["exchanges"].items())) or "–"
        ops = ", ".join(f"{k}×{v}" for k, v in sorted(s["nodes"].items())) or "–"
        print(f"| `{name}` | {ex} | {s['broadcasts']} | {ops} |", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
