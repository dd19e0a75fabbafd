"""Plan audit: per registered query, count scans, exchanges and join /
aggregate strategies, and flag nested-loop or Cartesian joins and Python
evaluation.

Usage: python scripts/plan_audit.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadshape.plans.queries import QUERIES  # noqa: E402
from loadshape.session import build_session  # noqa: E402

PATTERNS = {
    "scan": r"FileScan parquet",
    "exch": r"Exchange hashpartitioning",
    "range": r"Exchange rangepartitioning",
    "bhj": r"BroadcastHashJoin",
    "smj": r"SortMergeJoin",
    "bnlj": r"BroadcastNestedLoopJoin",
    "cart": r"CartesianProduct",
    "sortagg": r"SortAggregate",
    "win": r"Window\b",
    "wgl": r"WindowGroupLimit",
    "py": r"Python|ArrowEval",
    "ckpt": r"Scan ExistingRDD",
}


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        counts = {k: len(re.findall(v, plan)) for k, v in PATTERNS.items()}
        flag = " <<<" if counts["bnlj"] or counts["cart"] or counts["py"] else ""
        print(f"{name:34s}", " ".join(f"{k}={v}" for k, v in counts.items() if v), flag)
    spark.stop()


if __name__ == "__main__":
    main()
