"""Print the physical plan trees (the operator tree part of
``explain('formatted')``) of selected registered queries as Markdown.

Usage: python scripts/plan_trees.py [sf_dir] > docs/PLANS.md
"""

from __future__ import annotations

import contextlib
import io
import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from loadshape.plans.queries import QUERIES  # noqa: E402
from loadshape.session import build_session  # noqa: E402

SELECTED = {
    "agg_multi": "all mergeable methods + top-3 from one scan: partial day aggregate, 2 exchanges, one window",
    "agg_top3_mean": "top-3 only: WindowGroupLimit on both sides of the second exchange",
    "agg_median": "exact median: size-checked percentile per household-week",
    "peak_heatmap_count": "month x hour grid from the checkpointed monthly aggregate",
    "lookback_window": "look-back range join as an equi-join on month keys (broadcast) + residual range",
}


def tree(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    return text.split("\n\n\n")[0].replace("== Physical Plan ==\n", "")


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session(shuffle_partitions=8)
    print("# Physical plans of the main paths\n")
    print(f"Generated by `scripts/plan_trees.py` on `{sf}` (AQE plans before execution).\n")
    for name, what in SELECTED.items():
        print(f"## {name}\n\n{what}\n\n```\n{tree(QUERIES[name](spark, sf))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main()
