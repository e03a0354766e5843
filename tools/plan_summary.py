"""Count physical operators in the plan of every registered query and print
a markdown table (used to write PLANS.md).

    python tools/plan_summary.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from litlens.plans.catalog import QUERIES  # noqa: E402
from litlens.session import local_session  # noqa: E402

OPS = [("Exchange hashpartitioning", "hash exch"), ("Exchange RoundRobin", "rr exch"),
       ("Exchange SinglePartition", "single exch"), ("Exchange rangepartitioning", "range exch"),
       ("BroadcastExchange", "bcast"), ("BroadcastHashJoin", "BHJ"), ("SortMergeJoin", "SMJ"),
       ("HashAggregate", "hash agg"), ("ObjectHashAggregate", "obj agg"),
       ("SortAggregate", "sort agg"), ("Window", "window"), ("Generate", "generate"),
       ("MapInPandas", "pandas"), ("CartesianProduct", "cartesian"),
       ("BroadcastNestedLoopJoin", "BNLJ")]


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = local_session()
    print("# Physical plans of the registered queries\n")
    print(f"Operator counts in the initial (pre-AQE) physical plan at `{sf_dir}`, from "
          "`tools/plan_summary.py`. Small dimensions (vocabulary, stems, tasks) account for "
          "the single-partition exchanges and most broadcasts; none of the queries plans a "
          "cartesian product or a nested-loop join. The queries of `litlens/llm` are not in "
          "the table: their plans and figures come from the check tool (README).\n")
    print("| query | " + " | ".join(short for _, short in OPS) + " |")
    print("|---|" + "---|" * len(OPS))
    for name in sorted(QUERIES):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        counts = []
        for op, _ in OPS:
            if op == "HashAggregate":
                n = len(re.findall(r"(?<!Object)HashAggregate", plan))
            elif op == "Window":
                n = len(re.findall(r"\bWindow \[", plan))
            else:
                n = plan.count(op)
            counts.append(str(n) if n else "")
        print(f"| `{name}` | " + " | ".join(counts) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
