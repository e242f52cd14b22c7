"""Write PLANS.md: the physical-plan shape of every query (final adaptive plan, after running it).

python tests/plan_report.py /root/testdata/sf0.01 > PLANS.md
"""

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E  # noqa: E402
from moodweave.plans.queries import REGISTRY  # noqa: E402
from moodweave.session import get_session  # noqa: E402

NODES = ["Exchange hashpartitioning", "Exchange RoundRobinPartitioning", "BroadcastExchange",
         "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "Window [", "WindowGroupLimit",
         "Generate", "HashAggregate", "ObjectHashAggregate", "SortAggregate"]
SHORT = {"Exchange hashpartitioning": "hash-xchg", "Exchange RoundRobinPartitioning": "rr-xchg",
         "BroadcastExchange": "bcast", "SortMergeJoin": "SMJ", "BroadcastHashJoin": "BHJ",
         "ShuffledHashJoin": "SHJ", "Window [": "window", "WindowGroupLimit": "WGL", "Generate": "generate",
         "HashAggregate": "hash-agg", "ObjectHashAggregate": "obj-agg", "SortAggregate": "sort-agg"}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_session("local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    print("# PLANS — physical plan shape per query\n")
    print(f"Generated by `tests/plan_report.py` on `{sf_dir}`: final adaptive plans, read after the query ran, so "
          "stages that are reused count once. At this scale the planner broadcasts tables that are large on a "
          "cluster. Columns count plan nodes; `scans` lists table(read columns); tables that a query wrote itself "
          "(checkpoints) are left out.\n")
    print("| query | " + " | ".join(SHORT[n] for n in NODES) + " | scans |")
    print("|---|" + "---|" * len(NODES) + "---|")
    for name, fn in E.queries().items():
        if name not in REGISTRY:
            continue
        df = fn(spark, sf_dir)
        df._jdf.queryExecution().executedPlan().execute().count()
        p = df._jdf.queryExecution().executedPlan().toString().split("+- == Initial Plan ==")[0]
        c = Counter()
        for ln in p.splitlines():
            for n in NODES:
                if n in ln and not (n == "HashAggregate" and "ObjectHashAggregate" in ln):
                    c[n] += 1
        scans = sorted(set(re.findall(r"/(\w+)\.parquet\].*?ReadSchema: struct<([^>]*)>", p)))
        sc = "; ".join(f"{t}({cols.replace(':bigint', '').replace(':string', '').replace(':int', '')})"
                       for t, cols in scans)
        print(f"| `{name}` | " + " | ".join(str(c[n]) for n in NODES) + f" | {sc} |")


if __name__ == "__main__":
    main()
