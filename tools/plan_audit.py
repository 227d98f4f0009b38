"""Summarise the executed physical plan of every registered query.

python tools/plan_audit.py [sf_dir] [query,...]

Per query: scans (columns read, pushed filters), shuffles, broadcasts, window
partition keys, and any single-partition exchange. Used to review plans for
scale (see PLANS.md).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from txnlens.queries import registry  # noqa: E402
from txnlens.session import local_session  # noqa: E402


def audit(plan: str) -> dict:
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[", plan)
    return {
        "scans": len(re.findall(r"Scan parquet", plan)),
        "max_cols_read": max((s.count(":") for s in scans), default=0),
        "pushed": len(re.findall(r"PushedFilters: \[[^\]]+\]", plan)),
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning", plan)),
        "single_partition": len(re.findall(r"Exchange SinglePartition", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
        "window_keys": sorted({w or "<none>" for w in windows}),
        "nested_loop": len(re.findall(r"BroadcastNestedLoopJoin", plan)),
        "cartesian": len(re.findall(r"CartesianProduct", plan)),
    }


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2].split(",")) if len(sys.argv) > 2 else None
    spark = local_session(8, 16)
    for name, fn in registry().items():
        if only and name not in only:
            continue
        df = fn(spark, sf)
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
        a = audit(plan)
        a["window_keys"] = [re.sub(r"#\d+L?", "", k) for k in a["window_keys"]]
        print(name, a, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
