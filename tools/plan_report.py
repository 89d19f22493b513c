"""Write PLANS.md: the executed physical plan shape of every batch query.

    python tools/plan_report.py [sf_dir]
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DETAIL = ["cache_asof_lookup", "quota_admission", "request_plan_pipeline"]
FLAGS = ("BroadcastNestedLoopJoin", "CartesianProduct", "BatchEvalPython", "SortAggregate")


def main() -> None:
    from quillspark import registry
    from quillspark.session import build_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    qs = registry.queries()
    lines = ["# Physical plans", "",
             f"Executed (AQE final) plans at `{os.path.basename(sf)}`, local[8], 8 shuffle partitions. "
             "Streaming keys are omitted (their plans are per micro-batch). Counts are nodes of the plan that ran last; stage tables written before it are not in it; "
             "`bcast` includes AQE's runtime broadcasts of measured-small sides.", "",
             "| query | hash exch | range exch | bcast | SMJ | window | parquet scans | python | flags |",
             "|---|---|---|---|---|---|---|---|---|"]
    details = {}
    for n in sorted(qs):
        if n.startswith("stream_"):
            continue
        df = qs[n](spark, sf)
        run = df._jdf.queryExecution()
        run.toRdd().count()                 # runs this very plan, so that it is the final one
        p = run.executedPlan().toString()
        p = p.split("\n+- == Initial Plan ==")[0]
        py = "MapInPandas" in p or "ArrowEvalPython" in p
        flags = ", ".join(f for f in FLAGS if f in p) or "-"
        lines.append(f"| `{n}` | {p.count('Exchange hashpartitioning')} | {p.count('rangepartitioning')} | "
                     f"{p.count('BroadcastExchange')} | {p.count('SortMergeJoin')} | {p.count('Window [')} | "
                     f"{p.count('FileScan parquet')} | {'yes' if py else '-'} | {flags} |")
        if n in DETAIL:
            details[n] = re.sub(r"file:[^\]\s,]*", "<path>", p)
    for n in DETAIL:
        lines += ["", f"## `{n}`", "", "```", details[n].rstrip(), "```"]
    out = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md")
    with open(out, "w") as f:
        f.write("\n".join(lines) + "\n")
    print("wrote", out)


if __name__ == "__main__":
    main()
