"""Write PLANS.md: the physical plan shape of each bench query.

    python plan_report.py [sf_dir]

For every headline query (bench.py) on the stored ledger, plain parquet and
bucketed by box id, records the exchanges, join strategies, window operators,
Python stages and what reached the parquet scan (pushed filters, read schema).
"""

from __future__ import annotations

import os
import re
import sys

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from bench import headline  # noqa: E402
from jarledger.operators import replay  # noqa: E402
from jarledger.session import build_session  # noqa: E402

OPS = ["Exchange hashpartitioning", "Exchange rangepartitioning", "Exchange SinglePartition", "BroadcastExchange",
       "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct",
       "WindowGroupLimit", "Window", "HashAggregate", "SortAggregate", "ObjectHashAggregate", "MapInPandas",
       "Generate", "Sort"]


def summarise(df) -> dict:
    plan = df._jdf.queryExecution().executedPlan().toString()
    counts = {op: len(re.findall(re.escape(op) + r"\b", plan)) for op in OPS}
    pushed = sorted(set(re.findall(r"PushedFilters: \[([^\]]*)\]", plan)) - {""})
    reads = sorted({r.rstrip(",") for r in re.findall(r"ReadSchema: (\S+)", plan)})
    return {"ops": {k: v for k, v in counts.items() if v}, "pushed": pushed, "reads": reads}


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session()
    lines = ["# PLANS — physical plan shape of the bench queries", "",
             f"Generated by `plan_report.py` on `{sf_dir}` (local[8], AQE on; AQE may still",
             "re-plan joins at runtime from measured sizes).  `plain` = stored parquet,",
             "`bucketed` = boxes, transactions and op log bucketed by box id.  The replay rows",
             "show the final plan after its checkpoints (with dry pieces: the fallback join;",
             "without: a read of the composed walk); the staging rows show what was checkpointed.", ""]
    for buckets in (None, 16):
        _, (L, E), qs = headline(spark, sf_dir, buckets)
        lines += [f"## {'bucketed by box id (16 buckets)' if buckets else 'plain parquet'}", "",
                  "| query | operators | pushed filters |", "| --- | --- | --- |"]
        reads = {}
        # The replay's final plan starts from checkpoints written while it is
        # built; its staging (ranged, sorted ops) and piece pass are shown too.
        staging = {"replay staging (L)": lambda: replay._ranged_ops(L.op_log, None, None),
                   "replay pieces+walk (E)": lambda: replay._ranged_ops(E.op_log, None, None)
                   .mapInPandas(replay._pieces, replay.PIECE_OUT).repartition("box_id")
                   .sortWithinPartitions("box_id", "chunk").mapInPandas(replay._walk, replay.WALK_OUT)}
        for name, build in {**qs, **staging}.items():
            s = summarise(build())
            ops = ", ".join(f"{k} x{v}" for k, v in s["ops"].items())
            lines.append(f"| {name} | {ops} | {'; '.join(s['pushed']) or '-'} |")
            reads[name] = s["reads"]
        lines += ["", "Columns read per query (ReadSchema):", ""]
        for name, r in reads.items():
            lines.append(f"- `{name}`: " + ", ".join(f"`{x}`" for x in r))
        lines.append("")
    with open(os.path.join(ROOT, "PLANS.md"), "w") as f:
        f.write("\n".join(lines) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
