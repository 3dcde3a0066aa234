"""Summarise stage times from a Spark event log (no UI needed).

    JARLEDGER_EVENT_LOG=$(mktemp -d /tmp/run-XXXXXX) python bench.py
    python stage_times.py <that folder>

Prints, per job, the stages with their task count, wall time and the summed
task run time, shuffle read/write bytes and spill.
"""

from __future__ import annotations

import json
import os
import sys


def main(folder: str) -> None:
    files = sorted(os.path.join(folder, f) for f in os.listdir(folder))
    for path in files:
        stages = {}
        with open(path) as fh:
            for line in fh:
                ev = json.loads(line)
                kind = ev.get("Event")
                if kind == "SparkListenerTaskEnd":
                    sid = ev["Stage ID"]
                    m = ev.get("Task Metrics") or {}
                    st = stages.setdefault(sid, {"tasks": 0, "run_ms": 0, "shuffle_read": 0, "shuffle_write": 0,
                                                 "spill": 0})
                    st["tasks"] += 1
                    st["run_ms"] += m.get("Executor Run Time", 0)
                    sr = m.get("Shuffle Read Metrics") or {}
                    st["shuffle_read"] += sr.get("Remote Bytes Read", 0) + sr.get("Local Bytes Read", 0)
                    st["shuffle_write"] += (m.get("Shuffle Write Metrics") or {}).get("Shuffle Bytes Written", 0)
                    st["spill"] += m.get("Disk Bytes Spilled", 0)
                elif kind == "SparkListenerStageCompleted":
                    info = ev["Stage Info"]
                    st = stages.setdefault(info["Stage ID"], {"tasks": 0, "run_ms": 0, "shuffle_read": 0,
                                                              "shuffle_write": 0, "spill": 0})
                    st["name"] = info.get("Stage Name", "")[:60]
                    if info.get("Submission Time") and info.get("Completion Time"):
                        st["wall_ms"] = info["Completion Time"] - info["Submission Time"]
        print(os.path.basename(path))
        for sid in sorted(stages):
            st = stages[sid]
            print(f"  stage {sid:4d} tasks={st['tasks']:4d} wall_ms={st.get('wall_ms', 0):6d} "
                  f"task_ms={st['run_ms']:7d} shuffle_r={st['shuffle_read']:>10d} "
                  f"shuffle_w={st['shuffle_write']:>10d} spill={st['spill']:>8d}  {st.get('name', '')}")


if __name__ == "__main__":
    main(sys.argv[1])
