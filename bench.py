"""Bench: headline ledger queries on binding L (orders as boxes, lineitem as
transactions), plus the events-bound replay and series.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

The bound tables are first written once to the shared folder (timed as
``bind_and_store``); the queries then read them as stored ledger tables.  Each
query runs to completion through the ``noop`` sink (the whole plan executes,
nothing is collected).  The total is that of tables bucketed by box; one warm
run on plain parquet tables is timed beside it (``plain``).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

from pyspark.sql import functions as F  # noqa: E402

from jarledger.operators import aggregates as agg  # noqa: E402
from jarledger.operators import feed, history, joins, replay, series  # noqa: E402
from jarledger.session import build_session, shared_dir  # noqa: E402
from jarledger.sources.bind import bind_events, bind_lineitem, materialize  # noqa: E402


def headline(spark, sf_dir, buckets):
    """Bind once, store the bound tables bucketed on the box id (plain without
    ``buckets``; timed separately), then query the stored tables."""
    t0 = time.perf_counter()
    tag = f"b{time.time_ns()}"
    L = materialize(bind_lineitem(spark, sf_dir), shared_dir(spark, "bench", "ledger_l"), buckets, f"l_{tag}")
    E = materialize(bind_events(spark, sf_dir), shared_dir(spark, "bench", "ledger_e"), buckets, f"e_{tag}")
    load_s = round(time.perf_counter() - t0, 3)
    tx, boxes = L.transactions, L.user_boxes
    return load_s, (L, E), {
        "balance_week": lambda: series.balance_week(tx, boxes, as_of=L.as_of),
        "balance_month": lambda: series.balance_month(tx, boxes, as_of=L.as_of),
        "balance_all": lambda: series.balance_all(tx, boxes, as_of=L.as_of),
        "balance_fold": lambda: agg.balance_fold(boxes, tx.where(F.to_date("date") > F.lit(L.as_of))),
        "recent_activity": lambda: history.recent_activity(tx, boxes),
        "ordered_replay": lambda: replay.ordered_replay(L.op_log),
        "drain_until_failure": lambda: replay.drain_until_failure(L.op_log),
        "ledger_reconcile": lambda: agg.ledger_reconcile(boxes, tx),
        "goal_progress": lambda: agg.goal_progress(boxes, L.box_templates),
        "net_saved_month": lambda: agg.net_saved_month(tx, boxes, as_of=L.as_of),
        "box_home_equivalent": lambda: joins.box_home_equivalent(boxes, L.profiles, L.rates),
        "activity_feed": lambda: feed.activity_feed(history.recent_activity(tx, boxes), boxes, L.profiles,
                                                    as_of=L.as_of),
        "events_ordered_replay": lambda: replay.ordered_replay(E.op_log),
        "events_balance_month": lambda: series.balance_month(E.transactions, E.user_boxes, as_of=E.as_of),
    }


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus)))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=parts, app_name="jarledger-bench")
    buckets = int(os.environ.get("BENCH_BUCKETS", str(parts * 2)))
    load_s, _, qs = headline(spark, sf_dir, buckets)
    # The first (cold) run of each query pays JVM JIT and codegen warm-up;
    # the reported time is the median of the next warm runs.  Both printed.
    reps = int(os.environ.get("BENCH_WARM_RUNS", "3"))
    times: dict[str, list[float]] = {name: [] for name in qs}
    for _ in range(1 + reps):  # one cold pass over all queries, then warm passes
        for name, build in qs.items():
            t0 = time.perf_counter()
            run(build())
            times[name].append(time.perf_counter() - t0)
    cold = {name: round(t[0], 3) for name, t in times.items()}
    warm = {name: round(statistics.median(t[1:]), 3) for name, t in times.items()}
    plain_load, _, plain_qs = headline(spark, sf_dir, None)
    plain = {}
    for name, build in plain_qs.items():  # everything is compiled by now
        t0 = time.perf_counter()
        run(build())
        plain[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "ledger_headline_total", "value": round(sum(warm.values()), 3), "unit": "sec",
        "queries": warm, "sf": float(m.group(1)) if m else None, "cpus": cpus,
        "warm_runs": reps, "warm_stat": "median",
        "cold_total": round(sum(cold.values()), 3), "cold": cold, "bind_and_store": load_s,
        "plain": plain, "plain_total": round(sum(plain.values()), 3), "plain_bind_and_store": plain_load,
        "binding": "L (lineitem ledger) + E (events ledger)",
        "storage": f"parquet tables bucketed by box id ({buckets} buckets)",
    }))
    spark.stop()


if __name__ == "__main__":
    main()
