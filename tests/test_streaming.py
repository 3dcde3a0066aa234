"""Streaming twins: restart from a checkpoint equals the batch answer."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from jarledger.operators import replay
from jarledger.sources.bind import op_log_from_events, transactions_from_events
from jarledger.streaming import ledger_streams as S

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def _landing(spark):
    """Land the events table as two files, split by time: the second file
    arrives after the first run."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    cut = ev.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    land = tempfile.mkdtemp(prefix="landing-")
    ev.where(F.col("event_id") <= cut).coalesce(1).write.parquet(f"{land}/part1")
    ev.where(F.col("event_id") > cut).coalesce(1).write.parquet(f"{land}/part2")
    return ev, land


def _move_in(spark, src, dst_folder, name):
    os.makedirs(dst_folder, exist_ok=True)
    f = [x for x in os.listdir(src) if x.endswith(".parquet")][0]
    os.link(os.path.join(src, f), os.path.join(dst_folder, name))


def test_balance_fold_and_replay_resume_from_checkpoint(spark):
    ev, land = _landing(spark)
    inbox = os.path.join(land, "inbox")
    work = tempfile.mkdtemp(prefix="streams-")
    _move_in(spark, f"{land}/part1", inbox, "a.parquet")
    kw = dict(glob="*.parquet")
    S.run_stream_balance_fold(spark, inbox, out=f"{work}/fold/out", checkpoint=f"{work}/fold/ck", **kw)
    S.run_stream_ordered_replay(spark, inbox, out=f"{work}/rep/out", checkpoint=f"{work}/rep/ck", **kw)
    _move_in(spark, f"{land}/part2", inbox, "b.parquet")
    fold = S.run_stream_balance_fold(spark, inbox, out=f"{work}/fold/out", checkpoint=f"{work}/fold/ck", **kw)
    rep = S.run_stream_ordered_replay(spark, inbox, out=f"{work}/rep/out", checkpoint=f"{work}/rep/ck", **kw)

    tx = transactions_from_events(ev)
    want = {r["box_id"]: (r["s"], r["n"]) for r in
            tx.groupBy("box_id").agg(F.sum("amount").cast("decimal(18,2)").alias("s"), F.count("*").alias("n")).collect()}
    assert {r["box_id"]: (r["balance"], r["n_tx"]) for r in fold.collect()} == want

    # The second file only holds later events, so the resumed replay equals
    # one replay over everything.
    batch = {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"])
             for r in replay.ordered_replay(op_log_from_events(ev)).collect()}
    assert {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"]) for r in rep.collect()} == batch


def _daily(tx):
    return {(r["box_id"], r["day"]): r["net"] for r in
            tx.groupBy("box_id", F.to_date("date").alias("day"))
            .agg(F.sum("amount").cast("decimal(18,2)").alias("net")).collect()}


def test_late_files_and_repeats_lose_nothing(spark):
    """Four files, newest first, two at a time: every late row counts, once."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    land, work = tempfile.mkdtemp(prefix="landing-"), tempfile.mkdtemp(prefix="streams-")
    inbox = os.path.join(land, "inbox")
    cuts = [None, *ev.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.0), None]
    for k, (lo, hi) in reversed(list(enumerate(zip(cuts, cuts[1:])))):
        some = ev if lo is None else ev.where(F.col("event_id") > lo)
        some = some if hi is None else some.where(F.col("event_id") <= hi)
        some.coalesce(1).write.parquet(f"{land}/part{k}")
        _move_in(spark, f"{land}/part{k}", inbox, f"{3 - k}.parquet")
        kw = dict(glob="*.parquet", files_per_trigger=1)
        if k in (0, 2):
            rep = S.run_stream_ordered_replay(spark, inbox, out=f"{work}/rep/out", checkpoint=f"{work}/rep/ck", **kw)
            net = S.run_stream_daily_net(spark, inbox, out=f"{work}/net/out", checkpoint=f"{work}/net/ck", **kw)
    batch = {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"])
             for r in replay.ordered_replay(op_log_from_events(ev)).collect()}
    assert {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"]) for r in rep.collect()} == batch
    assert {(r["box_id"], r["day"]): r["net"] for r in net.collect()} == _daily(transactions_from_events(ev))


def test_daily_net_counts_open_days(spark):
    out = S.run_stream_daily_net(spark, SF)
    assert {(r["box_id"], r["day"]): r["net"] for r in out.collect()} == _daily(
        transactions_from_events(spark.read.parquet(f"{SF}/events.parquet")))


def test_ops_in_order_read_no_landed_history(spark, monkeypatch):
    """Files in order: answers come from state.  An early op that comes last: only its box is replayed, from a snapshot."""
    ev = spark.read.parquet(f"{SF}/events.parquet")
    land, work = tempfile.mkdtemp(prefix="landing-"), tempfile.mkdtemp(prefix="streams-")
    inbox, seen = os.path.join(land, "inbox"), []
    again = S.ReplayLanding.again
    monkeypatch.setattr(S.ReplayLanding, "again", lambda self, late, *a: seen.append({r["box_id"] for r in late.collect()}) or again(self, late, *a))
    order = ev.orderBy("ts", "event_id").select("event_id", "user_id").collect()
    held = order[len(order) // 10]
    cuts = ev.stat.approxQuantile("event_id", [0.3, 0.6], 0.0)
    rest = ev.where(F.col("event_id") != held["event_id"])
    parts = [rest.where(F.col("event_id") <= cuts[0]), rest.where((F.col("event_id") > cuts[0]) & (F.col("event_id") <= cuts[1])),
             rest.where(F.col("event_id") > cuts[1]), ev.where(F.col("event_id") == held["event_id"])]
    ids_follow_time = [r["event_id"] for r in order] == sorted(r["event_id"] for r in order)
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{land}/part{k}")
        _move_in(spark, f"{land}/part{k}", inbox, f"{k}.parquet")
        rep = S.run_stream_ordered_replay(spark, inbox, out=f"{work}/out", checkpoint=f"{work}/ck", glob="*.parquet", files_per_trigger=1)
        if k == 2 and ids_follow_time:
            assert not seen
    assert all(boxes <= {held["user_id"]} for boxes in seen) or not ids_follow_time
    batch = {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"])
             for r in replay.ordered_replay(op_log_from_events(ev)).collect()}
    assert {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_rejected"]) for r in rep.collect()} == batch


def test_replay_state_equals_a_plain_fold(monkeypatch):
    """Random arrivals: what the state answers, or the ops behind its snapshot, give the fold in order."""
    import random
    monkeypatch.setattr(S, "TAIL", 4)
    monkeypatch.setattr(S, "SNAPSHOTS", 6)
    for seed in range(60):
        rng = random.Random(seed)
        log = [[t, t, rng.choice(["add", "withdraw", "delete_tx", "reset", "x"]), rng.choice([None, rng.randint(0, 900), rng.randint(0, 90)])] for t in range(rng.randint(1, 150))]
        log = [[t, o, op, 5 if op == "delete_tx" and a is None else a] for t, o, op, a in log]
        sent = sorted(log, key=lambda r: r[0] + rng.random() * rng.choice([1, 5, 60]))
        text, seen = None, []
        for at in range(0, len(sent), 7):
            held = S.ReplayState(text)
            held.add(sent[at: at + 7])
            text = held.pack()
            seen = sorted(seen + sent[at: at + 7], key=lambda r: r[:2])
            base = held.answer()
            got = S.ReplayState.fold(base, [r for r in seen if r[:2] > base[:2]]) if held.late else base
            assert got == S.ReplayState.fold(S.ReplayState.FIRST, seen)
            assert len(held.tail) < 8 and len(held.snaps) <= 7
