
import datetime as dt
import os
from collections import defaultdict
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from jarledger.operators import replay, series, sets
from jarledger.sources.bind import bind_events

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


@pytest.fixture(scope="module")
def ledger(spark):
    return bind_events(spark, SF)


def test_daily_nets_add_up_to_transactions(ledger):
    daily = series.daily_net(ledger.transactions).agg(F.sum("net")).first()[0]
    total = ledger.transactions.agg(F.sum("amount")).first()[0]
    assert daily == total
    days = sets.active_days(ledger.transactions).count()
    assert days == series.daily_net(ledger.transactions).count()


def test_drained_and_kept_partition_the_queue(ledger):
    d = replay.drain_until_failure(ledger.op_log)
    assert d.count() == ledger.op_log.count()
    # Once a device has a kept item, every later item of that device is kept.
    rows = sorted((r["device"], r["ts"], r["op_id"], r["posted"]) for r in d.collect())
    seen_kept = set()
    for dev, _, _, posted in rows:
        if dev in seen_kept:
            assert not posted
        if not posted:
            seen_kept.add(dev)


def test_all_series_matches_plain_loop(ledger):
    """The 'all' period restated as the app computes it, per box."""
    as_of = ledger.as_of
    tx = defaultdict(list)
    for r in ledger.transactions.collect():
        tx[r["box_id"]].append((r["date"], r["amount"]))
    cur = {r["id"]: r["current_amount"] for r in ledger.user_boxes.collect()}
    expect = {}
    for box, c in cur.items():
        rows = tx.get(box, [])
        if not rows:
            if c != 0:
                expect[(box, 0)] = (as_of, "Start", D(0))
                expect[(box, 1)] = (as_of, "Now", c)
            continue
        days = sorted({d.date() for d, _ in rows})
        for i, day in enumerate(days):
            bal = sum((a for d, a in rows if d.date() <= day), D(0))
            if i == len(days) - 1 and day == as_of:
                bal = c
            expect[(box, i)] = (day, f"{day.day} {day.strftime('%b')}", bal)
    got = {(r["box_id"], r["point"]): (r["day"], r["label"], r["balance"])
           for r in series.balance_all(ledger.transactions, ledger.user_boxes, as_of=as_of).collect()}
    assert got == expect


def test_week_series_matches_plain_loop(ledger):
    as_of = ledger.as_of
    first = as_of - dt.timedelta(days=6)
    tx = defaultdict(list)
    for r in ledger.transactions.collect():
        tx[r["box_id"]].append((r["date"].date(), r["amount"]))
    got = {(r["box_id"], r["point"]): r["balance"]
           for r in series.balance_week(ledger.transactions, ledger.user_boxes, as_of=as_of).collect()}
    for b in ledger.user_boxes.collect():
        rows = [(d, a) for d, a in tx.get(b["id"], []) if d >= first]
        opening = max(D(0), b["current_amount"] - sum((a for _, a in rows), D(0)))
        for i in range(7):
            day = first + dt.timedelta(days=i)
            want = b["current_amount"] if day == as_of else opening + sum((a for d, a in rows if d <= day), D(0))
            assert got[(b["id"], i)] == want
