"""Queues drained at each fetch, and one log of all that happens to boxes, against plain loops."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest

from jarledger.operators.queue import drain_rounds
from jarledger.operators.unified import unified_replay
from tests.frames import boxes, templates, ts


def loop_drain(items, fetches):
    """The app's loop: at each fetch from the head on, until an item fails."""
    out = {}
    for device in {d for *_, d, _ in items}:
        queue, waiting = [], sorted((t, i, f) for i, t, d, f in items if d == device)
        for n, (t, _) in enumerate(sorted((t, i) for i, t, d in fetches if d == device), 1):
            while waiting and waiting[0][0] <= t:
                queue.append(list(waiting.pop(0)))
            while queue:
                if queue[0][2]:
                    queue[0][2] -= 1
                    break
                out[queue.pop(0)[1]] = (n, t)
    return {i: out.get(i, (None, None)) for i, *_ in items}


@pytest.mark.parametrize("partitions", [None, 1, 13])
def test_drain_rounds_equal_the_loop(spark, partitions):
    for seed in range(3):
        rng = random.Random(seed)
        items = [(i, ts(0) + dt.timedelta(minutes=rng.randint(0, 300)), rng.choice(["a", "a", "a", "b", "c"]), rng.choice([0, 0, 0, 0, 1, 2, 5])) for i in range(200)]
        fetches = [(1000 + i, ts(0) + dt.timedelta(minutes=rng.randint(0, 320)), rng.choice(["a", "a", "b"])) for i in range(120)]
        got = drain_rounds(spark.createDataFrame(items, "op_id long, ts timestamp_ntz, device string, fails int"),
                           spark.createDataFrame(fetches, "fetch_id long, ts timestamp_ntz, device string"), partitions).collect()
        assert {r["op_id"]: (r["posted_round"], r["posted_at"]) for r in got} == loop_drain(items, fetches)


def loop_unified(log, start, grids):
    """One box after the other, row by row; ``start``: balance, template, crossed."""
    state = {b: {"balance": D(v[0]), "crossed": list(v[2]), "n": 0, "deleted": False} for b, v in start.items()}
    posted = {}
    for op_id, _, box, op, amount, arg in sorted(log, key=lambda r: (r[1], r[0])):
        if op == "delete_tx":
            box, size = posted.get(int(arg) if arg is not None else None, (None, None))
            if box is None:
                continue
        s = state.get(box)
        if s is None or s["deleted"]:
            continue
        a = None if amount is None else abs(amount)
        if op == "add" and a:
            s["balance"], s["n"], posted[op_id] = s["balance"] + a, s["n"] + 1, (box, a)
        elif op == "withdraw" and a and s["balance"] >= a:
            s["balance"], s["n"], posted[op_id] = s["balance"] - a, s["n"] + 1, (box, -a)
        elif op == "reset":
            s["balance"], s["n"] = D(0), s["n"] + 1
        elif op == "crossout" and arg is not None and int(arg) not in s["crossed"]:
            s["crossed"].append(int(arg))
            grid = grids.get(start[box][1], [])
            if 0 <= int(arg) < len(grid) and grid[int(arg)] > 0:
                s["balance"], s["n"], posted[op_id] = s["balance"] + grid[int(arg)], s["n"] + 1, (box, D(grid[int(arg)]))
        elif op == "delete_tx":
            s["balance"], s["n"] = max(D(0), s["balance"] - size), s["n"] + 1
            del posted[int(arg)]
        elif op == "delete_box":
            s["deleted"] = True
            posted = {k: v for k, v in posted.items() if v[0] != box}
    return ({b: (None if s["deleted"] else s["balance"], s["n"], None if s["deleted"] else s["crossed"], s["deleted"]) for b, s in state.items()}, posted)


@pytest.mark.parametrize("partitions", [None, 9])
def test_unified_replay_equals_the_loop(spark, partitions):
    grids = {1: [5, 0, 10, 20], 2: [100]}
    for seed in range(3):
        rng = random.Random(seed)
        start = {b: (rng.choice([0, 0, 50]), rng.choice([None, 1, 2]), rng.sample(range(5), rng.randint(0, 2))) for b in range(1, 6)}
        log = []
        for i in range(240):
            op = rng.choices(["add", "withdraw", "reset", "crossout", "delete_tx", "delete_box", "odd"], [30, 40, 2, 12, 25, .4, 2])[0]
            amount = rng.choice([None, D(0), *[D(rng.randint(1, 60))] * 12]) if op in ("add", "withdraw") else None
            arg = str(rng.randint(-1, 6)) if op == "crossout" else str(rng.randint(max(0, i - 30), i + 3)) if op == "delete_tx" else None
            log.append((i, ts(0) + dt.timedelta(minutes=i // 3), rng.choice([1, 1, 1, 2, 3, 4, 5, 9]), op, amount, arg))
        df = spark.createDataFrame(log, "op_id long, ts timestamp_ntz, box_id long, op string, amount decimal(12,2), arg string")
        b = boxes(spark, [{"id": i, "current_amount": v[0], "template_id": v[1], "crossed_out_indices": v[2]} for i, v in start.items()])
        t = templates(spark, [(k, f"t{k}", sum(g), "UAH", g) for k, g in grids.items()])
        state, left = unified_replay(df, b, t, partitions)
        want, posted = loop_unified(log, start, grids)
        got = {r["box_id"]: (r["balance"], r["n_applied"], r["crossed_out_indices"], r["deleted"]) for r in state.collect()}
        assert got == want
        assert {r["op_id"]: (r["box_id"], r["amount"]) for r in left.collect()} == posted


@pytest.mark.parametrize("batches", [1, 4])
def test_the_stream_drains_batches_like_the_loop(spark, batches):
    import tempfile

    from pyspark.sql import types as T

    from jarledger.streaming.device_streams import POSTED, QueueLanding, stream_queue_drain
    from jarledger.streaming.update_log import UpdateLog

    def drained(cut, again):
        work = tempfile.mkdtemp(prefix="streams-")
        log = UpdateLog(spark, f"{work}/out", ["op_id"], T.StructType.fromDDL(POSTED))
        landing = QueueLanding(spark, f"{work}/held", log)
        for n, (some, opened) in enumerate(cut):
            rows = stream_queue_drain(spark.createDataFrame(some, "op_id long, ts timestamp_ntz, device string, fails int"),
                                      spark.createDataFrame(opened, "fetch_id long, ts timestamp_ntz, device string"))
            if again and n == 1:    # the stream stops between the log's commit and that of what is held
                whole, landing.manifest.commit = landing.manifest.commit, lambda *_: False
                with pytest.raises(RuntimeError):
                    landing(rows, n)
                landing.manifest.commit = whole
            landing(rows, n)
            landing(rows, n)        # a batch that runs again
        return {r["op_id"]: (r["device"], r["posted_round"], r["posted_at"]) for r in log.latest().collect()}

    rng = random.Random(batches)
    start, minute = ts(0), dt.timedelta(minutes=1)
    items = [(i, start + rng.randint(0, 300) * minute, rng.choice(["a", "a", "a", "b", "c", ""]), rng.choice([0, 0, 0, 0, 1, 2, 5])) for i in range(200)]
    items += [(300 + i, start + i * minute, "d", i % 3) for i in range(40)]     # waits for a fetch until the last batch
    fetches = [(1000 + i, start + rng.randint(0, 320) * minute, rng.choice(["a", "a", "b", "", "d"])) for i in range(150)]
    fetches = [f for f in fetches if f[2] != "d" or f[1] > start + 280 * minute] + [(2000 + i, start + (290 + i) * minute, "d") for i in range(30)]
    ends = [start + 400 * (n + 1) // batches * minute for n in range(batches)]
    cut = [([r for r in items if lo <= r[1] < hi], [r for r in fetches if lo <= r[1] < hi]) for lo, hi in zip([start, *ends], ends)]
    epoch = dt.datetime(1970, 1, 1)
    micros = lambda t: (t - epoch) // dt.timedelta(microseconds=1)
    devices = {i: d for i, _, d, _ in items}
    want = {i: (devices[i], n, micros(t)) for i, (n, t) in loop_drain(items, fetches).items() if n is not None}
    assert drained(cut, batches > 1) == want and any(d == "d" for d, *_ in want.values())


def test_the_stream_hands_no_queue_to_python(spark, monkeypatch):
    import tempfile

    from jarledger.streaming import device_streams
    folder, n, run, plans = tempfile.mkdtemp(prefix="inbox-"), 2000, device_streams.run_updates, []
    ev = spark.range(n).selectExpr("id AS event_id", "timestampadd(SECOND, CAST(id AS INT), TIMESTAMP_NTZ'2024-01-01 00:00:00') AS ts", "0L AS user_id",
                                   "IF(id % 5 = 4, 'view', 'click') AS event_type", "1.0D AS value")
    ev.write.parquet(f"{folder}/in")
    monkeypatch.setattr(device_streams, "run_updates", lambda updates, *rest: plans.append(updates._jdf.queryExecution().analyzed().toString()) or run(updates, *rest))
    assert device_streams.run_stream_queue_drain(spark, f"{folder}/in", glob="*.parquet").count() > n // 2
    assert "Pandas" not in plans[0]
