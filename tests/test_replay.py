"""Replay, drain, cross-out and delete folds (G11-G13) plus restated-loop checks."""

import datetime as dt
import random
from decimal import Decimal as D

from jarledger.operators import replay
from jarledger.operators.unified import _settled
from jarledger.session import ship_package
from tests.frames import boxes, ops, templates, ts, tx


def test_g11_drain_stops_at_first_failure(spark):
    q = ops(spark, [(1, ts(0, 1), "d1", 1, "add", 1, False), (2, ts(0, 2), "d1", 1, "add", 1, False),
                    (3, ts(0, 3), "d1", 1, "add", 1, True), (4, ts(0, 4), "d1", 1, "add", 1, False),
                    (5, ts(0, 5), "d2", 2, "add", 1, False)])
    got = {r["op_id"]: r["posted"] for r in replay.drain_until_failure(q).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: True}


def test_g12_guarded_replay_steps(spark):
    q = ops(spark, [(1, ts(0, 1), "d", 1, "add", 10, False), (2, ts(0, 2), "d", 1, "withdraw", 15, False),
                    (3, ts(0, 3), "d", 1, "withdraw", 4, False), (4, ts(0, 4), "d", 1, "delete_tx", 9, False),
                    (5, ts(0, 5), "d", 1, "add", 1, False)])
    steps = replay.replay_steps(q).orderBy("op_id").collect()
    assert [r["balance"] for r in steps] == [D(10), D(10), D(6), D(0), D(1)]
    assert [r["applied"] for r in steps] == [True, False, True, True, True]
    r = replay.ordered_replay(q).first()
    assert (r["final_balance"], r["n_ops"], r["n_applied"], r["n_rejected"]) == (D(1), 5, 4, 1)


def test_replay_with_opening_balance_and_zero_amounts(spark):
    q = ops(spark, [(1, ts(0, 1), "d", 1, "withdraw", 30, False), (2, ts(0, 2), "d", 1, "add", 0, False),
                    (3, ts(0, 3), "d", 1, "withdraw", 0, False), (4, ts(0, 4), "d", 1, "reset", None, False)])
    opening = spark.createDataFrame([(1, D(50))], "box_id BIGINT, balance DECIMAL(12,2)")
    steps = replay.replay_steps(q, opening=opening).orderBy("op_id").collect()
    assert [(r["balance"], r["applied"]) for r in steps] == [
        (D(20), True), (D(20), False), (D(20), False), (D(0), True)]


def _loop(opening, seq):
    bal, ok = opening, 0
    for op, a in seq:
        if op == "add" and a != 0:
            bal += abs(a); ok += 1
        elif op == "withdraw" and a != 0 and bal >= abs(a):
            bal -= abs(a); ok += 1
        elif op == "reset":
            bal = 0; ok += 1
        elif op == "delete_tx":
            bal = max(0, bal - a); ok += 1
    return bal, ok


def test_replay_matches_plain_loop_across_small_batches(spark):
    rnd = random.Random(7)
    rows, expect = [], {}
    oid = 0
    for box in range(1, 9):
        seq = []
        for k in range(rnd.randint(1, 60)):
            op = rnd.choice(["add", "withdraw", "withdraw", "delete_tx", "reset", "add"])
            a = D(rnd.randint(0, 3000)) / 100
            oid += 1
            rows.append((oid, ts(-rnd.randint(0, 20), rnd.randint(0, 23), rnd.randint(0, 59)), "d", box, op, a,
                         False))
            seq.append((rows[-1][1], oid, op, a))
        seq.sort()
        expect[box] = _loop(D(0), [(op, a) for _, _, op, a in seq])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r["box_id"]: (r["final_balance"], r["n_applied"])
               for r in replay.ordered_replay(ops(spark, rows), partitions=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == expect


def test_g13_crossout(spark):
    t = templates(spark, [(7, "tpl", 35, "UAH", [5, 10, 20])])
    b = boxes(spark, [{"id": 1, "template_id": 7, "crossed_out_indices": [0, 7]}])
    req = spark.createDataFrame(
        [(1, ts(0, 1), 1, 1), (2, ts(0, 2), 1, 1), (3, ts(0, 3), 1, 0), (4, ts(0, 4), 1, 9)],
        "req_id BIGINT, ts TIMESTAMP_NTZ, box_id BIGINT, idx INT")
    arrays, new_tx = replay.crossout_apply(b, t, req)
    assert arrays.first()["crossed_out_indices"] == [0, 7, 1, 9]
    rows = new_tx.collect()
    assert [(r["amount"], r["note"]) for r in rows] == [(D(10), "Crossed out index 1")]


def test_crossout_sends_no_table_through_the_driver(spark, tmp_path):
    def stored(frame):      # Spark takes files for as large as they are, and these for small
        path = str(tmp_path / str(len(frame.columns)))
        frame.write.parquet(path)
        return spark.read.parquet(path)

    t = templates(spark, [(7, "tpl", 35, "UAH", [5, 10, 0]), (8, "other", 1, "UAH", [1])])
    b = boxes(spark, [{"id": 1, "template_id": 7, "crossed_out_indices": [0]}, {"id": 2, "template_id": 9, "crossed_out_indices": []},
                      {"id": 3, "template_id": None, "crossed_out_indices": None}, {"id": 4, "template_id": 8, "crossed_out_indices": []}])
    req = spark.createDataFrame(
        [(1, ts(0, 3), 1, 1), (2, ts(0, 2), 1, 2), (3, ts(0, 2), 1, 1), (4, ts(0, 1), 1, 0), (5, ts(0), 2, 0), (6, ts(0), 3, -1),
         (7, ts(0), 5, 0), (8, ts(0), None, 0), (9, ts(0), 4, None), (10, None, 4, 0), (11, ts(0), 4, 0)],
        "req_id BIGINT, ts TIMESTAMP_NTZ, box_id BIGINT, idx INT")
    b, t = stored(b), stored(t)
    arrays, new_tx = replay.crossout_apply(b, t, req)
    guarded, state = _settled(req.selectExpr("req_id AS op_id", "ts", "box_id", "'crossout' AS op", "CAST(NULL AS DECIMAL(12,2)) AS amount", "CAST(idx AS STRING) AS arg"), b, t)
    for frame in (arrays, new_tx, guarded, state):
        assert "Broadcast" not in frame._jdf.queryExecution().sparkPlan().toString()
    assert {r["box_id"]: (r["crossed_out_indices"], r["n_added"]) for r in arrays.collect()} == {
        1: ([0, 2, 1], 2), 2: ([0], 1), 3: ([-1], 1), 4: ([0], 1)}
    assert {(r["box_id"], r["amount"], r["note"], r["date"]) for r in new_tx.collect()} == {
        (1, D(10), "Crossed out index 1", ts(0, 2)), (4, D(1), "Crossed out index 0", None)}


def test_delete_apply_matches_sequential_clamp(spark):
    rnd = random.Random(11)
    box_rows, tx_rows, del_rows, expect = [], [], [], {}
    tid = 0
    for box in range(1, 7):
        b0 = D(rnd.randint(0, 5000)) / 100
        box_rows.append({"id": box, "current_amount": b0})
        dels = []
        for k in range(rnd.randint(1, 40)):
            tid += 1
            amt = D(rnd.randint(-3000, 3000)) / 100 or D(1)
            tx_rows.append((tid, box, amt, None, ts(-30)))
            when = ts(-rnd.randint(0, 4), rnd.randint(0, 23), rnd.randint(0, 59))  # several day chunks
            del_rows.append((tid, when, tid))
            dels.append((when, tid, amt))
        bal = b0
        for _, _, amt in sorted(dels):
            bal = max(D(0), bal - amt)
        expect[box] = bal
    del_rows.append((10_000, ts(0), 10_001))          # unknown transaction: ignored
    del_rows.append((10_001, ts(1), 1))               # second delete of tx 1: ignored
    deletions = spark.createDataFrame(del_rows, "req_id BIGINT, ts TIMESTAMP_NTZ, tx_id BIGINT")
    bal, remaining = replay.tx_delete_apply(boxes(spark, box_rows), tx(spark, tx_rows), deletions)
    assert {r["box_id"]: r["balance"] for r in bal.collect()} == expect
    assert remaining.count() == 0


def test_attribute_merge_last_value_wins(spark):
    b = boxes(spark, [{"id": 1, "name": "old", "target_amount": 10, "created_at": dt.datetime(2024, 1, 1)}])
    a = spark.createDataFrame([
        (1, ts(0, 1), 1, "rename", "  New  "), (2, ts(0, 2), 1, "rename", "   "),
        (3, ts(0, 3), 1, "retarget", "25"), (4, ts(0, 4), 1, "retarget", "-3"),
        (5, ts(0, 5), 1, "archive", None), (6, ts(0, 6), 1, "restore", None),
        (7, ts(0, 7), 1, "archive", None), (8, ts(0, 8), 1, "retarget", ""),
        (9, ts(0, 9), 1, "archive", None),
    ], "op_id BIGINT, ts TIMESTAMP_NTZ, box_id BIGINT, op STRING, arg STRING")
    r = replay.box_attribute_merge(b, a).first()
    assert (r["name"], r["target_amount"], r["is_archived"], r["updated_at"]) == ("New", None, True, ts(0, 8))


def test_box_from_template_defaults(spark):
    t = templates(spark, [(7, "Jar", 1000, "UAH", [5])])
    req = spark.createDataFrame([(1, 5, 7, ""), (2, 5, 7, "  "), (3, 5, 8, "x"), (4, 5, 7, None)],
                                "request_id BIGINT, user_id BIGINT, template_id BIGINT, name STRING")
    got = {r["request_id"]: (r["name"], r["currency"]) for r in replay.box_from_template(req, t).collect()}
    assert got == {1: ("Jar", "EUR"), 2: ("  ", "EUR"), 4: ("Jar", "EUR")}


def test_delete_apply_hot_box_spans_many_ranges(spark):
    """One box holds most deletions, many at the same instant: the range
    chunks split it and the composed result equals the sequential clamp."""
    rnd = random.Random(5)
    tx_rows, del_rows, seq = [], [], []
    for tid in range(1, 1501):
        box = 1 if tid % 10 else 2
        amt = D(rnd.randint(-5000, 5000)) / 100 or D(1)
        tx_rows.append((tid, box, amt, None, ts(-40)))
        when = ts(0, 12) if tid % 3 else ts(0, 12, 1)
        del_rows.append((tid, when, tid))
        seq.append((box, when, tid, amt))
    b0 = {1: D("25.00"), 2: D("0.00")}
    expect = dict(b0)
    for box, _, _, amt in sorted(seq):
        expect[box] = max(D(0), expect[box] - amt)
    deletions = spark.createDataFrame(del_rows, "req_id BIGINT, ts TIMESTAMP_NTZ, tx_id BIGINT")
    b = boxes(spark, [{"id": k, "current_amount": v} for k, v in b0.items()])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        bal, _ = replay.tx_delete_apply(b, tx(spark, tx_rows), deletions, chunks=16)
        got = {r["box_id"]: (r["balance"], r["n_deleted"]) for r in bal.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {1: (expect[1], 1350), 2: (expect[2], 150)}


def test_replay_applies_a_resent_item_once(spark):
    rows = [(1, ts(0, 1), "d", 1, "add", 10, False), (2, ts(0, 2), "d", 1, "withdraw", 4, False),
            (3, ts(0, 3), "d", 1, "add", 1, False)]
    once = ops(spark, rows)
    twice = ops(spark, rows + rows[:2])
    a = replay.ordered_replay(once).first()
    b = replay.ordered_replay(twice, partitions=2).first()
    assert (a["final_balance"], a["n_ops"]) == (b["final_balance"], b["n_ops"]) == (D(7), 3)


def _loop_once(opening, seq):
    """Plain loop with the re-sent-item rule: an item equal in (ts, op_id) to
    the previous one is applied once."""
    bal, ok, n, last = opening, 0, 0, None
    for when, oid, op, a in seq:
        if (when, oid) == last:
            continue
        last = (when, oid)
        n += 1
        if a is None:
            ok += op == "reset"
            bal = D(0) if op == "reset" else bal
            continue
        if op == "add" and a != 0:
            bal += abs(a); ok += 1
        elif op == "withdraw" and a != 0 and bal >= abs(a):
            bal -= abs(a); ok += 1
        elif op == "reset":
            bal = D(0); ok += 1
        elif op == "delete_tx":
            bal = max(D(0), bal - a); ok += 1
    return bal, n, ok


def _random_log(rnd, n_hot, add_hi, wd_hi, reset_p):
    rows, seqs, oid = [], {}, 0
    sizes = {1: n_hot, 2: n_hot // 3, **{b: rnd.randint(1, 25) for b in range(3, 12)}}
    for box, size in sizes.items():
        for _ in range(size):
            oid += 1
            r = rnd.random()
            if r < reset_p:
                op, a = "reset", None
            elif r < 0.5:
                op, a = "add", D(rnd.randint(0, add_hi)) / 100
            elif r < 0.85:
                op, a = "withdraw", D(rnd.randint(0, wd_hi)) / 100
            elif r < 0.97:
                op, a = "delete_tx", D(rnd.randint(-wd_hi, wd_hi)) / 100
            else:
                op, a = rnd.choice(["add", "withdraw", "delete_tx", "recolor"]), None
            # few distinct instants, so many ops of a hot box share one ts
            when = ts(0, rnd.randint(0, 3), rnd.randint(0, 2))
            rows.append((oid, when, "d", box, op, a, False))
            if rnd.random() < 0.02:
                rows.append(rows[-1])  # re-sent item
    for r in rows:
        seqs.setdefault(r[3], []).append((r[1], r[0], r[4], r[5]))
    return rows, {b: sorted(s) for b, s in seqs.items()}


def test_replay_hot_box_spans_ranges_and_matches_plain_loop(spark):
    """A hot box over many ranges: with a high balance its pieces compose as
    sums, with a low one they run dry and take the sequential stretch path;
    resets cut stretches.  Both must equal the plain loop, with and without
    opening balances."""
    for seed, add_hi, wd_hi, reset_p in [(1, 9000, 3000, 0.0), (2, 3000, 4000, 0.0),
                                         (3, 3000, 3500, 0.01), (4, 2000, 2500, 0.05)]:
        rnd = random.Random(seed)
        rows, seqs = _random_log(rnd, 1200, add_hi, wd_hi, reset_p)
        q = ops(spark, rows)
        opening_vals = {1: D("30.00"), 3: D("0"), 4: D("12.34")}
        opening = spark.createDataFrame(list(opening_vals.items()), "box_id BIGINT, balance DECIMAL(12,2)")
        for op_df in (None, opening):
            got = {r["box_id"]: (r["final_balance"], r["n_ops"], r["n_applied"], r["n_rejected"])
                   for r in replay.ordered_replay(q, opening=op_df, partitions=24).collect()}
            expect = {}
            for b, s in seqs.items():
                start = opening_vals.get(b, D(0)) if op_df is not None else D(0)
                bal, n, ok = _loop_once(start, s)
                expect[b] = (bal, n, ok, n - ok)
            assert got == expect, (seed, op_df is not None)


def test_replay_steps_hot_box_matches_plain_loop(spark):
    """Per-op balances: resolved pieces fold in their own range, dry
    stretches in their own task; every op's balance equals the plain loop."""
    for seed, add_hi, wd_hi, reset_p in [(3, 3000, 3500, 0.01), (5, 9000, 3000, 0.0)]:
        rows, seqs = _random_log(random.Random(seed), 900, add_hi, wd_hi, reset_p)
        expect = {}
        for b, s in seqs.items():
            bal, last = D(0), None
            for when, oid, op, a in s:
                if (when, oid) == last:
                    continue
                last = (when, oid)
                bal, _, _ = _loop_once(bal, [(when, oid, op, a)])
                expect[oid] = bal
        got = {r["op_id"]: r["balance"] for r in replay.replay_steps(ops(spark, rows), partitions=20).collect()}
        assert got == expect, seed


# ---- the range summary pass, restated as a plain per-row loop -------------

import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402
import pytest  # noqa: E402


def _pieces_loop(batches: object) -> object:
    """One range of the global (box, ts, op_id) order -> one summary per box
    piece in it.  Segment A is the piece up to its first reset, segment B the
    rest (which starts from 0, so its result does not depend on the entry).

    * bal0, app0: exact result from entry 0 (or from the box's opening row);
    * t_a, m_a, v_a, n_a: total, minimum prefix, applied and op count of A
      when the entry covers A's drawdown (entry + m_a >= 0);
    * bal_b, app_b: exact result of B; cut_t, cut_op: key of the first reset.
    """
    out: list[list] = []
    cur = None
    for pdf in batches:
        cols = [pdf[c].tolist() for c in ("box_id", "chunk", "tkey", "op_id", "op", "cents", "has_amount")]
        for box, chunk, tk, oid, op, amt, has in zip(*cols):
            if cur is None or box != cur[0]:
                if cur is not None:
                    out.append(cur[:14])
                # box chunk n bal0 app0 n_a t_a m_a v_a reset bal_b app_b cut_t cut_op | last key
                cur = [box, chunk, 0, 0, 0, 0, 0, 0, 0, False, 0, 0, 0, 0, None]
            elif (tk, oid) == cur[14]:
                continue  # a re-sent item (same op_id and ts): applied once
            cur[14] = (tk, oid)
            a = int(amt) if has else None
            if op == "open":
                cur[3] = a
                continue
            cur[2] += 1
            cur[3], ok = replay._apply(op, a, cur[3])
            cur[4] += ok
            if cur[9]:
                cur[10], ok = replay._apply(op, a, cur[10])
                cur[11] += ok
            elif op == "reset":
                cur[9], cur[10], cur[11], cur[12], cur[13] = True, 0, 1, tk, oid
            else:
                d, ok = _covered_step(op, a)
                cur[5] += 1
                cur[6] += d
                cur[7] = min(cur[7], cur[6])
                cur[8] += ok
        if len(out) >= 10_000:
            yield pd.DataFrame(out, columns=replay.PIECE_COLS[:14])
            out = []
    if cur is not None:
        out.append(cur[:14])
    if out:
        yield pd.DataFrame(out, columns=replay.PIECE_COLS[:14])




def test_vectorised_pieces_equal_plain_loop_over_random_batches():
    """Many boxes, opens, resets, zero and null amounts, re-sent rows and
    long refusal runs; random Arrow batch sizes so pieces straddle batches."""
    rng = np.random.default_rng(3)
    for trial in range(40):
        n = int(rng.integers(1, 400))
        box = np.sort(rng.integers(0, int(rng.integers(1, 30)), n))
        op = rng.choice(["add", "withdraw", "delete_tx", "reset", "recolor"], n,
                        p=[.35, .45, .12, .05, .03]).astype(object)
        cents = rng.integers(-2000, 6000, n) * (rng.random(n) > 0.05)
        has = rng.random(n) > 0.03
        tk = np.arange(n) * 10
        oid = np.arange(n) + 100
        starts = np.r_[True, box[1:] != box[:-1]]
        opened = starts & (rng.random(n) < 0.5)
        df = pd.DataFrame({"box_id": box, "chunk": 3, "tkey": tk, "op_id": oid, "op": op,
                           "cents": cents, "has_amount": has})
        df = pd.concat([df, df[opened].assign(op="open", tkey=-2**63, op_id=-2**63,
                                              cents=rng.integers(0, 5000, int(opened.sum())), has_amount=True)])
        dup = df.sample(frac=0.05, random_state=trial)
        df = pd.concat([df, dup]).sort_values(["box_id", "tkey", "op_id"], kind="stable").reset_index(drop=True)
        cuts = np.sort(rng.choice(np.arange(1, len(df)), size=min(len(df) - 1, int(rng.integers(0, 8))),
                                  replace=False)) if len(df) > 1 else []
        parts = np.split(np.arange(len(df)), cuts)
        batches = [df.iloc[p].reset_index(drop=True) for p in parts]
        want = pd.concat(list(_pieces_loop(iter(batches))), ignore_index=True)
        got = pd.concat(list(replay._pieces(iter(batches))), ignore_index=True)
        cols = [c for c in replay.PIECE_COLS if c != "transfer"]
        want = want[cols].astype({"has_reset": bool}).reset_index(drop=True)
        got = got[cols].astype({"has_reset": bool}).reset_index(drop=True)
        for c in cols:
            assert [int(v) if c != "has_reset" else bool(v) for v in got[c]] == \
                   [int(v) if c != "has_reset" else bool(v) for v in want[c]], (trial, c)


def _group_loop(rows):
    """Plain restatement of the group fold: rows (box, grp, entry, tkey,
    op_id, op, cents, has) sorted; returns {(box, grp): (bal, applied)} and
    {op_id: (bal, applied)}."""
    groups, steps, key, last = {}, {}, None, None
    for box, grp, entry, tk, oid, op, amt, has in rows:
        if (box, grp) != key:
            key, bal, ok, last = (box, grp), entry, 0, None
        elif (tk, oid) == last:
            continue
        last = (tk, oid)
        bal, applied = replay._apply(op, amt if has else None, bal)
        if op != "open":
            ok += applied
            steps[oid] = (bal, applied)
        groups[key] = (bal, ok)
    return groups, steps


def test_vectorised_piece_fold_equals_plain_loop_over_random_batches():
    rng = np.random.default_rng(9)
    for trial in range(40):
        n = int(rng.integers(1, 300))
        box = np.sort(rng.integers(0, int(rng.integers(1, 6)), n))
        grp = np.zeros(n, dtype=np.int64)
        for b in np.unique(box):
            idx = np.flatnonzero(box == b)
            grp[idx] = np.sort(rng.integers(1, 4, len(idx)))
        entry = np.zeros(n, dtype=np.int64)
        for key in set(zip(box.tolist(), grp.tolist())):
            entry[(box == key[0]) & (grp == key[1])] = int(rng.integers(0, 4000))
        op = rng.choice(["add", "withdraw", "delete_tx", "reset", "recolor"], n, p=[.35, .45, .12, .05, .03])
        df = pd.DataFrame({"box_id": box, "chunk": grp, "entry": entry, "tkey": np.arange(n), "op_id": np.arange(n),
                           "op": op.astype(object), "cents": rng.integers(-2000, 6000, n),
                           "has_amount": rng.random(n) > 0.03})
        df = pd.concat([df, df.sample(frac=0.1, random_state=trial)]).sort_values(
            ["box_id", "chunk", "tkey", "op_id"], kind="stable").reset_index(drop=True)
        want_groups, want_steps = _group_loop(df.itertuples(index=False, name=None))
        cuts = np.sort(rng.choice(np.arange(1, len(df)), size=min(len(df) - 1, int(rng.integers(0, 10))),
                                  replace=False)) if len(df) > 1 else []
        batches = [df.iloc[p].reset_index(drop=True) for p in np.split(np.arange(len(df)), cuts)]
        got = pd.concat(list(replay._piece_fold(iter(batches), False)), ignore_index=True)
        assert {(int(r.box_id), int(r.chunk)): (int(r.fix_bal), int(r.fix_app)) for r in got.itertuples()} == want_groups
        st = pd.concat(list(replay._piece_fold(iter(batches), True)), ignore_index=True)
        assert {int(r.op_id): (int(r.balance_cents), bool(r.applied)) for r in st.itertuples()} == want_steps


def _covered_step(op, amt):
    """(delta, applied) of an op on a balance that covers it."""
    if amt is None or (amt == 0 and op != "delete_tx"):
        return 0, False
    return {"add": (abs(amt), True), "withdraw": (-abs(amt), True), "delete_tx": (-amt, True)}.get(op, (0, False))


@pytest.mark.parametrize("stretches,functions", [(1024, 64), (8, 1000), (8, 2)])
def test_transfer_equals_plain_loop_for_every_entry(monkeypatch, stretches, functions):
    """Chains of small functions give the same; a chain beyond its bound is given up."""
    monkeypatch.setattr(replay, "MOST_STRETCHES", stretches)
    monkeypatch.setattr(replay, "MOST_FUNCTIONS", functions)
    rng, given_up = np.random.default_rng(11), 0
    for trial in range(60):
        n = int(rng.integers(1, 700))
        code = rng.choice([2, 3, 4], n, p=[.45, .45, .1])
        amt = rng.integers(1, 60, n)
        amt[code == 4] -= 20
        delta = np.where(code == 2, amt, -amt)
        t = replay.Transfer()
        for part in np.array_split(np.arange(n), int(rng.integers(1, 6))):
            t.feed(code[part], amt[part], delta[part])
        packed = t.pack()
        if packed is None:
            given_up += 1
            continue
        for entry in [0, 1, 5, 17, 40, 77, 300, 2000, 10**9, *rng.integers(0, 400, 10).tolist()]:
            bal, ok = entry, 0
            for c, a in zip(code.tolist(), amt.tolist()):
                bal, applied = replay._apply(replay.CODE_OPS[c], a, bal)
                ok += applied
            assert replay.run_through(packed, entry) == (bal, ok), (trial, entry)
    assert (given_up > 0) == (functions == 2)


def _dry_log(n):
    """One box; every eighth op is a withdrawal that is nearly always refused."""
    rng = random.Random(4)
    out, last = [], 0
    for i in range(n):
        op, a = ("withdraw", 100000 + rng.randint(0, 10**6)) if i % 8 == 7 else ("add", rng.randint(1, 500)) if i % 3 else ("withdraw", rng.randint(1, 700))
        out.append((i, 1, op, D(a) / 100))
    return out


@pytest.mark.parametrize("partitions", [4, 16, 64])
def test_ranges_that_run_dry_take_one_walk(spark, monkeypatch, partitions):
    log = _dry_log(4000)
    rows = ops(spark, [(i, ts(0) + dt.timedelta(seconds=i), 1, b, o, a, False) for i, b, o, a in log])
    folds = []
    ship_package()  # workers get the bounds set here
    monkeypatch.setattr(replay, "_broadcast_if_small", lambda df, n: folds.append(n) or df)
    got = replay.ordered_replay(rows, partitions=partitions).first()
    bal, ok = 0, 0
    for _, _, o, a in log:
        bal, applied = replay._apply(o, int(a * 100), bal)
        ok += applied
    assert (int(got["final_balance"] * 100), got["n_applied"]) == (bal, ok) and not folds
    monkeypatch.setattr(replay, "MOST_FUNCTIONS", 0)     # given up: round by round, the same
    if partitions == 4:
        again = replay.ordered_replay(rows, partitions=partitions).first()
        assert again == got and folds


def test_replay_dry_pieces_beyond_the_broadcast_bound(spark):
    """With the broadcast bound at 0 the dry-piece list is joined by shuffle
    on (box, range); the result is the same."""
    rows, seqs = _random_log(random.Random(2), 1200, 3000, 4000, 0.0)
    spark.conf.set("jarledger.replay.broadcastPieces", "0")
    try:
        got = {r["box_id"]: (r["final_balance"], r["n_applied"])
               for r in replay.ordered_replay(ops(spark, rows), partitions=24).collect()}
        steps = {r["op_id"]: r["balance"] for r in replay.replay_steps(ops(spark, rows), partitions=24).collect()}
    finally:
        spark.conf.unset("jarledger.replay.broadcastPieces")
    expect = {}
    for b, s in seqs.items():
        bal, n, ok = _loop_once(D(0), s)
        expect[b] = (bal, ok)
    assert got == expect
    assert len(steps) == sum(len({(w, o) for w, o, _, _ in s}) for s in seqs.values())
