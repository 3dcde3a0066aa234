"""Operation-log replay.

The app mutates one row at a time; here an operation log
``(op_id, ts, device, box_id, op, amount, arg, failed)`` is replayed for all
boxes at once.

Order-dependent folds are done without gathering a box's operations anywhere:

* the guarded replay (O37) range-partitions the ops on (box, ts, op_id), so
  a hot box spans many ranges; each range summarises its piece of each box
  (the piece that began in an earlier range as a function of its entry
  balance), and one walk over each box's pieces composes them;
* the clamped delete fold (O41) has a closed form (a Lindley recursion), so it
  runs as a two-level prefix scan: per contiguous range of the global
  (box, ts, req_id) order, then over a box's ranges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jarledger.functions.text import js_trim, leading_number
from jarledger.functions.money import money, money_out, signed_amount
from jarledger.session import shared_dir

# ---------------------------------------------------------------- O35, O36


def op_signing(ops: DataFrame) -> DataFrame:
    """Queue items as signed amounts (withdraw -> -|a|, add -> |a|)."""
    return ops.where(F.col("op").isin("add", "withdraw")).select(
        "op_id", "box_id", "op", signed_amount(F.col("op"), F.col("amount")).alias("signed_amount")
    )


def drain_until_failure(queue: DataFrame) -> DataFrame:
    """Per device, items before the device's first failed item (in
    ``(ts, op_id)`` order) are posted; the failed item and everything after
    it stay queued.

    The first failure is a per-device aggregate (partial + final, so a device
    holding a third of all items costs one combined row per map task), joined
    back on ``device`` -- no window over a device's whole queue.
    """
    key = F.struct("ts", "op_id")
    first_fail = queue.where(F.col("failed")).groupBy("device").agg(F.min(key).alias("first_fail"))
    j = queue.join(first_fail, "device", "left")
    posted = F.col("first_fail").isNull() | (key < F.col("first_fail"))
    return j.select(*queue.columns, posted.alias("posted"))


# ---------------------------------------------------------------- O37

def _apply(op: str, amt, bal: int) -> tuple[int, bool]:
    """One guarded step on integer cents; returns (new balance, applied)."""
    if op == "open":
        return int(amt), True
    if op == "reset":
        return 0, True
    if amt is None:
        return bal, False
    if op == "add":
        a = abs(amt)
        return (bal + a, True) if a != 0 else (bal, False)
    if op == "withdraw":
        a = abs(amt)
        return (bal - a, True) if a != 0 and bal >= a else (bal, False)
    if op == "delete_tx":
        return max(0, bal - amt), True
    return bal, False


def _cents_to_money(c: str):
    return money_out(F.col(c).cast("decimal(18,0)") / 100)


PIECE_OUT = ("box_id BIGINT, chunk INT, n BIGINT, bal0 BIGINT, app0 BIGINT, n_a BIGINT, t_a BIGINT, "
             "m_a BIGINT, v_a BIGINT, has_reset BOOLEAN, bal_b BIGINT, app_b BIGINT, cut_t BIGINT, cut_op BIGINT, transfer BINARY")
PIECE_COLS = [c.split()[0] for c in PIECE_OUT.split(", ")]


# Fixed op codes of the vectorised pass (anything else is an unknown op).
OP_CODES = {"open": 0, "reset": 1, "add": 2, "withdraw": 3, "delete_tx": 4}
CODE_OPS = {v: k for k, v in OP_CODES.items()}
# Refusals fixed per vectorised round; a stretch between resets needing more
# is folded by the plain loop (exact either way).
FIX_ROUNDS = 16
# Bounds of a piece's transfer: stretches of the entry balance in one function, and functions.
MOST_STRETCHES = 1024
MOST_FUNCTIONS = 64
# Ops tried as one plain sum before they are taken one by one.
TRANSFER_BLOCK = 128


def _seg_cumsum(x: np.ndarray, seg: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Cumulative sum of ``x`` restarting at each segment start."""
    c = np.cumsum(x)
    base = np.r_[0, c[starts[1:] - 1]] if len(starts) > 1 else np.zeros(1, dtype=c.dtype)
    return c - base[seg]


def _guarded_fold(code, amt, has, delta, guarded, wd_ok, sub, sub_starts, start_val):
    """Exact guarded fold of every stretch between state-setting rows (piece
    start, open, reset), all at once: the balance is the plain running sum
    until a guarded step would go below 0; a refused withdrawal drops its
    step and a clamped delete lifts the sum to 0, and either only raises the
    rest of the stretch -- so each round fixes the first such step of every
    stretch.  Returns (balance after each row, refused flag per row)."""
    n = len(code)
    bal = start_val[sub] + _seg_cumsum(delta, sub, sub_starts)
    refused = np.zeros(n, dtype=bool)
    sub_end = np.r_[sub_starts[1:], n]
    for _ in range(FIX_ROUNDS):
        vi = np.flatnonzero(guarded & (bal < 0))
        if len(vi) == 0:
            return bal, refused
        fi = vi[np.r_[True, sub[vi][1:] != sub[vi][:-1]]]  # first per stretch
        wd = wd_ok[fi]
        lift = np.where(wd, -delta[fi], -bal[fi])
        refused[fi[wd]] = True
        diff = np.zeros(n + 1, dtype=np.int64)
        diff[fi] += lift  # one index per stretch, so plain indexing adds once
        diff[sub_end[sub[fi]]] -= lift
        bal += np.cumsum(diff[:-1])
    vi = np.flatnonzero(guarded & (bal < 0))
    if len(vi) == 0:
        return bal, refused
    # Stretches still refusing: the plain loop from their first open step on
    # (everything before it is already exact).
    fi = vi[np.r_[True, sub[vi][1:] != sub[vi][:-1]]]
    for i0 in fi:
        k = sub[i0]
        b = int(bal[i0 - 1]) if i0 > sub_starts[k] else int(start_val[k])
        for i in range(i0, sub_end[k]):
            if code[i] in (0, 1):
                b = int(amt[i]) if code[i] == 0 else 0
                refused[i] = False
            else:
                b, ok = _apply(CODE_OPS.get(int(code[i]), "?"), int(amt[i]) if has[i] else None, b)
                refused[i] = bool(wd_ok[i] and not ok)
            bal[i] = b
    return bal, refused


class Transfer:
    """Exit balance and applied count of a run of guarded steps, as functions of the entry balance (>= 0).

    A step moves a balance by a constant, keeps it (a refused withdrawal) or
    sets it to 0 (a clamped delete), so the run is linear with slope 1 or 0
    on stretches of the entry.  A withdrawal cuts the stretch in which its
    amount is first covered, a delete the one in which it first clamps.
    Stretches that a cut has left alike are joined again; where there are
    still more than ``MOST_STRETCHES``, the function is closed and a next one
    takes its exits as entries, so the whole is a short chain that a known
    entry runs through.  Beyond ``MOST_FUNCTIONS`` the chain is given up.
    """

    FIELDS = ("start", "value", "slope", "count")

    def __init__(self):
        self.closed: list[dict] | None = []
        self._open()

    def _open(self) -> None:
        self.start, self.value = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.slope, self.count = np.ones(1, np.int64), np.zeros(1, np.int64)
        self.shift = self.applied = 0   # of all stretches, beside value and count

    def _last(self) -> np.ndarray:
        """Each stretch's largest exit, without the shift."""
        size = np.append(np.diff(self.start), np.int64(1) << 62)
        return self.value + self.slope * (size - 1)

    def feed(self, code: np.ndarray, amt: np.ndarray, delta: np.ndarray) -> None:
        """Effective steps in order: codes of add, withdraw and delete_tx, amounts, and what each adds when it is covered."""
        for at in range(0, len(code), TRANSFER_BLOCK):
            if self.closed is None:
                return
            part = slice(at, at + TRANSFER_BLOCK)
            moved = np.cumsum(delta[part])
            if int(self.value.min()) + self.shift + int(moved.min()) >= 0:
                self.shift += int(moved[-1])    # whatever the entry, all is covered
                self.applied += len(moved)
                continue
            for c, a, d in zip(code[part].tolist(), amt[part].tolist(), delta[part].tolist()):
                if c == 2:
                    self.shift, self.applied = self.shift + d, self.applied + 1
                else:
                    self._guarded(-d, c == 3)
            if len(self.start) > MOST_STRETCHES // 2:
                self._join()
                if len(self.start) > MOST_STRETCHES:
                    self._close()

    def _guarded(self, a: int, withdraw: bool) -> None:
        """Take ``a`` where the balance covers it; else a withdrawal is refused, and a delete sets 0."""
        need = a - self.shift
        covered = self.value >= need
        if covered.all():
            self.shift, self.applied = self.shift - a, self.applied + 1
            return
        cut = np.flatnonzero(~covered & (self._last() >= need))
        if len(cut):    # (a stretch of slope 0 is covered as a whole or not at all)
            at = self.start[cut] + need - self.value[cut]
            self.start = np.insert(self.start, cut + 1, at)
            self.value = np.insert(self.value, cut + 1, need)
            self.slope = np.insert(self.slope, cut + 1, 1)
            self.count = np.insert(self.count, cut + 1, self.count[cut])
            covered = np.insert(covered, cut + 1, True)
        if withdraw:
            self.value = np.where(covered, self.value - a, self.value)
            self.count = self.count + covered
        else:
            self.value = np.where(covered, self.value - a, -self.shift)
            self.slope = np.where(covered, self.slope, 0)
            self.applied += 1

    def _join(self) -> None:
        size = np.diff(self.start)
        alike = ((self.slope[1:] == self.slope[:-1]) & (self.count[1:] == self.count[:-1])
                 & (self.value[1:] == self.value[:-1] + self.slope[:-1] * size))
        keep = np.append(True, ~alike)
        for f in self.FIELDS:
            setattr(self, f, getattr(self, f)[keep])

    def _close(self) -> None:
        self.closed.append({"start": self.start, "value": self.value + self.shift, "slope": self.slope, "count": self.count + self.applied})
        self._open()
        if len(self.closed) >= MOST_FUNCTIONS:
            self.closed = None

    def pack(self) -> bytes | None:
        """The chain as bytes (None if it was given up)."""
        if self.closed is None:
            return None
        self._join()
        self._close()
        if self.closed is None:
            return None
        flat = np.concatenate([np.concatenate([f[c] for c in self.FIELDS]) for f in self.closed])
        return np.concatenate(([len(self.closed)], [len(f["start"]) for f in self.closed], flat)).astype(np.int64).tobytes()


def run_through(packed: bytes, entry: int) -> tuple[int, int]:
    """The exit balance and applied count of a packed chain for one entry."""
    flat = np.frombuffer(packed, np.int64)
    sizes, at, applied = flat[1: 1 + flat[0]].tolist(), 1 + int(flat[0]), 0
    for n in sizes:
        start, value, slope, count = flat[at: at + 4 * n].reshape(4, n)
        i = int(np.searchsorted(start, entry, side="right")) - 1
        entry, applied = int(value[i] + slope[i] * (entry - start[i])), applied + int(count[i])
        at += 4 * n
    return entry, applied


def _pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One range of the global (box, ts, op_id) order -> one summary per box
    piece in it, vectorised per Arrow batch.  Segment A is the piece up to
    its first reset, segment B the rest (it starts from 0, so its result does
    not depend on the entry).

    * bal0, app0: exact result from entry 0 (or from the box's opening row);
    * t_a, m_a, v_a, n_a: total, minimum prefix, applied and op count of A
      when the entry covers A's drawdown (entry + m_a >= 0);
    * bal_b, app_b: exact result of B; cut_t, cut_op: key of the first reset;
    * transfer: A as a function of the entry (see ``Transfer``).  Only the box
      that a range begins with can have begun before it, so a range has one.

    A piece that continues into the next batch is carried as its state.
    """
    carry = None  # [box, n, bal0, app0, n_a, t_a, m_a, v_a, seen_reset, app_b, cut_t, cut_op, last key]
    out: list[pd.DataFrame] = []
    chunk = 0
    head = transfer = None  # the range's first box, its segment A
    for pdf in batches:
        if pdf.empty:
            continue
        chunk = int(pdf["chunk"].iat[0])
        box = pdf["box_id"].to_numpy(np.int64)
        tk = pdf["tkey"].to_numpy(np.int64)
        oid = pdf["op_id"].to_numpy(np.int64)
        code = pdf["op"].map(OP_CODES).fillna(5).to_numpy(np.int8)
        amt = pdf["cents"].to_numpy(np.int64)
        has = pdf["has_amount"].to_numpy(bool)
        # A re-sent item (same box, ts and op_id as the row before) is applied once.
        same = np.r_[False, (box[1:] == box[:-1]) & (tk[1:] == tk[:-1]) & (oid[1:] == oid[:-1])]
        if carry is not None and carry[0] == box[0] and carry[12] == (tk[0], oid[0]):
            same[0] = True
        last_key = (int(tk[-1]), int(oid[-1]))
        if same.any():
            keep = ~same
            box, tk, oid, code, amt, has = box[keep], tk[keep], oid[keep], code[keep], amt[keep], has[keep]
        if len(box) == 0:
            continue
        n = len(box)
        cont = carry is not None and carry[0] == box[0]
        if carry is not None and not cont:
            out.append(_carry_frame(carry, chunk, transfer if carry[0] == head else None))
            carry = None
        bstart = np.r_[True, box[1:] != box[:-1]]
        bstarts = np.flatnonzero(bstart)
        bseg = np.cumsum(bstart) - 1
        is_reset, is_open = code == 1, code == 0
        add_ok = (code == 2) & has & (amt != 0)
        wd_ok = (code == 3) & has & (amt != 0)
        del_ok = (code == 4) & has
        delta = np.where(add_ok, np.abs(amt), 0) - np.where(wd_ok, np.abs(amt), 0) - np.where(del_ok, amt, 0)
        valid = add_ok | wd_ok | del_ok
        counted = ~is_open
        # exact fold: stretches start at a piece start, an open row or a reset
        sstart = bstart | is_reset | is_open
        sub_starts = np.flatnonzero(sstart)
        sub = np.cumsum(sstart) - 1
        start_val = np.where(is_open[sub_starts], amt[sub_starts], 0)
        if cont and not (is_open[0] or is_reset[0]):
            start_val[0] = carry[2]
        bal, refused = _guarded_fold(code, amt, has, delta, wd_ok | del_ok, wd_ok, sub, sub_starts, start_val)
        applied = (is_reset | add_ok | del_ok | (wd_ok & ~refused)).astype(np.int64)
        # segment A: rows before the piece's first reset
        resets_upto = _seg_cumsum(is_reset.astype(np.int64), bseg, bstarts)
        in_a = resets_upto == 0
        if cont and carry[8]:
            in_a &= bseg != 0
        if head is None:
            head = int(box[0])
            transfer = None if is_open[0] else Transfer()
        if transfer is not None and box[0] == head:
            use = in_a & valid & (box == head)
            transfer.feed(code[use], amt[use], delta[use])
        da = np.where(in_a, delta, 0)
        pa = _seg_cumsum(da, bseg, bstarts)
        ends = np.r_[bstarts[1:], n] - 1

        def seg_sum(x):
            return np.add.reduceat(x.astype(np.int64), bstarts)

        k = len(bstarts)
        n_ops = seg_sum(counted)
        app0 = seg_sum(applied)
        n_a = seg_sum(in_a & counted)
        t_a = pa[ends].copy()
        m_a = np.minimum(np.minimum.reduceat(pa, bstarts), 0)
        v_a = seg_sum(valid & in_a)
        app_b = seg_sum(applied.astype(bool) & ~in_a & counted)
        has_reset = seg_sum(is_reset) > 0
        first_reset = np.flatnonzero(is_reset & (resets_upto == 1))
        cut_t = np.zeros(k, dtype=np.int64)
        cut_op = np.zeros(k, dtype=np.int64)
        cut_t[bseg[first_reset]] = tk[first_reset]
        cut_op[bseg[first_reset]] = oid[first_reset]
        bal0 = bal[ends]
        if cont:
            if carry[8]:
                has_reset[0], cut_t[0], cut_op[0] = True, carry[10], carry[11]
                t_a[0], m_a[0] = carry[5], carry[6]
            else:
                m_a[0] = min(carry[6], carry[5] + m_a[0])
                t_a[0] += carry[5]
            n_ops[0] += carry[1]
            app0[0] += carry[3]
            n_a[0] += carry[4]
            v_a[0] += carry[7]
            app_b[0] += carry[9]
        j = k - 1
        carry = [int(box[bstarts[j]]), int(n_ops[j]), int(bal0[j]), int(app0[j]), int(n_a[j]), int(t_a[j]),
                 int(m_a[j]), int(v_a[j]), bool(has_reset[j]), int(app_b[j]), int(cut_t[j]), int(cut_op[j]),
                 last_key]
        if k > 1:
            sl = slice(0, k - 1)
            out.append(pd.DataFrame({
                "box_id": box[bstarts[sl]], "chunk": np.int32(chunk), "n": n_ops[sl], "bal0": bal0[sl],
                "app0": app0[sl], "n_a": n_a[sl], "t_a": t_a[sl], "m_a": m_a[sl], "v_a": v_a[sl],
                "has_reset": has_reset[sl], "bal_b": np.where(has_reset[sl], bal0[sl], 0), "app_b": app_b[sl],
                "cut_t": cut_t[sl], "cut_op": cut_op[sl],
                "transfer": [transfer.pack() if transfer is not None and b == head else None for b in box[bstarts[sl]].tolist()]}))
        if sum(len(f) for f in out) >= 10_000:
            yield pd.concat(out, ignore_index=True)
            out = []
    if carry is not None:
        out.append(_carry_frame(carry, chunk, transfer if carry[0] == head else None))
    if out:
        yield pd.concat(out, ignore_index=True)


def _carry_frame(c: list, chunk: int, transfer: Transfer | None) -> pd.DataFrame:
    return pd.DataFrame([[c[0], chunk, c[1], c[2], c[3], c[4], c[5], c[6], c[7], c[8], c[2] if c[8] else 0,
                          c[9], c[10], c[11], None if transfer is None else transfer.pack()]], columns=PIECE_COLS)


WALK_OUT = ("kind STRING, box_id BIGINT, chunk INT, entry BIGINT, cut BOOLEAN, cut_t BIGINT, "
            "cut_op BIGINT, n BIGINT, applied BIGINT, bal BIGINT")
WALK_COLS = [c.split()[0] for c in WALK_OUT.split(", ")]


def _walk(batches: Iterator[pd.DataFrame], entries: bool = False) -> Iterator[pd.DataFrame]:
    """Compose a box's pieces in range order (rows sorted by box, chunk).

    The first piece starts at the box's opening, so its exact result holds.
    A later piece whose entry covers its drawdown adds its total; an entry
    of 0 takes the exact result; a reset makes the rest of the piece
    independent of the entry.  Otherwise the piece is *dry* (a withdrawal may
    be refused, a delete may clamp) and the entry runs through its transfer.
    A piece without one (given up as too many stretches, or a balance below 0)
    is emitted as a 'piece' row with its entry unless an earlier
    round has folded it (``fixed``), and the box's balance is unknown up to the next reset.  Emits one
    'box' row per box.  With ``entries``, also one 'entry' row per resolved
    piece with its entry balance, for per-op output.
    """
    out: list[tuple] = []
    box = None
    st = None  # [n, applied, bal or None (behind a piece not folded yet)]

    def close():
        if box is not None:
            out.append(("box", box, 0, 0, False, 0, 0, st[0], st[1], st[2] or 0))

    def entry(chunk, b):
        if entries:
            out.append(("entry", box, chunk, b, False, 0, 0, 0, 0, 0))

    for pdf in batches:
        for r in pdf.itertuples(index=False):
            if r.box_id != box:
                close()
                box = r.box_id
                st = [r.n, r.app0, r.bal0]
                entry(r.chunk, 0)
                continue
            st[0] += r.n
            b = st[2]
            if b is not None and r.fixed:
                entry(r.chunk, b)
                st[1] += r.fix_app + r.app_b
                st[2] = r.bal_b if r.has_reset else r.fix_bal
            elif b is not None and (r.n_a == 0 or b + r.m_a >= 0):
                entry(r.chunk, b)
                st[1] += r.v_a + r.app_b
                st[2] = r.bal_b if r.has_reset else b + r.t_a
            elif b == 0:
                entry(r.chunk, 0)
                st[1] += r.app0
                st[2] = r.bal0
            elif b is not None and b > 0 and r.transfer is not None:
                entry(r.chunk, b)
                exit_, applied = run_through(r.transfer, b)
                st[1] += applied + r.app_b
                st[2] = r.bal_b if r.has_reset else exit_
            else:
                if b is not None:
                    out.append(("piece", box, r.chunk, b, r.has_reset, r.cut_t, r.cut_op, 0, 0, 0))
                st[2] = r.bal_b if r.has_reset else None
        if len(out) >= 10_000:
            yield pd.DataFrame.from_records(out, columns=WALK_COLS)
            out = []
    close()
    if out:
        yield pd.DataFrame.from_records(out, columns=WALK_COLS)


FOLD_OUT = "box_id BIGINT, chunk INT, fix_bal BIGINT, fix_app BIGINT"
STEPS_OUT = "op_id BIGINT, box_id BIGINT, balance_cents BIGINT, applied BOOLEAN"


def _piece_fold(batches: Iterator[pd.DataFrame], steps: bool) -> Iterator[pd.DataFrame]:
    """Fold each (box, chunk) piece's rows, sorted by (box, chunk, ts, op_id),
    from the piece's entry balance, vectorised per Arrow batch (see
    ``_guarded_fold``); a piece that continues into the next batch is
    carried as (balance, applied count).  Emits (box, chunk, balance, applied)
    per piece, or one row per op."""
    cols_out = ["op_id", "box_id", "balance_cents", "applied"] if steps else ["box_id", "chunk", "fix_bal", "fix_app"]
    carry = None  # [box, grp, bal, applied, last key]
    out: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        box = pdf["box_id"].to_numpy(np.int64)
        grp = pdf["chunk"].to_numpy(np.int64)
        entry = pdf["entry"].to_numpy(np.int64)
        tk = pdf["tkey"].to_numpy(np.int64)
        oid = pdf["op_id"].to_numpy(np.int64)
        code = pdf["op"].map(OP_CODES).fillna(5).to_numpy(np.int8)
        amt = pdf["cents"].to_numpy(np.int64)
        has = pdf["has_amount"].to_numpy(bool)
        new_grp = np.r_[True, (box[1:] != box[:-1]) | (grp[1:] != grp[:-1])]
        same = ~new_grp & np.r_[False, (tk[1:] == tk[:-1]) & (oid[1:] == oid[:-1])]
        cont = carry is not None and (carry[0], carry[1]) == (box[0], grp[0])
        if cont and carry[4] == (tk[0], oid[0]):
            same[0] = True
        last_key = (int(tk[-1]), int(oid[-1]))
        if same.any():
            keep = ~same
            box, grp, entry, tk, oid, code, amt, has, new_grp = (
                x[keep] for x in (box, grp, entry, tk, oid, code, amt, has, new_grp))
            if len(box) == 0:
                continue
            new_grp[0] = True
            cont = carry is not None and (carry[0], carry[1]) == (box[0], grp[0])
        if carry is not None and not cont and not steps:
            out.append(pd.DataFrame([carry[:4]], columns=cols_out))
        n = len(box)
        gstarts = np.flatnonzero(new_grp)
        is_reset, is_open = code == 1, code == 0
        add_ok = (code == 2) & has & (amt != 0)
        wd_ok = (code == 3) & has & (amt != 0)
        del_ok = (code == 4) & has
        delta = np.where(add_ok, np.abs(amt), 0) - np.where(wd_ok, np.abs(amt), 0) - np.where(del_ok, amt, 0)
        sstart = new_grp | is_reset | is_open
        sub_starts = np.flatnonzero(sstart)
        sub = np.cumsum(sstart) - 1
        start_val = np.where(is_open[sub_starts], amt[sub_starts], np.where(is_reset[sub_starts], 0, entry[sub_starts]))
        if cont and not (is_open[0] or is_reset[0]):
            start_val[0] = carry[2]
        bal, refused = _guarded_fold(code, amt, has, delta, wd_ok | del_ok, wd_ok, sub, sub_starts, start_val)
        applied = is_reset | add_ok | del_ok | (wd_ok & ~refused)
        if steps:
            rows = ~is_open
            out.append(pd.DataFrame({"op_id": oid[rows], "box_id": box[rows], "balance_cents": bal[rows],
                                     "applied": applied[rows]}))
        ends = np.r_[gstarts[1:], n] - 1
        ok = np.add.reduceat(applied.astype(np.int64), gstarts)
        if cont:
            ok[0] += carry[3]
        k = len(gstarts)
        carry = [int(box[ends[-1]]), int(grp[ends[-1]]), int(bal[ends[-1]]), int(ok[-1]), last_key]
        if not steps and k > 1:
            out.append(pd.DataFrame({"box_id": box[gstarts[:-1]], "chunk": grp[gstarts[:-1]].astype(np.int32),
                                     "fix_bal": bal[ends[:-1]], "fix_app": ok[:-1]}))
        if sum(len(f) for f in out) >= 10_000:
            yield pd.concat(out, ignore_index=True)
            out = []
    if carry is not None and not steps:
        out.append(pd.DataFrame([carry[:4]], columns=cols_out))
    if out:
        yield pd.concat(out, ignore_index=True)


def _ranged_ops(ops: DataFrame, opening: DataFrame | None, partitions: int | None) -> DataFrame:
    """Ops (and opening rows) range-partitioned on (box, ts, op_id), sorted in
    each range and tagged with the range number."""
    cents = (F.col("amount").cast("decimal(14,2)") * 100).cast("bigint")
    first = F.lit(-(2 ** 63)).cast("bigint")
    tkey = F.coalesce(F.unix_micros(F.col("ts").cast("timestamp")), first)
    o = ops.select("box_id", tkey.alias("tkey"), "op_id", "op", F.coalesce(cents, F.lit(0)).alias("cents"),
                   F.col("amount").isNotNull().alias("has_amount"))
    if opening is not None:
        o = o.unionByName(opening.select(
            "box_id", first.alias("tkey"), first.alias("op_id"), F.lit("open").alias("op"),
            F.coalesce((F.col("balance").cast("decimal(22,2)") * 100).cast("bigint"), F.lit(0)).alias("cents"),
            F.lit(True).alias("has_amount")))
    keys = ["box_id", "tkey", "op_id"]
    o = o.repartitionByRange(partitions, *keys) if partitions else o.repartitionByRange(*keys)
    return o.sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id())


def _staged_ops(ops: DataFrame, opening: DataFrame | None, partitions: int | None) -> DataFrame:
    """The ranged ops written once to the shared checkpoint folder, so every
    pass below reads the same ranges (and a lost executor costs a re-read,
    not a re-sort)."""
    shared_dir(ops.sparkSession, "replay")  # makes sure a checkpoint folder is set
    return _ranged_ops(ops, opening, partitions).checkpoint(eager=True)


def _walked(staged: DataFrame, entries: bool) -> DataFrame:
    """Piece summaries composed per box: one row per box, plus one per piece
    with ``entries``; written to the shared folder.

    One walk does it where every piece is covered by its entry or has a
    transfer.  For a piece whose transfer was given up, a round walks every
    box up to its first such piece (and on from each later reset), folds
    these, each in its own range from its known entry, and gives their
    results to the next round's walk.  No task gets more than a range, and a
    walk one bounded row for each range of a box.
    """
    pieces, fixes = staged.mapInPandas(_pieces, PIECE_OUT), None
    while True:
        known = (pieces.select("*", F.lit(False).alias("fixed"), F.lit(0).cast("bigint").alias("fix_bal"),
                               F.lit(0).cast("bigint").alias("fix_app")) if fixes is None else
                 pieces.join(fixes.withColumn("fixed", F.lit(True)), ["box_id", "chunk"], "left")
                 .fillna({"fixed": False, "fix_bal": 0, "fix_app": 0}))
        walked = (known.repartition("box_id").sortWithinPartitions("box_id", "chunk")
                  .mapInPandas(lambda it: _walk(it, entries), WALK_OUT).checkpoint(eager=True))
        dry = walked.where(F.col("kind") == "piece").select("box_id", "chunk", "entry", "cut", "cut_t", "cut_op")
        n_dry = dry.count()
        if not n_dry:
            return walked
        if fixes is None:
            pieces = pieces.checkpoint(eager=True)
        rows = staged.join(_broadcast_if_small(dry, n_dry), ["box_id", "chunk"]).where(
            ~F.col("cut") | (F.struct("tkey", "op_id") < F.struct("cut_t", "cut_op")))
        folded = (rows.select("box_id", "chunk", "entry", "tkey", "op_id", "op", "cents", "has_amount")
                  .sortWithinPartitions("box_id", "chunk", "tkey", "op_id")
                  .mapInPandas(lambda it: _piece_fold(it, False), FOLD_OUT))
        fixes = (folded if fixes is None else fixes.unionByName(folded)).checkpoint(eager=True)


def _broadcast_if_small(df: DataFrame, n: int) -> DataFrame:
    """Broadcast a piece list whose row count was measured and is small
    (default 500k rows of 8 narrow columns, about 30 MB); beyond that both
    sides shuffle on (box, range), a key no box can skew."""
    lim = int(df.sparkSession.conf.get("jarledger.replay.broadcastPieces", "500000"))
    return F.broadcast(df) if n <= lim else df


def ordered_replay(ops: DataFrame, opening: DataFrame | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Replay each box's operations in ``(ts, op_id)`` order.

    add: +|a| (a zero amount is rejected, as the amount != 0 check would);
    withdraw: -|a|, rejected when |a| = 0 or the balance is below |a|;
    reset: 0; delete_tx: max(0, balance - a).  Boxes start at 0 or at
    ``opening(box_id, balance)``.  Output per box: final balance and counts.
    Devices deliver at least once: an item seen again (same op_id and ts)
    is applied once.

    No box is gathered into one task.  The ops are range-partitioned on
    (box, ts, op_id), so a hot box spans many ranges; each range summarises
    its piece of each box in one pass (exact result from 0, plus total and
    minimum prefix before its first reset).  A walk over each box's pieces
    (at most one per range) composes them: a piece whose entry balance covers
    its drawdown behaves as a plain sum, and a reset cuts the dependency on
    the entry.  Where a box's balance runs dry inside a later piece, its
    entry runs through the piece's transfer (see ``Transfer``), so the jobs
    are the same however many ranges run dry.  Exact in integer cents.
    """
    walked = _walked(_staged_ops(ops, opening, partitions), entries=False)
    return walked.where(F.col("kind") == "box").select(
        "box_id", _cents_to_money("bal").alias("final_balance"), F.col("n").alias("n_ops"),
        F.col("applied").alias("n_applied"), (F.col("n") - F.col("applied")).alias("n_rejected"))


def replay_steps(ops: DataFrame, opening: DataFrame | None = None,
                 partitions: int | None = None) -> DataFrame:
    """O37 per operation: balance after each op and whether it applied.

    Same pieces and walk as ``ordered_replay``; each piece is then folded
    inside its own range from its entry balance."""
    staged = _staged_ops(ops, opening, partitions)
    assign = _walked(staged, entries=True).where(F.col("kind") == "entry").select("box_id", "chunk", "entry")
    steps = (staged.join(_broadcast_if_small(assign, assign.count()), ["box_id", "chunk"])
             .select("box_id", "chunk", "entry", "tkey", "op_id", "op", "cents", "has_amount")
             .sortWithinPartitions("box_id", "chunk", "tkey", "op_id")
             .mapInPandas(lambda it: _piece_fold(it, True), STEPS_OUT))
    return steps.select("op_id", "box_id", _cents_to_money("balance_cents").alias("balance"), "applied")


# ---------------------------------------------------------------- O38

def box_attribute_merge(boxes: DataFrame, attr_ops: DataFrame) -> DataFrame:
    """Apply the last rename / retarget / archive / restore per box.

    rename: trimmed text, a blank one is ignored; retarget: blank text clears
    the target, a text that starts with a
    number >= 0 sets it, anything else is ignored; archive and
    restore set the flag.  ``updated_at`` becomes the time of the last applied
    op other than archive (archiving does not touch it in the database).
    Everything is one partial+final aggregate per box; ties on ts break on op_id.
    """
    op, arg = F.col("op"), F.col("arg")
    order = F.struct("ts", "op_id")
    name = js_trim(arg)
    is_rename = (op == "rename") & name.isNotNull() & (name != "")
    tnum = leading_number(arg)
    blank = arg.isNull() | (js_trim(arg) == "")
    is_retarget = (op == "retarget") & (blank | (tnum.isNotNull() & (tnum >= 0)))
    is_flag = op.isin("archive", "restore")
    valid = is_rename | is_retarget | is_flag
    agg = attr_ops.groupBy("box_id").agg(
        F.max_by(name, F.when(is_rename, order)).alias("new_name"),
        F.max(F.when(is_retarget, order)).alias("retarget_at"),
        F.max_by(F.when(~blank, tnum), F.when(is_retarget, order)).alias("new_target"),
        F.max_by(op == "archive", F.when(is_flag, order)).alias("new_archived"),
        F.max(F.when(valid & (op != "archive"), F.col("ts"))).alias("touched"),
    )
    old_updated = F.col("updated_at") if "updated_at" in boxes.columns else F.col("created_at")
    j = boxes.join(agg.withColumnRenamed("box_id", "id"), "id", "left")
    return j.select(
        "id",
        F.coalesce(F.col("new_name"), F.col("name")).alias("name"),
        F.when(F.col("retarget_at").isNotNull(), money(F.col("new_target")))
        .otherwise(F.col("target_amount")).alias("target_amount"),
        F.coalesce(F.col("new_archived"), F.col("is_archived")).alias("is_archived"),
        F.greatest(F.col("touched"), old_updated).alias("updated_at"),
    )


def profile_edit(profiles: DataFrame, edits: DataFrame) -> DataFrame:
    """``edits(edit_id, ts, user_id, typed)`` -> profiles with the last typed name.

    The name is trimmed; a blank or missing one clears it.  The newest edit of
    a user wins, ties on ts by edit_id; edits of unknown users do nothing.  One
    partial+final aggregate per user, then a join.
    """
    newest = edits.where(F.col("user_id").isNotNull()).groupBy(F.col("user_id").alias("id")).agg(
        F.max_by(F.struct(F.nullif(js_trim(F.col("typed")), F.lit("")).alias("name")), F.struct("ts", "edit_id")).alias("last"))
    return profiles.join(newest, "id", "left").select(
        "id", F.when(F.col("last").isNull(), F.col("full_name")).otherwise(F.col("last.name")).alias("full_name"))


# ---------------------------------------------------------------- O39

def box_from_template(requests: DataFrame, templates: DataFrame) -> DataFrame:
    """``requests(request_id, user_id, template_id, name)`` -> new boxes.

    The name is the request's when non-empty (spaces count), else the
    template's; an unknown template drops the request.  The box takes no
    currency or target from the template, so currency is the column default
    EUR even for a UAH template.
    """
    t = templates.select(F.col("id").alias("template_id"), F.col("name").alias("template_name"))
    j = requests.join(t, "template_id", "inner")
    return j.select(
        "request_id", "user_id", "template_id",
        F.coalesce(F.nullif(F.col("name"), F.lit("")), F.col("template_name")).alias("name"),
        F.lit("EUR").alias("currency"),
        money(F.lit(0)).alias("current_amount"),
        F.lit(None).cast("decimal(12,2)").alias("target_amount"),
        F.lit(False).alias("is_archived"),
    )


# ---------------------------------------------------------------- O40

def first_crossings(requests: DataFrame, boxes: DataFrame, order: Column) -> DataFrame:
    """``(box_id, idx, first)``: the least ``order`` of the requests for a cell that its box has not ``crossed``."""
    first = requests.where("box_id is not null and idx is not null").groupBy("box_id", "idx").agg(F.min(order).alias("first"))
    has = boxes.select(F.col("box_id").alias("id"), "crossed").hint("merge")
    return first.join(has, (F.col("box_id") == F.col("id")) & ~F.array_contains("crossed", F.col("idx")), "left_semi")


def crossout_apply(boxes: DataFrame, templates: DataFrame, requests: DataFrame
                   ) -> tuple[DataFrame, DataFrame]:
    """``requests(req_id, ts, box_id, idx)`` -> (box arrays, new transactions).

    A request for an index the box already crossed, or a repeat of an earlier
    request, does nothing; the rest are appended to the box's array in
    request order.  An index inside the template grid whose value is > 0 also
    posts a transaction 'Crossed out index i' of that value.

    The tables join by sorted shuffles: Spark guesses the size of exploded boxes
    and of grids far too low and would broadcast them whole through the driver.
    Requests are narrowed to one per cell first, so a box with very many of them
    brings no more rows to its task than its array takes.
    """
    b = boxes.select(F.col("id").alias("box_id"), "template_id",
                     F.coalesce("crossed_out_indices", F.array().cast("array<int>")).alias("crossed"))
    first = first_crossings(requests, b, F.struct("ts", "req_id"))
    new = first.groupBy("box_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "idx"))), lambda s: s["idx"]).alias("added")
    )
    arrays = b.hint("merge").join(new, "box_id", "inner").select(
        "box_id", F.concat("crossed", "added").alias("crossed_out_indices"),
        F.size("added").cast("bigint").alias("n_added"),
    )
    t = templates.select(F.col("id").alias("template_id"), F.col("grid_config").alias("grid"))
    g = first.join(b.select("box_id", "template_id").hint("merge"), "box_id").join(t.hint("merge"), "template_id")
    value = F.when((F.col("idx") >= 0) & (F.col("idx") < F.size("grid")), F.get(F.col("grid"), F.col("idx")))
    tx = g.where(value > 0).select(
        "box_id",
        money(value).alias("amount"),
        F.concat(F.lit("Crossed out index "), F.col("idx").cast("string")).alias("note"),
        F.col("first.ts").alias("date"),
    )
    return arrays, tx


# ---------------------------------------------------------------- O41

CHUNK_OUT = "box_id BIGINT, chunk INT, t BIGINT, m BIGINT, k BIGINT"


def _chunk_summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Per box within one range partition: total t, minimum prefix sum m and
    row count k of the (sorted) steps x, vectorised per Arrow batch; a box
    that straddles batches carries (t, m, k) into the next one."""
    carry = None  # (box, chunk, t, m, k)
    for pdf in batches:
        if pdf.empty:
            continue
        box = pdf["box_id"].to_numpy()
        x = pdf["x"].to_numpy(dtype=np.int64)
        chunk = int(pdf["chunk"].iat[0])
        starts = np.flatnonzero(np.r_[True, box[1:] != box[:-1]])
        ends = np.r_[starts[1:], len(x)]
        cs = np.cumsum(x)
        before = np.r_[0, cs[starts[1:] - 1]] if len(starts) > 1 else np.zeros(1, dtype=np.int64)
        run = cs - np.repeat(before, ends - starts)
        t = run[ends - 1].copy()
        m = np.minimum.reduceat(run, starts)
        k = (ends - starts).astype(np.int64)
        b = box[starts]
        if carry is not None and carry[0] == b[0]:
            m[0] = min(carry[3], carry[2] + m[0])
            t[0] += carry[2]
            k[0] += carry[4]
        elif carry is not None:
            yield pd.DataFrame([carry], columns=["box_id", "chunk", "t", "m", "k"])
        carry = (int(b[-1]), chunk, int(t[-1]), int(m[-1]), int(k[-1]))
        if len(b) > 1:
            yield pd.DataFrame({"box_id": b[:-1], "chunk": chunk, "t": t[:-1], "m": m[:-1], "k": k[:-1]})
    if carry is not None:
        yield pd.DataFrame([carry], columns=["box_id", "chunk", "t", "m", "k"])


def tx_delete_apply(boxes: DataFrame, tx: DataFrame, deletions: DataFrame, chunks: int | None = None
                    ) -> tuple[DataFrame, DataFrame]:
    """``deletions(req_id, ts, tx_id)`` -> (new box balances, remaining tx).

    Each deleted transaction sets its box to max(0, balance - amount), in
    ``(ts, req_id)`` order; a transaction is deleted once, and requests for
    unknown transactions or boxes do nothing.

    The clamp b_k = max(0, b_{k-1} + x_k) with x = -amount has the closed form
    b_n = S_n - min(-b_0, 0, min_k S_k) over prefix sums S_k, and (total,
    minimum prefix) pairs compose over consecutive pieces:
    (t1, m1) then (t2, m2) -> (t1 + t2, min(m1, t1 + m2)).  So the steps are
    range-partitioned on (box, ts, req_id) -- a hot box spreads over many
    contiguous ranges -- each range is summarised per box in one vectorised
    pass, and only the per-range summaries (at most one per range) are
    composed per box.  Exact in integer cents.
    """
    d = deletions.groupBy("tx_id").agg(F.min(F.struct("ts", "req_id")).alias("first"))
    t = tx.select(F.col("id").alias("tx_id"), "box_id", "amount")
    known = boxes.select(F.col("id").alias("box_id"), F.col("current_amount").alias("b0"))
    hits = d.join(t, "tx_id").join(known.select("box_id"), "box_id", "left_semi").select(
        "box_id", "tx_id", F.col("first.ts").alias("ts"), F.col("first.req_id").alias("req_id"),
        (-(F.col("amount").cast("decimal(14,2)") * 100)).cast("bigint").alias("x"),
    )
    keys = ["box_id", "ts", "req_id"]
    ranged = (hits.repartitionByRange(chunks, *keys) if chunks else hits.repartitionByRange(*keys)) \
        .sortWithinPartitions(*keys)
    summaries = ranged.select("box_id", F.spark_partition_id().alias("chunk"), "x") \
        .mapInPandas(_chunk_summaries, CHUNK_OUT)
    w_c = Window.partitionBy("box_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    composed = summaries.withColumn("before", F.coalesce(F.sum("t").over(w_c), F.lit(0)))
    per_box = composed.groupBy("box_id").agg(
        F.sum("t").alias("s"), F.min(F.col("before") + F.col("m")).alias("mn"), F.sum("k").alias("n"))
    b0 = (F.col("b0").cast("decimal(14,2)") * 100).cast("bigint")
    final_cents = F.col("s") - F.least(-b0, F.lit(0), F.col("mn"))
    bal = per_box.join(known, "box_id").select(
        "box_id",
        money_out(final_cents.cast("decimal(18,0)") / 100).alias("balance"),
        F.col("n").cast("bigint").alias("n_deleted"),
    )
    remaining = tx.join(hits.select(F.col("tx_id").alias("id")), "id", "left_anti")
    return bal, remaining
