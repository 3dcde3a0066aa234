"""Golden cases for the balance series and chart helpers."""

import datetime as dt
import math
from decimal import Decimal as D

from jarledger.operators import series
from tests.frames import AS_OF, boxes, ts, tx


def _points(df):
    return [(r["point"], r["label"], r["balance"]) for r in df.orderBy("box_id", "point").collect()]


def test_g1_week_without_rows_is_flat(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 50}])
    out = series.balance_week(tx(spark, []), b, as_of=AS_OF)
    pts = _points(out)
    assert len(pts) == 7
    assert {p[2] for p in pts} == {D("50.00")}
    assert pts[-1][1] == AS_OF.strftime("%a")


def test_g2_all_without_rows_gives_start_and_now(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 50}])
    out = series.balance_all(tx(spark, []), b, as_of=AS_OF)
    rows = out.orderBy("point").collect()
    assert [(r["day"], r["label"], r["balance"]) for r in rows] == [
        (AS_OF, "Start", D("0.00")), (AS_OF, "Now", D("50.00"))]


def test_g3_all_without_rows_and_zero_balance_is_empty(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 0}])
    assert series.balance_all(tx(spark, []), b, as_of=AS_OF).count() == 0


def test_g4_reset_box_keeps_opening_at_zero(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 0}])
    t = tx(spark, [(1, 1, 30, None, ts(-3))])
    pts = _points(series.balance_week(t, b, as_of=AS_OF))
    assert [p[2] for p in pts] == [D(0), D(0), D(0), D(30), D(30), D(30), D(0)]


def test_g5_future_row_lowers_opening(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 20}])
    t = tx(spark, [(1, 1, 20, None, ts(2))])
    pts = _points(series.balance_week(t, b, as_of=AS_OF))
    assert [p[2] for p in pts] == [D(0)] * 6 + [D(20)]


def test_g6_all_last_day_before_as_of_keeps_running_sum(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 999}])
    t = tx(spark, [(1, 1, 10, None, ts(-5)), (2, 1, -4, None, ts(-5, 13)), (3, 1, 7, None, ts(-2))])
    rows = series.balance_all(t, b, as_of=AS_OF).orderBy("point").collect()
    assert [(r["day"], r["balance"], r["label"]) for r in rows] == [
        (AS_OF - dt.timedelta(days=5), D(6), "20 Jan"), (AS_OF - dt.timedelta(days=2), D(13), "23 Jan")]


def test_all_last_day_on_as_of_becomes_current(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 100}])
    t = tx(spark, [(1, 1, 10, None, ts(-5)), (2, 1, 5, None, ts(0))])
    rows = series.balance_all(t, b, as_of=AS_OF).orderBy("point").collect()
    assert [r["balance"] for r in rows] == [D(10), D(100)]


def test_month_labels_and_length(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 5}])
    out = series.balance_month(tx(spark, []), b, as_of=AS_OF).orderBy("point").collect()
    assert len(out) == 30
    assert out[-1]["label"] == "25" and out[0]["label"] == str((AS_OF - dt.timedelta(days=29)).day)


def test_g9_chart_ceilings_in_double(spark):
    b = boxes(spark, [
        {"id": 1, "current_amount": 10}, {"id": 2, "current_amount": 50},
        {"id": 3, "current_amount": 100}, {"id": 4, "current_amount": 100, "target_amount": 500},
        {"id": 5, "current_amount": 0},
    ])
    wk = series.balance_week(tx(spark, []), b, as_of=AS_OF)
    got = {r["box_id"]: r["ceiling"] for r in series.chart_scale(wk, b).collect()}
    assert got == {1: 11.0, 2: 56.0, 3: 111.0, 4: 500.0, 5: 2.0}


def test_axis_label_thinning(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 5}])
    mo = series.balance_month(tx(spark, []), b, as_of=AS_OF)
    rows = series.axis_labels(mo, 6).orderBy("point").collect()
    kept = [r["point"] for r in rows if r["axis_label"] != ""]
    assert kept == [0, 5, 10, 15, 20, 25]


def test_mini_bars_and_normalised_points(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 40}])
    t = tx(spark, [(1, 1, 20, None, ts(-1))])
    wk = series.balance_week(t, b, as_of=AS_OF)
    out = series.series_normalised(wk, series.chart_scale(wk, b)).orderBy("point").collect()
    # opening 20, then 40 from the day before as_of; ceiling ceil(40*1.1) in doubles
    assert [r["bar_height"] for r in out] == [10.0] * 5 + [20.0, 20.0]
    assert out[-1]["norm"] == 40 / math.ceil(40 * 1.1)


def test_series_sums_match_transactions(spark):
    """Property: with the stored balance equal to Σ amounts, the week's
    opening plus the in-period daily nets reach the stored balance."""
    rows = [(i, 1 + i % 3, (i % 7) - 2, None, ts(-(i % 9), i % 24)) for i in range(60)]
    rows = [r for r in rows if r[2] != 0]
    t = tx(spark, rows)
    sums = {}
    for _, bx, a, _, _ in rows:
        sums[bx] = sums.get(bx, 0) + a
    b = boxes(spark, [{"id": k, "current_amount": max(v, 0)} for k, v in sums.items()])
    pts = series.balance_week(t, b, as_of=AS_OF).collect()
    last = {r["box_id"]: r["balance"] for r in pts if r["point"] == 6}
    assert last == {k: D(max(v, 0)) for k, v in sums.items()}
