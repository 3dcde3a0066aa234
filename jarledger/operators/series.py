"""Balance-over-time series (O25-O27) and chart helpers.

Plan shape, for every box at once:
  1. one partial+final aggregate of transactions to (box, day) -- this bounds
     a hot box to one row per day before anything else is shuffled;
  2. week / month: a second aggregate folds each box's in-period days into a
     short list (at most 7 or 30 entries, one per calendar day of the period)
     plus the period total; after the join to the boxes, each box's points
     are generated in place (``explode(sequence)``), so the boxes x days spine
     is never shuffled -- only one row per box and per active box-day is;
  3. 'all': box rows and daily rows meet in one window exchange on
     ``box_id`` that computes the running sum, the last day and the box's
     current balance in a single Window operator.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jarledger.functions.dates import day_key, day_month_label, month_day_label, weekday_label
from jarledger.functions.money import money_out, to_double

WEEK_DAYS = 7
MONTH_DAYS = 30


def _as_date(d: dt.date | str) -> dt.date:
    return d if isinstance(d, dt.date) else dt.date.fromisoformat(d)


def daily_net(tx: DataFrame, since: dt.date | None = None) -> DataFrame:
    """(box_id, day, net): Σ amount per box and UTC day, optionally from ``since`` on
    (rows after as_of are kept: they lower the opening balance)."""
    day = day_key("date")
    if since is not None:
        tx = tx.where(day >= F.lit(since))
    return tx.groupBy("box_id", day.alias("day")).agg(F.sum("amount").alias("net"))


def _ordered(part: str = "box_id", order: str = "day") -> tuple:
    w = Window.partitionBy(part).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = w.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    return whole, upto


def balance_period(tx: DataFrame, boxes: DataFrame, *, as_of: dt.date | str, days: int,
                   label: Column | None = None) -> DataFrame:
    """``days`` daily points ending on ``as_of`` for every box.

    opening = max(0, current - Σ amount dated on/after the first day), future
    rows included; point(day) = opening + Σ amount from the first day through
    ``day``; the last point is the stored current balance.
    """
    as_of = _as_date(as_of)
    first = as_of - dt.timedelta(days=days - 1)
    pts = period_boxes(tx, boxes, first, as_of).select(
        "box_id", "cur", "entries", "opening", F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day"))
    label = label if label is not None else weekday_label(F.col("day"))
    return pts.select(
        "box_id",
        F.datediff(F.col("day"), F.lit(first)).cast("bigint").alias("point"),
        "day",
        label.alias("label"),
        point_balance(F.col("day"), as_of).alias("balance"),
    )


def period_aggregates(first: dt.date, as_of: dt.date) -> list[Column]:
    """Of a box's daily rows: the period total (future days too) and the in-period
    days -- a list bounded by the period length, whatever the box's volume."""
    day = F.col("day")
    return [F.sum(F.when(day >= F.lit(first), F.col("net"))).alias("period_sum"),
            F.collect_list(F.when(day.between(F.lit(first), F.lit(as_of)), F.struct("day", "net"))).alias("entries")]


def opening_balance(cur: Column) -> Column:
    return F.greatest(F.lit(0), cur - F.coalesce(F.col("period_sum"), F.lit(0)))


def period_boxes(tx: DataFrame, boxes: DataFrame, first: dt.date, as_of: dt.date) -> DataFrame:
    """One row per box: target, current and opening balance, in-period days."""
    per_box = daily_net(tx, since=first).groupBy("box_id").agg(*period_aggregates(first, as_of))
    b = boxes.select(F.col("id").alias("box_id"), F.col("current_amount").alias("cur"), "target_amount")
    return b.join(per_box, "box_id", "left").withColumn("opening", opening_balance(F.col("cur")))


def point_balance(day: Column, as_of: dt.date) -> Column:
    """The balance on a day of the period, from ``cur``, ``opening`` and ``entries``."""
    acc_t = "decimal(22,2)"
    run = F.aggregate(
        F.filter(F.coalesce(F.col("entries"), F.array().cast(f"array<struct<day:date,net:{acc_t}>>")),
                 lambda e: e["day"] <= day),
        F.lit(0).cast(acc_t), lambda acc, e: (acc + e["net"]).cast(acc_t),
    )
    # Most boxes have no in-period day: skip the per-point list scan for them.
    return money_out(F.when(day == F.lit(as_of), F.col("cur"))
                     .when(F.col("entries").isNull() | (F.size("entries") == 0), F.col("opening"))
                     .otherwise(F.col("opening") + run))


def period_peak(first: dt.date, as_of: dt.date) -> Column:
    """The highest point of the period, without a row per point."""
    return F.array_max(F.transform(F.sequence(F.lit(first), F.lit(as_of)),
                                   lambda day: to_double(point_balance(day, as_of))))


def balance_week(tx: DataFrame, boxes: DataFrame, *, as_of) -> DataFrame:
    """7 points ending on as_of, labelled 'Mon'..'Sun'."""
    return balance_period(tx, boxes, as_of=as_of, days=WEEK_DAYS, label=weekday_label(F.col("day")))


def balance_month(tx: DataFrame, boxes: DataFrame, *, as_of) -> DataFrame:
    """30 points ending on as_of, labelled by day of month."""
    return balance_period(tx, boxes, as_of=as_of, days=MONTH_DAYS, label=month_day_label(F.col("day")))


def balance_all(tx: DataFrame, boxes: DataFrame, *, as_of) -> DataFrame:
    """One point per distinct active day (future days too), running Σ from 0.

    The last point becomes the stored balance only when it falls on as_of.  A
    box without rows gets nothing when its balance is 0, else two points on
    as_of: ('Start', 0) and ('Now', current).
    """
    as_of = _as_date(as_of)
    daily = daily_net(tx)
    box_rows = boxes.select(
        F.col("id").alias("box_id"), F.lit(None).cast("date").alias("day"),
        F.col("current_amount").alias("current"), F.lit(None).cast("decimal(22,2)").alias("net"),
    )
    day_rows = daily.select("box_id", "day", F.lit(None).cast("decimal(12,2)").alias("current"), "net")
    whole, upto = _ordered()
    rows = box_rows.unionByName(day_rows).select(
        "box_id", "day",
        F.max("current").over(whole).alias("cur"),
        F.count("current").over(whole).alias("has_box"),
        F.count("day").over(whole).alias("n_days"),
        F.max("day").over(whole).alias("last_day"),
        F.sum("net").over(upto).alias("run"),
        (F.count("day").over(upto) - 1).alias("point"),
    ).where(F.col("has_box") > 0)

    # Active days give one point each, an idle box with a balance gives the
    # (Start, Now) pair: one Generate over the single window pass.
    last_is_today = (F.col("day") == F.col("last_day")) & (F.col("day") == F.lit(as_of))
    def point(p, d, label, bal):
        return F.struct(p.cast("bigint").alias("point"), d.alias("day"), label.alias("label"),
                        money_out(bal).alias("balance"))
    one = F.array(point(F.col("point"), F.col("day"), day_month_label(F.col("day")),
                        F.when(last_is_today, F.col("cur")).otherwise(F.col("run"))))
    pair = F.array(point(F.lit(0), F.lit(as_of), F.lit("Start"), F.lit(0)),
                   point(F.lit(1), F.lit(as_of), F.lit("Now"), F.col("cur")))
    idle = F.col("day").isNull() & (F.col("n_days") == 0) & (F.col("cur") != 0)
    return rows.where(F.col("day").isNotNull() | idle).select(
        "box_id", F.inline(F.when(F.col("day").isNotNull(), one).otherwise(pair)))


def chart_scale(series: DataFrame, boxes: DataFrame) -> DataFrame:
    """Chart ceiling per box, in DOUBLE as the chart computes it.

    With a stored target > 0: max(target, max balance); otherwise
    ceil(max(max balance, 1) * 1.1).  The template total is not consulted.
    A box with no points has max balance 0.
    """
    peak = series.groupBy("box_id").agg(F.max(to_double("balance")).alias("peak"))
    return boxes.join(peak, boxes.id == peak.box_id, "left").select(
        F.col("id").alias("box_id"), _ceiling(F.col("peak")).alias("ceiling")
    )


def _ceiling(peak: Column) -> Column:
    target = to_double("target_amount")
    data_max = F.greatest(F.coalesce(peak, F.lit(0.0)), F.lit(0.0))
    return F.when(target > 0, F.greatest(target, data_max)).otherwise(
        F.ceil(F.greatest(data_max, F.lit(1.0)) * F.lit(1.1)).cast("double")
    )


def week_scale(tx: DataFrame, boxes: DataFrame, *, as_of) -> DataFrame:
    """O22 of the week chart: the ceiling from one row per box, no point series."""
    as_of = _as_date(as_of)
    first = as_of - dt.timedelta(days=WEEK_DAYS - 1)
    return period_boxes(tx, boxes, first, as_of).withColumn("peak", period_peak(first, as_of)).select(
        "box_id", _ceiling(F.col("peak")).alias("ceiling"))


def week_normalised(tx: DataFrame, boxes: DataFrame, *, as_of) -> DataFrame:
    """O31 of the week chart: peak and ceiling come along with each box's row,
    so the points are generated once and never joined or windowed."""
    as_of = _as_date(as_of)
    first = as_of - dt.timedelta(days=WEEK_DAYS - 1)
    pts = period_boxes(tx, boxes, first, as_of).withColumn("peak", period_peak(first, as_of)).select(
        "box_id", "cur", "entries", "opening", "peak", _ceiling(F.col("peak")).alias("ceiling"),
        F.explode(F.sequence(F.lit(first), F.lit(as_of))).alias("day"))
    b = to_double(point_balance(F.col("day"), as_of))
    return pts.select(
        "box_id", F.datediff(F.col("day"), F.lit(first)).cast("bigint").alias("point"),
        (b / F.col("ceiling")).alias("norm"),
        F.greatest(F.lit(2.0), b / F.greatest(F.col("peak"), F.lit(1.0)) * F.lit(20.0)).alias("bar_height"),
    )


def axis_labels(series: DataFrame, n: int) -> DataFrame:
    """Thin labels to about ``n``: keep every ceil(len/n)-th, blank the rest."""
    w = Window.partitionBy("box_id")
    length = F.count(F.lit(1)).over(w)
    step = F.ceil(length / F.lit(n))
    keep = (length <= n) | (F.col("point") % step == 0)
    return series.select(
        "box_id", "point", "label",
        F.when(keep, F.col("label")).otherwise(F.lit("")).alias("axis_label"),
    )


def series_normalised(series: DataFrame, scale: DataFrame) -> DataFrame:
    """Point / ceiling (0..1 on the chart) and the 7-day mini-bar height
    max(2, b / max(peak, 1) * 20)."""
    w = Window.partitionBy("box_id")
    b = to_double("balance")
    peak = F.greatest(F.max(b).over(w), F.lit(1.0))
    joined = series.join(scale, "box_id", "left")
    return joined.select(
        "box_id", "point",
        (b / F.col("ceiling")).alias("norm"),
        F.greatest(F.lit(2.0), b / peak * F.lit(20.0)).alias("bar_height"),
    )
