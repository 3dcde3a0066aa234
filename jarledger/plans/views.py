"""Composite views: the app's screens and flows as single Spark plans.

* ``home_cards`` (open the home screen): for every active box, the card --
  balance, goal progress, home-currency equivalent, the 7-day mini chart's
  peak and the recent-activity summary.  The app does this with two round
  trips and a per-box loop; here it is one DAG whose per-box pieces all key
  on the box id (co-located when the tables are bucketed on it).
* ``drain_and_fold`` (come back online): each device drains its queue in
  order until the first item the server refuses -- flagged failed, or with
  an amount the ``amount != 0`` check rejects -- and the posted items,
  signed, are folded into per-box balances (no balance guard: the drain does
  not re-check it).
* ``open_home`` (open the app): both as one flow.  Every fetch drains its
  device's queue first, failed heads are tried again at the next; what was
  posted by the last fetch moves balances and joins the transactions, and the
  cards are made from these, with what still waits beside them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jarledger.functions.dates import day_key
from jarledger.functions.display import currency_symbol
from jarledger.functions.money import money_out, signed_amount
from jarledger.operators import aggregates as agg
from jarledger.operators import filters, history, joins, series
from jarledger.operators.queue import drain_rounds
from jarledger.operators.replay import drain_until_failure


def home_cards(boxes: DataFrame, templates: DataFrame, tx: DataFrame, profiles: DataFrame,
               rates: DataFrame, *, as_of: dt.date) -> DataFrame:
    first = as_of - dt.timedelta(days=series.WEEK_DAYS - 1)
    # Transactions are read once: box-days first, then one row per box with
    # what the mini chart and the recent-activity summary need.
    days = tx.groupBy("box_id", day_key("date").alias("day")).agg(
        F.sum("amount").alias("net"), F.count(F.lit(1)).alias("n"), F.max("date").alias("last"))
    per_box = days.groupBy(F.col("box_id").alias("id")).agg(
        *series.period_aggregates(first, as_of), F.sum("n").alias("n_tx"), F.max("last").alias("last_activity"))
    cards = joins.with_home(agg.with_target(filters.active_boxes(boxes), templates), profiles, rates) \
        .join(per_box, "id", "left") \
        .withColumn("cur", F.col("current_amount")).withColumn("opening", series.opening_balance(F.col("cur")))
    progress, is_full, percent = agg.progress_columns()
    n_recent = F.least(F.coalesce(F.col("n_tx"), F.lit(0)), F.lit(history.RECENT_ACTIVE)).cast("bigint")
    return cards.select(
        F.col("id").alias("box_id"), "name", currency_symbol(F.col("currency")).alias("symbol"),
        money_out("current_amount").alias("balance"), "target", progress, percent, is_full, *joins.home_columns(),
        series.period_peak(first, as_of).alias("week_peak"), n_recent.alias("n_recent"), "last_activity")


def drain_and_fold(queue: DataFrame) -> DataFrame:
    """Per box: Σ signed posted items, and how many items were posted / kept."""
    items = queue.where(F.col("op").isin("add", "withdraw"))
    refused = F.col("failed") | F.col("amount").isNull() | (F.col("amount") == 0)
    drained = drain_until_failure(items.withColumn("failed", F.coalesce(refused, F.lit(True))))
    posted = F.col("posted")
    return drained.groupBy("box_id").agg(
        money_out(F.coalesce(F.sum(F.when(posted, signed_amount(F.col("op"), F.col("amount")))), F.lit(0)))
        .alias("posted_sum"),
        F.count(F.when(posted, F.lit(1))).alias("n_posted"),
        F.count(F.when(~posted, F.lit(1))).alias("n_kept"),
    )


def open_home(boxes: DataFrame, templates: DataFrame, tx: DataFrame, profiles: DataFrame, rates: DataFrame,
              items: DataFrame, fetches: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Home cards after the devices' last fetches, with ``n_posted`` and ``n_waiting`` queue items of each box.

    ``items(op_id, ts, device, fails, box_id, op, amount)`` are adds and
    withdrawals; posted ones get the id ``-op_id``.  An amount that the
    ``amount != 0`` check rejects holds up its device for good.
    """
    money_rows = items.where(F.col("op").isin("add", "withdraw"))
    never = F.col("amount").isNull() | (F.col("amount") == 0)
    tried = money_rows.withColumn("fails", F.when(never, F.lit(2 ** 40)).otherwise(F.col("fails")).cast("bigint"))
    rounds = drain_rounds(tried, fetches).select("op_id", F.col("posted_round").isNotNull().alias("posted"))
    drained = rounds.join(money_rows.select("op_id", "box_id", "op", "amount", "ts"), "op_id")
    posted = drained.where("posted").select(
        (-F.col("op_id")).alias("id"), "box_id", signed_amount(F.col("op"), F.col("amount")).cast("decimal(12,2)").alias("amount"),
        F.lit(None).cast("string").alias("note"), F.col("ts").alias("date"))
    per_box = drained.groupBy(F.col("box_id").alias("id")).agg(
        F.coalesce(F.sum(F.when(F.col("posted"), signed_amount(F.col("op"), F.col("amount")))), F.lit(0)).alias("moved"),
        F.count(F.when(F.col("posted"), 1)).alias("n_posted"), F.count(F.when(~F.col("posted"), 1)).alias("n_waiting"))
    moved = boxes.join(per_box.select("id", "moved"), "id", "left")
    now = moved.withColumn("current_amount", (F.col("current_amount") + F.coalesce("moved", F.lit(0))).cast("decimal(12,2)")).select(boxes.columns)
    cards = home_cards(now, templates, tx.unionByName(posted), profiles, rates, as_of=as_of)
    zero = F.lit(0).cast("bigint")
    return cards.join(per_box.select(F.col("id").alias("box_id"), "n_posted", "n_waiting"), "box_id", "left").withColumns(
        {"n_posted": F.coalesce("n_posted", zero), "n_waiting": F.coalesce("n_waiting", zero)})
