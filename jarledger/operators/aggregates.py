"""Aggregations.

Transactions are always reduced to one row per box (partial aggregate
map-side, final after one exchange) *before* they meet the box table, so the
join input is #boxes, not #transactions, and a hot box costs no more than any
other after the map-side combine.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jarledger.functions.display import currency_code
from jarledger.functions.money import money_out, to_double


def per_box(tx: DataFrame) -> DataFrame:
    return tx.groupBy("box_id").agg(
        F.sum("amount").alias("tx_sum"),
        F.count(F.lit(1)).alias("n_tx"),
        F.max("date").alias("last_date"),
    )


def balance_fold(boxes: DataFrame, inserted: DataFrame) -> DataFrame:
    """New balance = stored + Σ inserted amounts; ``updated_at`` becomes the
    last insert time (boxes without inserts keep ``updated_at`` or ``created_at``)."""
    s = per_box(inserted).withColumnRenamed("box_id", "id")
    old_updated = F.col("updated_at") if "updated_at" in boxes.columns else F.col("created_at")
    return boxes.join(s, "id", "left").select(
        "id",
        money_out(F.col("current_amount") + F.coalesce(F.col("tx_sum"), F.lit(0))).alias("current_amount"),
        F.coalesce(F.col("last_date"), old_updated).alias("updated_at"),
        F.coalesce(F.col("n_tx"), F.lit(0)).cast("bigint").alias("n_inserted"),
    )


def goal_progress(boxes: DataFrame, templates: DataFrame) -> DataFrame:
    """target = stored target ?? template total ?? 0 (a stored 0 means no
    goal); progress = min(balance/target, 1) when target > 0 else 0; full when
    balance >= target > 0; percent = round-half-up(min(balance/target*100, 100))."""
    return with_target(boxes, templates).select(F.col("id").alias("box_id"), "target", *progress_columns())


def with_target(boxes: DataFrame, templates: DataFrame) -> DataFrame:
    """Boxes with their ``target``, the stored one or the template's total."""
    t = templates.select(F.col("id").alias("template_id"), F.col("total_amount").alias("template_total"))
    target = money_out(F.coalesce(F.col("target_amount"), F.col("template_total").cast("decimal(12,2)"), F.lit(0)))
    return boxes.join(t, "template_id", "left").select(*boxes.columns, target.alias("target"))


def progress_columns() -> list[Column]:
    tgt = to_double("target")
    bal = to_double("current_amount")
    has = tgt > 0
    ratio = bal / F.when(has, tgt)
    return [
        F.when(has, F.least(ratio, F.lit(1.0))).otherwise(F.lit(0.0)).alias("progress"),
        (has & (F.col("current_amount") >= F.col("target"))).alias("is_full"),
        F.when(has, F.floor(F.least(ratio * 100.0, F.lit(100.0)) + 0.5)).otherwise(F.lit(0)).cast("bigint")
        .alias("percent"),
    ]


def grid_fill(boxes: DataFrame, templates: DataFrame) -> DataFrame:
    """Per box with a template: cells and their sum, distinct valid crossed
    cells and their sum, what is left, and the template's stated total (which
    need not equal the grid sum).  Out-of-range indices add no money."""
    t = templates.select(F.col("id").alias("template_id"), F.col("grid_config").alias("grid"),
                         F.col("total_amount").alias("template_total"))
    j = boxes.where(F.col("template_id").isNotNull()).join(t, "template_id", "inner")
    n = F.size("grid")
    crossed = F.coalesce(F.col("crossed_out_indices"), F.array().cast("array<int>"))
    valid = F.array_distinct(F.filter(crossed, lambda i: (i >= 0) & (i < n)))
    total = lambda arr: F.aggregate(arr, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    j = j.select(
        F.col("id").alias("box_id"), "template_id", "template_total",
        n.cast("bigint").alias("cells"),
        total(F.col("grid")).alias("grid_sum"),
        F.size(valid).cast("bigint").alias("crossed_cells"),
        total(F.transform(valid, lambda i: F.get(F.col("grid"), i))).alias("crossed_sum"),
    )
    return j.select(
        "box_id", "template_id", "cells", "grid_sum", "crossed_cells", "crossed_sum",
        (F.col("grid_sum") - F.col("crossed_sum")).alias("remaining_sum"),
        F.col("template_total").cast("bigint").alias("template_total"),
    )


def _month_rows(tx: DataFrame, as_of: dt.date) -> DataFrame:
    first = as_of.replace(day=1)
    # No upper bound: rows after as_of count too.
    return tx.where(F.to_date("date") >= F.lit(first))


def net_saved_month(tx: DataFrame, boxes: DataFrame, *, as_of: dt.date) -> DataFrame:
    """Per user, Σ amount (net of withdrawals, archived boxes included,
    currencies added unconverted) dated on/after the first of as_of's month."""
    s = _month_rows(tx, as_of).groupBy("box_id").agg(F.sum("amount").alias("s"))
    j = boxes.select("id", "user_id").join(s.withColumnRenamed("box_id", "id"), "id", "left")
    return j.groupBy("user_id").agg(money_out(F.coalesce(F.sum("s"), F.lit(0))).alias("net_saved"))


def net_saved_month_by_currency(tx: DataFrame, boxes: DataFrame, *, as_of: dt.date) -> DataFrame:
    """O23, second form: per (user, box currency)."""
    s = _month_rows(tx, as_of).groupBy("box_id").agg(F.sum("amount").alias("s"))
    j = boxes.select("id", "user_id", currency_code(F.col("currency")).alias("currency")) \
        .join(s.withColumnRenamed("box_id", "id"), "id", "left")
    return j.groupBy("user_id", "currency").agg(money_out(F.coalesce(F.sum("s"), F.lit(0))).alias("net_saved"))


def ledger_reconcile(boxes: DataFrame, tx: DataFrame) -> DataFrame:
    """Stored balance vs Σ transactions per box (full join: boxes without
    rows and rows without a box both appear); drift = stored - Σ, and the
    opening balance the series use, max(0, drift)."""
    s = tx.groupBy("box_id").agg(F.sum("amount").alias("tx_sum"))
    b = boxes.select(F.col("id").alias("box_id"), F.col("current_amount").alias("stored"))
    j = b.join(s, "box_id", "full")
    ts = F.coalesce(F.col("tx_sum"), F.lit(0))
    drift = F.col("stored") - ts
    return j.select(
        "box_id",
        money_out("stored").alias("stored"),
        money_out(ts).alias("tx_sum"),
        money_out(drift).alias("drift"),
        money_out(F.greatest(F.lit(0), drift)).alias("opening"),
    )
