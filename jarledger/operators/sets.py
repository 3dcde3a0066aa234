"""Set-shaped operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jarledger.functions.dates import day_key
from jarledger.operators.replay import drain_until_failure
from jarledger.functions.money import signed_amount


def first_activity(tx: DataFrame) -> DataFrame:
    """First active UTC day per box (where the 'all' series starts)."""
    return tx.groupBy("box_id").agg(F.min(day_key("date")).alias("first_day"))


def active_days(tx: DataFrame) -> DataFrame:
    """Distinct (box, day) pairs."""
    return tx.select("box_id", day_key("date").alias("day")).distinct()


def pending_union(tx: DataFrame, queue: DataFrame) -> DataFrame:
    """Posted transactions plus the items still queued on devices, shown
    as signed transactions with an ``offline_<op_id>`` id (queue items are
    only add / withdraw), newest first.  Posted ids become text so both fit one column."""
    items = queue.where(F.col("op").isin("add", "withdraw"))  # all that a device queue holds, so all that can block it
    left = drain_until_failure(items).where(~F.col("posted"))
    note = F.col("note") if "note" in queue.columns else F.lit(None).cast("string")
    pending = left.select(
        F.concat(F.lit("offline_"), F.col("op_id").cast("string")).alias("id"),
        "box_id",
        signed_amount(F.col("op"), F.col("amount")).alias("amount"),
        note.alias("note"),
        F.col("ts").alias("date"),
        F.lit(True).alias("pending"),
    )
    posted = tx.select(
        F.col("id").cast("string").alias("id"), "box_id", "amount", "note", "date",
        F.lit(False).alias("pending"),
    )
    return posted.unionByName(pending).orderBy(F.col("date").desc(), F.col("id").desc())
