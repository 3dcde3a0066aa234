"""O42 activity_feed: readable feed rows for transactions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jarledger.functions.dates import time_text_en, time_text_named
from jarledger.functions.display import (ENTRY_LABELS, currency_symbol, entry_label,
                                         label_dictionary, sign_char)


def activity_feed(tx: DataFrame, boxes: DataFrame, profiles: DataFrame, *, as_of: dt.date,
                  default_language: str = "en") -> DataFrame:
    """One display row per transaction: label (the note, or Deposit /
    Withdrawal in the owner's language when the note is empty), sign, absolute
    amount with two decimals, the box currency's symbol, whether it is
    dated as_of, and the time text in the owner's language ('Today, 03:07 PM' /
    'Jan 5, 03:07 PM'; 'Heute, 15:07' / '5. Jan., 15:07'); an unknown language
    reads as ``default_language``."""
    spark: SparkSession = tx.sparkSession
    b = boxes.select(F.col("id").alias("box_id"), "user_id", "currency")
    p = profiles.select(F.col("id").alias("user_id"), "language")
    # The label dictionary is a fixed three-row table: broadcast is bounded.
    d = F.broadcast(label_dictionary(spark))
    known = F.col("language").isin(*ENTRY_LABELS)
    p = p.withColumn("language", F.when(known, F.col("language")).otherwise(F.lit(default_language)))
    j = (tx.join(b, "box_id", "inner").join(p, "user_id", "left")
         .withColumn("language", F.coalesce("language", F.lit(default_language))).join(d, "language", "left"))
    deposit, withdrawal, months = F.col("deposit"), F.col("withdrawal"), F.col("months")
    today = F.to_date("date") == F.lit(as_of)
    keep = [c for c in ("rank",) if c in tx.columns]
    return j.select(
        "box_id", "id", *keep,
        entry_label(F.col("note"), F.col("amount"), deposit, withdrawal).alias("label"),
        sign_char(F.col("amount")).alias("sign"),
        F.abs(F.col("amount")).cast("decimal(12,2)").cast("string").alias("amount_text"),
        currency_symbol(F.col("currency")).alias("symbol"),
        today.alias("is_today"),
        F.when(months.isNull(), time_text_en(F.col("date"), today, F.col("today")))
        .otherwise(time_text_named(F.col("date"), today, F.col("today"), F.col("day_mark"), months)).alias("time_text"),
    )
