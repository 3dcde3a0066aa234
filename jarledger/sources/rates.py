"""O02 rates_load: two landed rate feeds -> long table (base, quote, rate).

Feeds:
  * UAH feed ``(pos, cc, rate)``: UAH per one unit of ``cc``.  Items need a
    non-empty code and a numeric rate > 0; a repeated code keeps the item at
    the greatest feed position (last wins).
  * cross feed ``(base, quote, rate)``: quote units per one base unit for the
    three cross bases.

Result per base:
  * base UAH: ``1/x`` for EUR, USD and GBP plus UAH = 1 -- all three foreign
    rates must be present, otherwise the base has no rates at all;
  * base EUR / USD / GBP: the cross rows, the base itself = 1, and UAH = the
    UAH-feed rate of the base when present (it overrides a cross UAH row).

The result has at most 4 bases x (the cross feed's distinct quote codes + 2)
rows; operators that join it count it and broadcast it under a bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Currencies the app supports, and the cross-feed bases.
SUPPORTED_CURRENCIES = ["EUR", "USD", "UAH", "GBP"]
CROSS_BASES = ["EUR", "USD", "GBP"]


def clean_uah_feed(uah_feed: DataFrame) -> DataFrame:
    cc, rate = F.col("cc"), F.col("rate")
    return (
        uah_feed.where(cc.isNotNull() & (cc != "") & rate.isNotNull() & (rate > 0))
        .groupBy("cc")
        .agg(F.max_by("rate", "pos").alias("rate"))
    )


def rates_load(uah_feed: DataFrame, cross_feed: DataFrame) -> DataFrame:
    spark = uah_feed.sparkSession
    uah = clean_uah_feed(uah_feed)

    # Base UAH: all-or-nothing over the three foreign codes.  One bounded
    # aggregate (at most three entries) decides and emits the base's rows.
    foreign = uah.where(F.col("cc").isin(*CROSS_BASES)).select(
        F.lit("UAH").alias("base"), F.struct(F.col("cc").alias("quote"), (F.lit(1.0) / F.col("rate")).alias("rate"))
        .alias("r"))
    self_uah = F.array(F.struct(F.lit("UAH").alias("quote"), F.lit(1.0).alias("rate")))
    uah_base = (
        foreign.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.collect_list("r").alias("rows"))
        .where(F.col("n") == len(CROSS_BASES))
        .select("base", F.inline(F.concat(F.col("rows"), self_uah)))
    )

    # Cross bases: self = 1 beats the UAH-feed rate, which beats the cross feed.
    bases = spark.createDataFrame([(b,) for b in CROSS_BASES], "base STRING")
    self_rows = bases.select("base", F.col("base").alias("quote"), F.lit(1.0).alias("rate"), F.lit(0).alias("prio"))
    uah_rows = uah.join(bases, uah.cc == bases.base, "inner").select(
        "base", F.lit("UAH").alias("quote"), "rate", F.lit(1).alias("prio")
    )
    cross_rows = cross_feed.join(bases, "base", "left_semi").select(
        "base", "quote", F.col("rate").cast("double").alias("rate"), F.lit(2).alias("prio")
    )
    cross_base = (
        self_rows.unionByName(uah_rows).unionByName(cross_rows)
        .groupBy("base", "quote")
        .agg(F.min_by("rate", "prio").alias("rate"))
    )
    return uah_base.unionByName(cross_base)
