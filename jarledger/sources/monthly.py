"""Transactions stored by month, their rows dealt to files by box within it.

``month`` is the first day of a row's UTC month.  A query of a period reads its
months only: :func:`since` gives the partitions that a first day needs, and a
join on ``month`` with a filtered table of months is pruned while it runs.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, DateType

from jarledger.functions.money import money_out

FILES = 8       # files of a month at most


def month_of(day) -> F.Column:
    return F.trunc(F.to_date(day), "MM")


def store_by_month(tx: DataFrame, root: str, files: int = FILES) -> DataFrame:
    """Write ``tx`` and read it back; a new batch of months can be appended in the same way."""
    dealt = tx.withColumn("month", month_of(F.col("date"))).repartition("month", F.pmod(F.xxhash64("box_id"), F.lit(files)))
    dealt.sortWithinPartitions("month", "box_id", "date").write.mode("append").partitionBy("month").parquet(root)
    return read_months(tx.sparkSession, root, tx.schema)


def read_months(spark: SparkSession, root: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField("month", DateType())])).parquet(root)


def since(stored: DataFrame, first: dt.date) -> DataFrame:
    """The rows from a first day on (later months too), without the month column."""
    return stored.where(F.col("month") >= F.lit(first.replace(day=1))).where(F.to_date("date") >= F.lit(first)).drop("month")


def net_of_months(stored: DataFrame, months: DataFrame) -> DataFrame:
    """``months(month)``: Σ amount per month and box; only the months' partitions are read."""
    net = stored.join(months.select("month").distinct(), "month").groupBy("month", "box_id").agg(money_out(F.sum("amount")).alias("net"))
    return net.select("month", "box_id", "net")
