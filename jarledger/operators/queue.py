"""Device queues drained at each fetch, failed heads tried again.

Opening the app drains its device's queue first: items are posted from the
head on until one fails; that item and the rest stay, and are tried again at
the next fetch.  ``items(op_id, ts, device, fails, ...)`` fail at their first
``fails`` attempts, ``fetches(fetch_id, ts, device)`` are the app's openings; a
fetch sees the items up to its time.

With A the first fetch that sees an item, the item is first tried at the later
of A and the fetch that posted its predecessor, and each failure costs one
more fetch: F = max(A, F before) + fails.  That is a running maximum,
F = S + max(A - S before) over the items so far with S the sum of fails, so
queues of any length are scanned in range partitions, and the partitions' sums
and maxima composed; no device is gathered into one task.  Later rows change no
item's F, so what they need of those before is a sum or maximum for each device.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jarledger.session import shared_dir

ORDER = ("ts", "kind", "id")    # an item of a fetch's own time is seen by it


def device_rows(items: DataFrame, fetches: DataFrame) -> DataFrame:
    """Items (kind 0) and fetches (kind 1) as rows of one kind."""
    return (items.select("device", "ts", F.lit(0).alias("kind"), F.col("op_id").alias("id"), F.coalesce(F.col("fails"), F.lit(0)).cast("bigint").alias("fails"))
            .unionByName(fetches.select("device", "ts", F.lit(1).alias("kind"), F.col("fetch_id").alias("id"), F.lit(0).cast("bigint").alias("fails"))))


def ranged(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in range partitions of (device, order); to be written once, so that all passes see the same ones."""
    keys = ["device", *ORDER]
    dealt = rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    return dealt.sortWithinPartitions(*keys).withColumn("chunk", F.spark_partition_id())


def _before(pieces: DataFrame, column, how) -> F.Column:
    """An aggregate over a device's earlier range partitions (a row for each)."""
    return how(column).over(Window.partitionBy("device").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))


def rounds(rows: DataFrame, opening: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(op_id, device, fails, round)`` of every item, ``(device, posted_round, posted_at)`` of every fetch, and
    ``(device, k, f, gap)``: a device's fetches, failures and largest A - S.  The latter of the rows so far are the
    ``opening`` of those that come later: a piece before all others.  ``rows`` are ``ranged``."""
    here = Window.partitionBy("device", "chunk").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = rows.withColumns({"seen": F.sum("kind").over(here), "s": F.sum("fails").over(here)})
    pieces = rows.groupBy("device", "chunk").agg(F.sum("kind").alias("k"), F.sum("fails").alias("f"))
    if opening is not None:
        pieces = pieces.unionByName(opening.select("device", F.lit(-1).alias("chunk"), "k", "f"))
    offsets = pieces.select("device", "chunk", F.coalesce(_before(pieces, "k", F.sum), F.lit(0)).alias("k0"),
                            F.coalesce(_before(pieces, "f", F.sum), F.lit(0)).alias("s0"))
    placed = counted.join(offsets, ["device", "chunk"]).withColumns({"seen": F.col("seen") + F.col("k0"), "s": F.col("s") + F.col("s0")})

    opened = placed.where("kind = 1").select("device", F.col("seen").alias("posted_round"), F.col("ts").alias("posted_at"))
    queued = placed.where("kind = 0").withColumn("gap", F.lit(1) + F.col("seen") - F.col("s") + F.col("fails"))
    tops = queued.groupBy("device", "chunk").agg(F.max("gap").alias("gap"))
    if opening is not None:
        tops = tops.unionByName(opening.select("device", F.lit(-1).alias("chunk"), "gap"))
    ends = pieces.join(tops, ["device", "chunk"], "left").groupBy("device").agg(F.sum("k").alias("k"), F.sum("f").alias("f"), F.max("gap").alias("gap"))
    tops = tops.select("device", "chunk", _before(tops, "gap", F.max).alias("gap0"))
    done = (queued.withColumn("top", F.max("gap").over(here)).join(tops, ["device", "chunk"])
            .select(F.col("id").alias("op_id"), "device", "fails", (F.col("s") + F.greatest("top", "gap0")).alias("round")))
    return done, opened, ends


def drain_rounds(items: DataFrame, fetches: DataFrame, partitions: int | None = None) -> DataFrame:
    """``(op_id, device, fails, posted_round, posted_at)`` for every item: the device's fetch that posts it, 1 for
    the first, and its time; both null while the device has not had so many fetches."""
    shared_dir(items.sparkSession, "queue")     # makes sure a checkpoint folder is set
    done, opened, _ = rounds(ranged(device_rows(items, fetches), partitions).checkpoint(eager=True))
    return (done.join(opened, (done["device"] == opened["device"]) & (done["round"] == opened["posted_round"]), "left")
            .select("op_id", done["device"], "fails", opened["posted_round"], "posted_at"))
