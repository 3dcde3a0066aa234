"""Streams of what devices and sign-ups send: queue drain with retries (O36), provisioning."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jarledger.operators.queue import device_rows, ranged, rounds
from jarledger.sources import derived
from jarledger.sources.manifest import Manifest
from jarledger.sources.signup import profile_provision
from jarledger.streaming.keyed_inserts import KeyedInserts
from jarledger.streaming.ledger_streams import FILES_PER_TRIGGER, _dirs, file_stream, run_updates, sent_twice, stream_conf
from jarledger.streaming.update_log import UpdateLog

POSTED = "op_id BIGINT, device STRING, posted_round BIGINT, posted_at BIGINT"
ROWS = "device STRING, ts BIGINT, kind INT, id BIGINT, fails BIGINT"
DEVICES = "device STRING, k BIGINT, f BIGINT, gap BIGINT"
ITEMS = "op_id BIGINT, device STRING, round BIGINT, posted_round BIGINT, posted_at BIGINT"


def stream_queue_drain(items: DataFrame, fetches: DataFrame) -> DataFrame:
    """Items and fetches as ``QueueLanding`` drains them, a row that is sent twice once.  A failed head is tried again
    at the next fetch and holds up the rest until then.  Rows count in the order in which a device's batches bring them."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    queue = F.coalesce(F.concat(F.lit("="), F.col("device")), F.lit(""))    # rows without a device have a queue of their own
    rows = device_rows(items.withColumns({"ts": at, "device": queue}), fetches.withColumns({"ts": at, "device": queue}))
    return rows.dropDuplicates(["kind", "id"])


class QueueLanding:
    """Drains O36's batches: what a batch's fetches post goes to the update log.

    The fetch that posts an item is known when the item comes, as a number
    (``operators.queue.rounds``).  Held between batches are a row for each device
    and the items whose fetch has not come, as tables under ``root``; no task
    gets a device's whole queue.  A batch's rows are written before they are
    dealt out, so that the stream runs once.  The log's commit comes before
    that of what is held: a batch that runs again in between starts from the
    same tables and finds its rows in the log.
    """

    def __init__(self, spark: SparkSession, root: str, log: UpdateLog):
        self.spark, self.root, self.log, self.manifest = spark, root.rstrip("/"), log, Manifest(spark, root)

    def read(self, path: str | None, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(path) if path else self.spark.createDataFrame([], schema)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        version, held = self.manifest.latest() or (0, {"batch": -1, "path": None})
        if batch_id <= held["batch"]:
            return
        path, last = f"{self.root}/{uuid.uuid4().hex}", held["path"]
        batch.write.parquet(f"{path}_rows/sent")
        ranged(self.read(f"{path}_rows/sent", ROWS)).write.parquet(f"{path}_rows/ranged")
        items, fetches, ends = rounds(self.read(f"{path}_rows/ranged", f"{ROWS}, chunk INT"), self.read(last and f"{last}/devices", DEVICES))
        waiting = self.read(last and f"{last}/items", ITEMS).where("posted_round IS NULL").select("op_id", "device", "round")
        fetches = fetches.select("device", F.col("posted_round").alias("round"), "posted_round", "posted_at")
        items.select("op_id", "device", "round").unionByName(waiting).join(fetches, ["device", "round"], "left").write.parquet(f"{path}/items")
        ends.write.parquet(f"{path}/devices")
        device = F.when(F.col("device") != "", F.expr("substring(device, 2)"))
        posted = self.read(f"{path}/items", ITEMS).where("posted_round IS NOT NULL")
        self.log.append(posted.select("op_id", device.alias("device"), "posted_round", "posted_at"), batch_id)
        if not self.manifest.commit(version + 1, {"batch": batch_id, "path": path}):
            raise RuntimeError(f"another writer is at {self.root}")
        for gone in (f"{path}_rows", last):
            if gone:
                self.manifest.drop(gone)
        self.manifest.forget()


def run_stream_queue_drain(spark: SparkSession, folder: str, out: str | None = None, checkpoint: str | None = None,
                           glob: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    stream_conf(spark)
    out, ckpt = _dirs(spark, "queue_drain", out, checkpoint)
    src = sent_twice(file_stream(spark, folder, "events", files_per_trigger, glob))
    log = UpdateLog(spark, out, ["op_id"], T.StructType.fromDDL(POSTED))
    run_updates(stream_queue_drain(derived.queue_items(src), derived.device_fetches(src)), QueueLanding(spark, f"{out}_held", log), ckpt)
    return log.latest().withColumn("posted_at", F.timestamp_micros("posted_at").cast("timestamp_ntz"))


def run_stream_provision(spark: SparkSession, folder: str, out: str | None = None, checkpoint: str | None = None,
                         glob: str | None = None, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """Sign-ups become profiles, each id once: the id is a key, so one sent again is left alone."""
    stream_conf(spark)
    out, ckpt = _dirs(spark, "provision", out, checkpoint)
    profiles = profile_provision(derived.signups_of(sent_twice(file_stream(spark, folder, "customer", files_per_trigger, glob))))
    table = KeyedInserts(spark, out, "id", profiles.schema, ["email", "full_name"])
    q = (profiles.writeStream.foreachBatch(table.insert).option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination()
    return table.rows()
