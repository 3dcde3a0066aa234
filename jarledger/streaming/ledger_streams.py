"""Streaming operators.

* O43 ``stream_balance_fold``: running balance per box as transactions
  arrive -- the insert trigger as a stateful streaming aggregate, emitted in
  update mode (only changed boxes per batch).
* O44 ``stream_ordered_replay``: the guarded replay (O37) with state per box:
  the ops at the end of its log, and balances at a few earlier places.
* O45 ``stream_daily_net``: daily net per box, open days included; a late row
  adds its day, corrected, to the output.

Device rows arrive late, out of order and more than once, and the ledger drops
none of them and counts each once.  So there is no watermark: the ids that were
applied are a state-store set, dealt out by id, and each of the three streams
passes through it.  A sum doesn't mind the order, so O43 and O45 read nothing
but their batch.  O44 does; see ``ReplayState``.

Sources are file streams; checkpoints and outputs go under the cluster's
shared folder (``spark.checkpoint.dir``), so a restarted query resumes
exactly where it stopped.  Outputs are update logs (``update_log``): a batch
is one commit, and one that runs again after a restart changes nothing.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jarledger.functions.dates import day_key
from jarledger.functions.money import money_out
from jarledger.operators.replay import _apply, ordered_replay
from jarledger.session import ensure_conf, shared_dir
from jarledger.streaming.update_log import UpdateLog

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FILES_PER_TRIGGER = 64      # files that share a micro-batch
TAIL = 64                   # ops at the end of a box's log that its state holds (up to twice as many)
SNAPSHOTS = 24              # earlier balances it holds
BUCKETS = 16                # folders that a batch's landed ops are dealt to, by box


def stream_conf(spark: SparkSession) -> None:
    """State lives in RocksDB (off-heap, spills to local disk, checkpointed to
    the shared folder) instead of the JVM heap."""
    ensure_conf(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, folder: str, table: str = "events", files_per_trigger: int = FILES_PER_TRIGGER,
                glob: str | None = None) -> DataFrame:
    """A parquet file stream over ``folder``.  The driver folder holds all
    tables as ``<table>.parquet``, so by default a glob picks the table's
    file; a landing folder of many files takes ``glob='*.parquet'``.  The
    schema is declared from the table (no inference on a stream)."""
    folder = folder.rstrip("/")
    glob = glob or f"{table}.parquet"
    schema = spark.read.option("pathGlobFilter", glob).parquet(folder).schema
    return (spark.readStream.schema(schema)
            .option("pathGlobFilter", glob)
            .option("maxFilesPerTrigger", files_per_trigger)
            .parquet(folder))


def sent_twice(rows: DataFrame) -> DataFrame:
    """Every row twice, as a device sends it that had no answer the first time."""
    return rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("attempt")).drop("attempt")


def run_updates(updates: DataFrame, write: Callable[[DataFrame, int], object], checkpoint: str) -> None:
    q = (updates.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ O43

def stream_balance_fold(tx_stream: DataFrame) -> DataFrame:
    """Per box Σ amount, last insert time and row count of distinct transactions.  Run in update
    mode: each micro-batch emits only the boxes it changed."""
    once = tx_stream.select("id", "box_id", "amount", "date").dropDuplicates(["id"])
    return once.groupBy("box_id").agg(
        money_out(F.sum("amount")).alias("balance"),
        F.max("date").alias("updated_at"),
        F.count(F.lit(1)).alias("n_tx"),
    )


# ------------------------------------------------------------------ O44

class ReplayState:
    """What a box's state holds: balances at some places of its log, and the ops behind the last of them.

    ``snaps`` are ``[ts, op_id, balance, ops, applied]`` in order of the log,
    the first before any op; they thin out towards the past.  ``tail`` are the
    ops behind the last one, ``[ts, op_id, op, cents or None]``.  An op that
    belongs into the tail is put there, so rows a little out of order cost
    nothing.  One that belongs before the last snapshot makes the box *late*:
    its snapshots from there on are dropped, and its answers are computed from
    the ops that landed behind the last good one.
    """

    FIRST = [-(2 ** 63), -(2 ** 63), 0, 0, 0]

    def __init__(self, text: str | None = None):
        held = json.loads(text) if text else {}
        self.snaps, self.tail, self.late = held.get("snaps", [self.FIRST]), held.get("tail", []), held.get("late", False)

    def pack(self) -> str:
        return json.dumps({"snaps": self.snaps, "tail": self.tail, "late": self.late})

    @staticmethod
    def fold(snap: list, ops: list) -> list:
        _, _, balance, n, applied = snap
        for _, _, op, cents in ops:
            balance, ok = _apply(op, cents, balance)
            n, applied = n + 1, applied + ok
        return [*ops[-1][:2], balance, n, applied] if ops else snap

    def add(self, ops: list) -> None:
        """Ops of a batch, in any order."""
        ops = sorted(ops, key=lambda r: (r[0], r[1]))
        if not ops:
            return
        first = ops[0][:2]
        if first < self.snaps[-1][:2]:
            self.snaps, self.tail, self.late = [s for s in self.snaps if s[:2] < first], [], True
        if self.late:
            return
        self.tail = sorted(self.tail + ops, key=lambda r: (r[0], r[1]))
        while len(self.tail) >= 2 * TAIL:
            self.snaps.append(self.fold(self.snaps[-1], self.tail[:TAIL]))
            self.tail = self.tail[TAIL:]
        if len(self.snaps) > SNAPSHOTS:
            half = SNAPSHOTS // 2
            self.snaps = [self.snaps[0], *self.snaps[1:-half:2], *self.snaps[-half:]]

    def answer(self) -> list:
        """The state's balance behind all ops; of a late box, the last good snapshot."""
        return self.snaps[-1] if self.late else self.fold(self.snaps[-1], self.tail)


REPLAY_OUT = ("kind STRING, box_id BIGINT, tkey BIGINT, op_id BIGINT, op STRING, cents BIGINT, has_amount BOOLEAN, "
              "late BOOLEAN, balance BIGINT, n BIGINT, applied BIGINT")
REPLAY_COLS = [c.split()[0] for c in REPLAY_OUT.split(", ")]


def _replay_box(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The batch's ops of a box as they come ('op' rows, to land), then its answer ('box' row)."""
    held, ops = ReplayState(state.get[0] if state.exists else None), []
    for f in frames:
        ops += [[t, o, op, c if has else None] for t, o, op, c, has in
                zip(f["tkey"].tolist(), f["op_id"].tolist(), f["op"].tolist(), f["cents"].tolist(), f["has_amount"].tolist())]
        yield f.assign(kind="op", late=False, balance=0, n=0, applied=0)[REPLAY_COLS]
    held.add(ops)
    state.update((held.pack(),))
    tkey, op_id, balance, n, applied = held.answer()
    yield pd.DataFrame([("box", key[0], tkey, op_id, "", 0, False, held.late, balance, n, applied)], columns=REPLAY_COLS)


def stream_ordered_replay(ops: DataFrame) -> DataFrame:
    """Each op once, replayed by box state; rows to land and answers (see ``ReplayLanding``)."""
    cents = (F.col("amount").cast("decimal(14,2)") * 100).cast("bigint")
    rows = ops.select("op_id", "box_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("tkey"), "op",
                      F.coalesce(cents, F.lit(0)).alias("cents"), F.col("amount").isNotNull().alias("has_amount"))
    return (rows.dropDuplicates(["op_id"]).groupBy("box_id")
            .applyInPandasWithState(_replay_box, REPLAY_OUT, "held STRING", "update", "NoTimeout"))


REPLAY_ANSWER = "box_id BIGINT, final_balance DECIMAL(20,2), n_ops BIGINT, n_applied BIGINT, n_rejected BIGINT"


class ReplayLanding:
    """Writes O44's batches: ops land by box bucket, answers go to the update log.

    Landed ops are read only if a box of the batch is late, and of them only
    its bucket, behind its last good snapshot.
    """

    def __init__(self, landed: str, log: UpdateLog):
        self.landed, self.log, self.reads = landed, log, 0

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{self.landed}/batch_id={batch_id}"
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64("box_id"), F.lit(BUCKETS)).cast("int"))
        bucketed.repartition("kind", "bucket").write.partitionBy("kind", "bucket").mode("overwrite").parquet(path)
        schema = bucketed.schema
        boxes = spark.read.schema(schema).parquet(path).where("kind = 'box'")
        late = boxes.where("late")
        done = self.answers(boxes.where("not late"))
        buckets = [r[0] for r in late.select("bucket").distinct().collect()]    # BUCKETS at most
        if buckets:
            done = done.unionByName(self.again(late, buckets, batch_id, schema))
        self.log.append(done, batch_id)

    @staticmethod
    def answers(boxes: DataFrame) -> DataFrame:
        return boxes.select("box_id", money_out(F.col("balance").cast("decimal(18,0)") / 100).alias("final_balance"), F.col("n").alias("n_ops"),
                            F.col("applied").alias("n_applied"), (F.col("n") - F.col("applied")).alias("n_rejected"))

    def again(self, late: DataFrame, buckets: list[int], batch_id: int, schema) -> DataFrame:
        """Answers of late boxes: the ops behind their last good snapshot, replayed from its balance."""
        self.reads += 1
        base = late.select("box_id", F.col("tkey").alias("base_t"), F.col("op_id").alias("base_o"), "balance", "n", "applied")
        log = (late.sparkSession.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).option("basePath", self.landed).parquet(self.landed)
               .where(F.col("kind") == "op").where(F.col("bucket").isin(buckets)).where(F.col("batch_id") <= batch_id))
        ops = log.select("box_id", "tkey", "op_id", "op", "cents", "has_amount").join(base.select("box_id", "base_t", "base_o"), "box_id")
        ops = ops.where(F.struct("tkey", "op_id") > F.struct("base_t", "base_o"))
        ops = ops.select("box_id", "op_id", F.timestamp_micros("tkey").alias("ts"), "op",
                         F.when(F.col("has_amount"), F.col("cents").cast("decimal(18,0)") / 100).alias("amount"))
        opening = base.select("box_id", (F.col("balance").cast("decimal(18,0)") / 100).alias("balance"))
        found = ordered_replay(ops, opening).join(base.select("box_id", "n", "applied"), "box_id")
        n, ok = F.col("n_ops") + F.col("n"), F.col("n_applied") + F.col("applied")
        return found.select("box_id", "final_balance", n.alias("n_ops"), ok.alias("n_applied"), (n - ok).alias("n_rejected"))


# ------------------------------------------------------------------ O45

def stream_daily_net(tx: DataFrame) -> DataFrame:
    """Σ amount per box and UTC day of distinct transactions, in update mode."""
    once = tx.select("id", "box_id", "amount", day_key("date").alias("day")).dropDuplicates(["id"])
    return once.groupBy("box_id", "day").agg(money_out(F.sum("amount")).alias("net"))


# ------------------------------------------------------------------ runners
#
# Each runner takes the events folder and, optionally, fixed output and
# checkpoint folders: running again with the same ones resumes the query
# from its checkpoint and processes only files it has not seen.


def _dirs(spark: SparkSession, name: str, out: str | None, checkpoint: str | None) -> tuple[str, str]:
    if out and checkpoint:
        return out, checkpoint
    base = shared_dir(spark, "streams", name)
    return out or f"{base}/out", checkpoint or f"{base}/checkpoint"


def run_stream_balance_fold(spark: SparkSession, folder: str, out: str | None = None,
                            checkpoint: str | None = None, glob: str | None = None,
                            files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    from jarledger.sources.bind import transactions_from_events
    stream_conf(spark)
    out, ckpt = _dirs(spark, "balance_fold", out, checkpoint)
    src = sent_twice(file_stream(spark, folder, "events", files_per_trigger, glob))
    updates = stream_balance_fold(transactions_from_events(src))
    log = UpdateLog(spark, out, ["box_id"], updates.schema)
    run_updates(updates, log.append, ckpt)
    return log.latest()


def run_stream_ordered_replay(spark: SparkSession, folder: str, out: str | None = None,
                              checkpoint: str | None = None, glob: str | None = None,
                              files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    from jarledger.sources.bind import op_log_from_events
    stream_conf(spark)
    out, ckpt = _dirs(spark, "ordered_replay", out, checkpoint)
    src = sent_twice(file_stream(spark, folder, "events", files_per_trigger, glob))
    log = UpdateLog(spark, out, ["box_id"], T.StructType.fromDDL(REPLAY_ANSWER))
    run_updates(stream_ordered_replay(op_log_from_events(src)), ReplayLanding(f"{out}_landed", log), ckpt)
    return log.latest()


def run_stream_daily_net(spark: SparkSession, folder: str, out: str | None = None,
                         checkpoint: str | None = None, glob: str | None = None,
                         files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    from jarledger.sources.bind import transactions_from_events
    stream_conf(spark)
    out, ckpt = _dirs(spark, "daily_net", out, checkpoint)
    src = sent_twice(file_stream(spark, folder, "events", files_per_trigger, glob))
    updates = stream_daily_net(transactions_from_events(src))
    log = UpdateLog(spark, out, ["box_id", "day"], updates.schema)
    run_updates(updates, log.append, ckpt)
    return log.latest()
