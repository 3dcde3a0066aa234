"""A keyed table kept by micro-batches: newest row per key, in few files.

Each batch adds a run of the keys it changed.  ``fan`` runs of a level are
merged into one run of the next, newest row per key, in the same commit; a key
is rewritten once a level, and a reader opens fewer than ``fan`` runs of each
level, however many batches there were.  A commit is one manifest entry that
names all runs and the last batch, so a batch that runs again after a restart
is seen to be there and leaves no trace.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from jarledger.sources.manifest import Manifest

FAN = 8


def latest_per_key(log: DataFrame, *keys: str) -> DataFrame:
    cols = [c for c in log.columns if c not in (*keys, "batch_id")]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "batch_id").alias("s"), F.max("batch_id").alias("batch_id"))
    return best.select(*keys, *[F.col(f"s.{c}").alias(c) for c in cols], "batch_id")


class UpdateLog:
    def __init__(self, spark: SparkSession, root: str, keys: list[str], schema: StructType, fan: int = FAN):
        self.spark, self.root, self.keys, self.fan = spark, root.rstrip("/"), keys, fan
        self.schema = StructType([*schema.fields, StructField("batch_id", LongType())])
        self.manifest = Manifest(spark, root)

    def state(self) -> tuple[int, dict]:
        return self.manifest.latest() or (0, {"batch": -1, "runs": [], "dead": []})

    def read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[r["path"] for r in runs])

    def write(self, rows: DataFrame, level: int) -> dict:
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        rows.write.parquet(path)
        return {"path": path, "level": level}

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Commit a batch's rows, one for each key; False if the batch is already there."""
        version, now = self.state()
        if batch_id <= now["batch"]:
            return False
        rows = rows.withColumn("batch_id", F.lit(batch_id).cast("long")).select(self.schema.names)
        runs, dead = [*now["runs"], self.write(rows, 0)], []
        level = 0
        while sum(r["level"] == level for r in runs) >= self.fan:
            merged = [r for r in runs if r["level"] == level]     # the newest of all, and next to each other
            runs = [r for r in runs if r["level"] > level] + [self.write(latest_per_key(self.read(merged), *self.keys).select(self.schema.names), level + 1)]
            dead += merged
            level += 1
        if not self.manifest.commit(version + 1, {"batch": batch_id, "runs": runs, "dead": dead}):
            raise RuntimeError(f"another writer is at {self.root}")
        for run in now["dead"]:     # merged away a commit ago, so that readers of that commit are done
            self.manifest.drop(run["path"])
        self.manifest.forget()
        return True

    def latest(self) -> DataFrame:
        """The newest row of each key."""
        return latest_per_key(self.read(self.state()[1]["runs"]), *self.keys).drop("batch_id")
