"""A table that takes each key once, the first row that arrives (INSERT ... ON CONFLICT DO NOTHING).

Runs are committed by a manifest with the range of keys they hold.  A batch
is compared with the runs whose range it meets, only these are read, and what
is new becomes a run.  A batch that runs again after a restart is seen to be there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from jarledger.sources.manifest import Manifest


class KeyedInserts:
    """``key`` is an integer column; of a batch's rows of one key the least by ``order`` is taken."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: StructType, order: list[str]):
        self.spark, self.root, self.key, self.schema, self.order = spark, root.rstrip("/"), key, schema, order
        self.manifest = Manifest(spark, root)

    def state(self) -> tuple[int, dict]:
        return self.manifest.latest() or (0, {"batch": -1, "runs": []})

    def read(self, runs: list[dict]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[r["path"] for r in runs])

    def insert(self, rows: DataFrame, batch_id: int) -> bool:
        version, now = self.state()
        if batch_id <= now["batch"]:
            return False
        rest = [c for c in self.schema.names if c != self.key]
        first = rows.where(F.col(self.key).isNotNull()).groupBy(self.key).agg(
            F.min_by(F.struct(*rest), F.struct(*self.order)).alias("row"))
        path = f"{self.root}/runs/{uuid.uuid4().hex}"
        first.select(self.key, *[F.col(f"row.{c}").alias(c) for c in rest]).select(self.schema.names).write.parquet(f"{path}/sent")
        sent = self.spark.read.schema(self.schema).parquet(f"{path}/sent")
        low, high = sent.agg(F.min(self.key), F.max(self.key)).first()
        runs = list(now["runs"])
        if low is not None:
            met = [r for r in runs if r["low"] <= high and r["high"] >= low]
            fresh = sent.join(self.read(met).where(F.col(self.key).between(low, high)).select(self.key), self.key, "left_anti")
            fresh.select(self.schema.names).write.parquet(f"{path}/new")
            low, high = self.spark.read.schema(self.schema).parquet(f"{path}/new").agg(F.min(self.key), F.max(self.key)).first()
            if low is not None:
                runs.append({"path": f"{path}/new", "low": low, "high": high})
        if not self.manifest.commit(version + 1, {"batch": batch_id, "runs": runs}):
            raise RuntimeError(f"another writer is at {self.root}")
        self.manifest.drop(f"{path}/sent")
        self.manifest.forget()
        return True

    def rows(self) -> DataFrame:
        return self.read(self.state()[1]["runs"])
