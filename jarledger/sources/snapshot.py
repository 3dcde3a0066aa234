"""O04 ledger_snapshot: full-replace snapshots of several tables, committed as one version.

All tables of a snapshot are written first, under a folder of their own; one
manifest entry (see ``manifest``) then names them.  Readers take every table
from the newest entry, so they see tables of one load, and a load that fails
half way is never seen: they fall back to the last complete one.  Writers that
meet at a version are told apart by the manifest; the later one takes the next
version.  Only a missing manifest folder means "no snapshot yet"; any other
read error is raised.  The root must be a shared folder.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from jarledger.sources.manifest import Manifest

TABLES = ("user_boxes", "transactions")
ATTEMPTS = 100


def write_snapshot(root: str, tables: dict[str, DataFrame]) -> int:
    """Write and commit a snapshot; its version."""
    spark = next(iter(tables.values())).sparkSession
    folder = f"{root.rstrip('/')}/load-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}")
    manifest = Manifest(spark, root)
    entry = {"tables": {name: {"path": f"{folder}/{name}", "schema": json.loads(df.schema.json())} for name, df in tables.items()}}
    for _ in range(ATTEMPTS):
        newest = manifest.versions()
        version = newest[-1] + 1 if newest else 1
        if manifest.commit(version, entry):
            return version
    raise RuntimeError("other writers took every version")


def latest_version(spark: SparkSession, root: str) -> int | None:
    found = Manifest(spark, root).versions()
    return found[-1] if found else None


def read_tables(spark: SparkSession, root: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """All tables of one snapshot, the newest if no version is given; None without any."""
    manifest = Manifest(spark, root)
    if version is None:
        found = manifest.versions()
        if not found:
            return None
        version = found[-1]
    return {name: spark.read.schema(StructType.fromJson(t["schema"])).parquet(t["path"])
            for name, t in manifest.entry(version)["tables"].items()}


def read_snapshot(spark: SparkSession, root: str, table: str) -> DataFrame | None:
    tables = read_tables(spark, root)
    return None if tables is None else tables[table]


def ledger_snapshot(boxes: DataFrame, tx: DataFrame, root: str) -> int:
    return write_snapshot(root, {"user_boxes": boxes, "transactions": tx})
