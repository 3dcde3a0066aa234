"""Session helpers: the few settings every job relies on."""

from __future__ import annotations

import os
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import SparkSession

# Settings the ledger semantics depend on (UTC day keys) plus AQE, which
# re-plans joins and shuffle sizes from runtime statistics.
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "jarledger") -> SparkSession:
    """Local session for tests and the bench (UI off, UTC, AQE on)."""
    master = master or os.environ.get("JARLEDGER_MASTER", "local[8]")
    # Table metadata of a local session goes to a scratch warehouse (tables
    # we save name their own path under the shared folder); on a cluster the
    # cluster's own warehouse setting stands.
    warehouse = os.environ.get("JARLEDGER_WAREHOUSE")
    if not warehouse and master.startswith("local"):
        warehouse = tempfile.mkdtemp(prefix="jarledger-wh-")
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("JARLEDGER_DRIVER_MEM", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if warehouse:
        builder = builder.config("spark.sql.warehouse.dir", warehouse)
    for k, v in REQUIRED_CONF.items():
        builder = builder.config(k, v)
    # Stage and task times without the UI: JARLEDGER_EVENT_LOG=<scratch dir>
    # writes Spark's event log there (one JSON line per event).
    event_log = os.environ.get("JARLEDGER_EVENT_LOG")
    if event_log:
        os.makedirs(event_log, exist_ok=True)
        builder = builder.config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", event_log)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship_package() -> None:
    """Send this package's functions to the workers by value.

    Workers then need no copy of the package on their path: what a Python
    operator uses travels with its task.
    """
    cloudpickle.register_pickle_by_value(sys.modules[__package__])


def ensure_conf(spark: SparkSession) -> None:
    """Apply the runtime SQL settings the operators assume."""
    ship_package()
    for k, v in REQUIRED_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)


def shared_dir(spark: SparkSession, *parts: str) -> str:
    """A fresh folder under the cluster's shared checkpoint directory.

    The cluster names its shared folder in ``spark.checkpoint.dir``; we read
    it from the session.  Only when it is unset (local tests) do we create a
    scratch folder and register it, so ``DataFrame.checkpoint()`` works too.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    sc = None
    try:
        sc = spark.sparkContext
    except Exception:  # e.g. a Spark Connect session has no SparkContext
        sc = None
    if not root and sc is not None:
        root = sc.getCheckpointDir()
    if not root:
        master = sc.master if sc is not None else spark.conf.get("spark.master", "")
        if not str(master).startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        root = tempfile.mkdtemp(prefix="jarledger-ckpt-")
        # spark.checkpoint.dir is fixed when the context starts; register the
        # scratch folder on the context, where later calls find it.
        if sc is not None:
            sc.setCheckpointDir(root)
    elif sc is not None and not sc.getCheckpointDir():
        # Named in the session conf but not registered: DataFrame.checkpoint()
        # needs the context's directory, so point it at the same shared folder.
        sc.setCheckpointDir(root)
    path = "/".join([root.rstrip("/"), *parts, uuid.uuid4().hex])
    return path
