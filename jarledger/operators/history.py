"""Per-box newest-first history.

``row_number() <= k`` over (box, date desc, id desc) lets Spark plan a
WindowGroupLimit: each map task keeps at most k rows per box *before* the
shuffle, so a hot box ships k rows per task, not all of its rows.  The limit
comes before the semi join on the boxes, which then sees k rows a box.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from jarledger.operators.filters import active_boxes

RECENT_ACTIVE = 10
RECENT_ARCHIVED = 15


def newest_per_box(tx: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("box_id").orderBy(F.col("date").desc(), F.col("id").desc())
    return tx.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k) \
        .withColumn("rank", F.col("rank").cast("bigint"))


def recent_activity(tx: DataFrame, boxes: DataFrame, k: int = RECENT_ACTIVE) -> DataFrame:
    """Newest ``k`` transactions of every active box."""
    ids = active_boxes(boxes).select(F.col("id").alias("box_id"))
    return newest_per_box(tx, k).join(ids, "box_id", "left_semi")


def archive_history(tx: DataFrame, boxes: DataFrame, k: int = RECENT_ARCHIVED) -> DataFrame:
    """Newest ``k`` transactions of every archived box."""
    ids = boxes.where(F.coalesce(F.col("is_archived"), F.lit(False))).select(F.col("id").alias("box_id"))
    return newest_per_box(tx, k).join(ids, "box_id", "left_semi")
