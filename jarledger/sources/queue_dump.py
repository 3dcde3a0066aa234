"""O03 op_log_ingest: device queue dumps (one JSON array per dump) -> rows.

A payload that does not parse, or parses to something other than an array,
yields no rows -- the device treats it as an empty queue.  JSON white space
around the array is allowed; an element that is no object is passed over, the
others keep their place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jarledger.schemas import QUEUE_ITEM

ITEM_DDL = f"STRUCT<{QUEUE_ITEM}>"


def op_log_ingest(dumps: DataFrame, payload: str = "payload") -> DataFrame:
    """``dumps(device, dump_id, payload)`` -> (device, dump_id, seq, action,
    box_id, amount, note, ts).  ``seq`` is the item's queue position."""
    text = F.regexp_replace(F.col(payload), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    # from_json would read a lone object as a one-element array, and stop
    # before text that follows an array; the device code accepts neither.
    is_array = text.startswith("[") & text.endswith("]")
    elements = F.when(is_array, F.from_json(text, "ARRAY<STRING>", {"mode": "PERMISSIVE"}))
    exploded = dumps.select("device", "dump_id", F.posexplode(elements).alias("seq", "element"))
    exploded = exploded.where(F.col("element").startswith("{")).withColumn("item", F.from_json("element", ITEM_DDL))
    ts = F.try_to_timestamp(F.regexp_replace(F.col("item.date"), "Z$", "")).cast("timestamp_ntz")
    return exploded.select(
        "device", "dump_id", F.col("seq").cast("bigint").alias("seq"),
        F.col("item.action").alias("action"),
        F.col("item.boxId").alias("box_id"),
        F.col("item.amount").alias("amount"),
        F.col("item.note").alias("note"),
        ts.alias("ts"),
    )


def dumps_from_events(events: DataFrame) -> DataFrame:
    """Binding for O03: one single-item dump per event, serialised with
    ``to_json``; every 50th payload is broken (a lone object, or junk)."""
    eid = F.col("event_id")
    item = F.struct(
        F.when(F.col("event_type") == "purchase", "withdraw").otherwise("add").alias("action"),
        F.col("user_id").alias("boxId"),
        F.col("value").cast("decimal(12,2)").alias("amount"),
        F.when(eid % 3 == 0, F.concat(F.lit("n"), (eid % 10).cast("string"))).alias("note"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("Z")).alias("date"),
    )
    payload = (F.when(eid % 100 == 0, F.to_json(item))
               .when(eid % 100 == 50, F.concat(F.lit("oops"), F.to_json(F.array(item))))
               .otherwise(F.to_json(F.array(item))))
    return events.select(F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device"),
                         eid.alias("dump_id"), payload.alias("payload"))
