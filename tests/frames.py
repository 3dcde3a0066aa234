"""Small inline frames in the model schemas."""

import datetime as dt
from decimal import Decimal as D

from jarledger import schemas

AS_OF = dt.date(2024, 1, 25)


def ts(day_offset: int, hour: int = 12, minute: int = 0) -> dt.datetime:
    return dt.datetime.combine(AS_OF, dt.time(hour, minute)) + dt.timedelta(days=day_offset)


def boxes(spark, rows):
    """rows: dicts with at least id and current_amount."""
    full = []
    for r in rows:
        full.append((
            r["id"], r.get("user_id", 1), r.get("template_id"), r.get("name", f"box {r['id']}"),
            r.get("currency", "EUR"), D(str(r.get("current_amount", 0))),
            None if r.get("target_amount") is None else D(str(r["target_amount"])),
            r.get("is_archived", False), r.get("crossed_out_indices", []),
            r.get("created_at", dt.datetime(2024, 1, 1)),
        ))
    return spark.createDataFrame(full, schemas.USER_BOXES)


def tx(spark, rows):
    """rows: (id, box_id, amount, note, datetime)."""
    return spark.createDataFrame(
        [(i, b, None if a is None else D(str(a)), n, d) for i, b, a, n, d in rows], schemas.TRANSACTIONS)


def templates(spark, rows):
    return spark.createDataFrame(rows, schemas.BOX_TEMPLATES)


def profiles(spark, rows):
    return spark.createDataFrame(rows, schemas.PROFILES)


def ops(spark, rows):
    """rows: (op_id, datetime, device, box_id, op, amount, failed)."""
    return spark.createDataFrame(
        [(o, t, dev, b, op, None if a is None else D(str(a)), None, f) for o, t, dev, b, op, a, f in rows],
        schemas.OP_LOG)
