"""Filters, projections and validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jarledger.functions.text import js_trim, leading_number
from jarledger.functions.money import money
from jarledger.functions.display import DEFAULT_CURRENCY


def _not_archived() -> Column:
    return ~F.coalesce(F.col("is_archived"), F.lit(False))


def active_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes not archived (a null flag counts as active)."""
    return boxes.where(_not_archived())


def archived_boxes(boxes: DataFrame) -> DataFrame:
    """Archived boxes with their balance."""
    return boxes.where(~_not_archived()).select(
        "id", "user_id", "name", "currency", F.col("current_amount").alias("balance")
    )


def owner_boxes(boxes: DataFrame, users: DataFrame, user_col: str = "id") -> DataFrame:
    """Boxes owned by a set of users (left semi join, no duplicates)."""
    owners = users.select(F.col(user_col).alias("user_id"))
    return boxes.join(owners, "user_id", "left_semi")


def box_transactions(tx: DataFrame, box_ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Transactions of a set of boxes."""
    ids = box_ids.select(F.col(id_col).alias("box_id"))
    return tx.join(ids, "box_id", "left_semi")


def _clean_note(note: Column) -> Column:
    return F.nullif(js_trim(note), F.lit(""))


def tx_checked(tx: DataFrame) -> DataFrame:
    """Every row with ``accepted`` and a rejection ``reason``.

    Rules: box_id must be present, amount present and non-zero (amounts may be
    negative); the note is trimmed and a blank note becomes null.
    """
    reason = (
        F.when(F.col("box_id").isNull(), F.lit("missing_box"))
        .when(F.col("amount").isNull(), F.lit("missing_amount"))
        .when(F.col("amount") == 0, F.lit("zero_amount"))
    )
    return tx.select(
        "id", "box_id", "amount", _clean_note(F.col("note")).alias("note"), "date",
        reason.isNull().alias("accepted"), reason.alias("reason"),
    )


def tx_validate(tx: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O11 as two outputs: (accepted rows, rejected rows with reason)."""
    checked = tx_checked(tx)
    accepted = checked.where("accepted").drop("accepted", "reason")
    rejected = checked.where(~F.col("accepted")).drop("accepted")
    return accepted, rejected


def entry_validate(entries: DataFrame) -> DataFrame:
    """O11 (entry form): typed text -> signed amount.

    ``entries(box_id, mode, amount_text, note)``: the text must start with a
    number > 0, which is signed by the mode (withdraw negative); what follows
    the number is ignored.
    """
    parsed = leading_number(F.col("amount_text"))
    ok = parsed.isNotNull() & (parsed > 0)
    signed = F.when(F.col("mode") == "withdraw", -parsed).otherwise(parsed)
    return entries.select(
        "box_id", "mode",
        F.when(ok, signed).alias("amount"),
        _clean_note(F.col("note")).alias("note"),
        ok.alias("accepted"),
    )


def box_normalise(requests: DataFrame) -> DataFrame:
    """Create-box requests -> new box rows.

    ``requests(request_id, user_id, name, currency, target)``: the name is
    trimmed and must be non-empty (else the request is dropped); currency is
    upper(trim) or EUR when blank; a target is kept only when > 0; new boxes
    start at 0, unarchived, with no crossed cells and no template.
    """
    name = js_trim(F.col("name"))
    cur = F.upper(F.coalesce(F.nullif(js_trim(F.col("currency")), F.lit("")), F.lit(DEFAULT_CURRENCY)))
    target = money("target")
    return requests.where(name.isNotNull() & (name != "")).select(
        "request_id", "user_id",
        F.lit(None).cast("bigint").alias("template_id"),
        name.alias("name"),
        cur.alias("currency"),
        money(F.lit(0)).alias("current_amount"),
        F.when(target > 0, target).alias("target_amount"),
        F.lit(False).alias("is_archived"),
        F.array().cast("array<int>").alias("crossed_out_indices"),
    )
