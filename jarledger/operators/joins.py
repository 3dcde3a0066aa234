"""Joins (O13-O18).

Dimension sides are not broadcast by hint unless their row count was measured
and is under a bound (the rate table: 4 bases x the quote codes of the feeds,
a few hundred rows in practice, counted before the join).  Templates and
profiles grow with the data, so the choice is left to Catalyst statistics and
AQE, which switches a sort-merge join to a broadcast at runtime when the
measured side is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jarledger.functions.display import currency_code


def _broadcast_if_counted_small(df: DataFrame, conf_key: str, default_rows: int) -> DataFrame:
    """Broadcast ``df`` only when its measured row count is within the bound
    (``conf_key``); beyond it the join falls back to a shuffle join."""
    lim = int(df.sparkSession.conf.get(conf_key, str(default_rows)))
    return F.broadcast(df) if df.count() <= lim else df


def boxes_with_template(boxes: DataFrame, templates: DataFrame, ordered: bool = True) -> DataFrame:
    """Box left-join template (name, total, grid, currency), created_at asc."""
    t = templates.select(
        F.col("id").alias("template_id"),
        F.col("name").alias("template_name"),
        F.col("total_amount").alias("template_total"),
        F.col("grid_config").alias("template_grid"),
        F.col("currency").alias("template_currency"),
    )
    out = boxes.join(t, "template_id", "left")
    return out.orderBy("created_at", "id") if ordered else out


def tx_owner_scope(tx: DataFrame, boxes: DataFrame, users: DataFrame, user_col: str = "id") -> DataFrame:
    """Transactions whose box belongs to one of ``users`` (EXISTS -> semi join)."""
    owned = boxes.join(users.select(F.col(user_col).alias("user_id")), "user_id", "left_semi")
    return tx.join(owned.select(F.col("id").alias("box_id")), "box_id", "left_semi")


def box_home_equivalent(boxes: DataFrame, profiles: DataFrame, rates: DataFrame) -> DataFrame:
    """Each box's balance in its owner's home currency.

    No home currency -> null; the same code -> the balance; otherwise
    balance / rate[base=home, quote=code] with a null code read as EUR and
    codes upper-cased; an unknown code or a zero rate -> null.  ``shown``
    mirrors the card: home set, codes differ, value known.
    """
    return with_home(boxes, profiles, rates).select(
        F.col("id").alias("box_id"), "user_id", F.col("code").alias("currency"), "home_currency", *home_columns())


def with_home(boxes: DataFrame, profiles: DataFrame, rates: DataFrame) -> DataFrame:
    """Boxes with the owner's ``home_currency``, their currency's ``code`` and ``shown_code``, and the ``rate``."""
    home = profiles.select(F.col("id").alias("user_id"), "home_currency")
    r = _broadcast_if_counted_small(
        rates.select(F.col("base").alias("home_currency"), F.col("quote").alias("code"), "rate"),
        "jarledger.rates.broadcastRows", 100_000)
    b = boxes.join(home, "user_id", "left").select(
        *boxes.columns, "home_currency", currency_code(F.col("currency"), empty_is_missing=True).alias("code"),
        currency_code(F.col("currency")).alias("shown_code"))
    return b.join(r, ["home_currency", "code"], "left")


def home_columns() -> list[Column]:
    """``home_equivalent`` and ``shown`` of what :func:`with_home` gives."""
    bal = F.col("current_amount").cast("double")
    rate = F.col("rate")
    equiv = (
        F.when(F.col("home_currency").isNull(), F.lit(None).cast("double"))
        .when(F.col("code") == F.col("home_currency"), bal)
        .when(rate.isNull() | (rate == 0), F.lit(None).cast("double"))
        .otherwise(bal / rate)
    )
    return [
        equiv.alias("home_equivalent"),
        (F.col("home_currency").isNotNull() & (F.col("shown_code") != F.col("home_currency"))
         & equiv.isNotNull()).alias("shown"),
    ]


def cascade_delete(profiles: DataFrame, boxes: DataFrame, tx: DataFrame,
                   users: DataFrame | None = None, box_ids: DataFrame | None = None
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete users and/or boxes; boxes of removed users and transactions
    of removed boxes go too.  Returns (profiles, boxes, transactions) left."""
    removed = None
    if users is not None:
        u = users.select(F.col("id").alias("user_id"))
        profiles = profiles.join(u.withColumnRenamed("user_id", "id"), "id", "left_anti")
        removed = boxes.join(u, "user_id", "left_semi").select("id")
    if box_ids is not None:
        ids = box_ids.select("id")
        removed = ids if removed is None else removed.unionByName(ids)
    if removed is None:
        return profiles, boxes, tx
    boxes_left = boxes.join(removed, "id", "left_anti")
    tx_left = tx.join(removed.select(F.col("id").alias("box_id")), "box_id", "left_anti")
    return profiles, boxes_left, tx_left


def fk_violations(profiles: DataFrame, templates: DataFrame, boxes: DataFrame, tx: DataFrame) -> DataFrame:
    """Rows whose foreign key names a missing parent (null keys pass)."""
    p = profiles.select(F.col("id").alias("user_id"))
    t = templates.select(F.col("id").alias("template_id"))
    b = boxes.select(F.col("id").alias("box_id"))
    box_user = boxes.where(F.col("user_id").isNotNull()).join(p, "user_id", "left_anti").select(
        F.lit("box_profile").alias("kind"), F.col("id").alias("child_id"), F.col("user_id").alias("parent_id"))
    box_tpl = boxes.where(F.col("template_id").isNotNull()).join(t, "template_id", "left_anti").select(
        F.lit("box_template").alias("kind"), F.col("id").alias("child_id"), F.col("template_id").alias("parent_id"))
    tx_box = tx.where(F.col("box_id").isNotNull()).join(b, "box_id", "left_anti").select(
        F.lit("tx_box").alias("kind"), F.col("id").alias("child_id"), F.col("box_id").alias("parent_id"))
    return box_user.unionByName(box_tpl).unionByName(tx_box)


def boxes_without_activity(boxes: DataFrame, tx: DataFrame) -> DataFrame:
    """Boxes with no transaction at all."""
    used = tx.select(F.col("box_id").alias("id")).distinct()
    return boxes.join(used, "id", "left_anti").select("id", "user_id", "name", "current_amount")
