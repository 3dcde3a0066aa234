"""Request streams derived from the driver tables (binding E extras).

The app's one-at-a-time actions (create, rename, cross out, delete, sign up)
become tables here, built row-wise from ``events``, ``orders`` and
``customer`` so they grow with the data.  The DuckDB oracle builds the same
rows with the same rules (see ``plans/oracle.py``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jarledger.sources.bind import _read


def uah_home_users(profiles: DataFrame) -> DataFrame:
    """Users whose home currency is UAH (a user set for O09 / O14)."""
    return profiles.where(F.col("home_currency") == "UAH").select("id")


def create_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O12 input: one create-goal request per customer, with untrimmed text."""
    c = _read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    name = F.when(k % 10 == 0, F.lit("   ")).otherwise(
        F.concat(F.lit("  "), F.col("c_mktsegment"), F.lit(" goal ")))
    cur = (F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit(" usd "))
           .when(k % 5 == 2, F.lit("")).when(k % 5 == 3, F.lit("gbp")).otherwise(F.lit("Uah ")))
    return c.select(k.alias("request_id"), k.alias("user_id"), name.alias("name"),
                    cur.alias("currency"), F.col("c_acctbal").alias("target"))


def broken_transactions(tx: DataFrame) -> DataFrame:
    """O11 input: every 7th row lacks its box, every 5th its amount, every 3rd has amount 0."""
    i = F.col("id")
    return tx.select("id", F.when(i % 7 != 0, F.col("box_id")).alias("box_id"),
                     F.when(i % 5 == 0, F.lit(None)).when(i % 3 == 0, F.lit(0)).otherwise(F.col("amount"))
                     .cast("decimal(12,2)").alias("amount"), "note", "date")


def typed_entries(events: DataFrame) -> DataFrame:
    """O11 entry form: typed amounts with blanks, text behind the number, signs, or no number at all."""
    k = F.col("event_id") % 6
    value = F.col("value").cast("decimal(12,2)").cast("string")
    text = (F.when(k == 0, F.concat(value, F.lit("abc"))).when(k == 1, F.concat(F.lit(" \t"), value, F.lit(" ")))
            .when(k == 2, F.lit("")).when(k == 3, F.lit("x1")).when(k == 4, F.concat(F.lit("-"), value)).otherwise(F.lit("0")))
    return events.select(F.col("user_id").alias("box_id"),
                         F.when(F.col("event_type") == "purchase", "withdraw").otherwise("add").alias("mode"),
                         text.alias("amount_text"), F.when(k == 1, F.lit(" hi ")).alias("note"))


def template_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O39 input: one create-from-template request per order."""
    o = _read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    name = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.lit(None).cast("string")) \
        .otherwise(F.col("o_orderpriority"))
    return o.select(k.alias("request_id"), F.col("o_custkey").alias("user_id"),
                    F.expr("o_orderkey div 7").alias("template_id"), name.alias("name"))


def attribute_ops(events: DataFrame) -> DataFrame:
    """O38 input: click -> rename, view -> retarget, purchase -> archive,
    signup -> restore, error -> an op the app does not know."""
    eid, et = F.col("event_id"), F.col("event_type")
    op = (F.when(et == "click", "rename").when(et == "view", "retarget")
          .when(et == "purchase", "archive").when(et == "signup", "restore").otherwise("recolor"))
    rename_arg = F.when(eid % 7 == 0, F.lit("  ")).otherwise(
        F.concat(F.lit(" Goal "), (eid % 10).cast("string"), F.lit(" ")))
    retarget_arg = (F.when(eid % 5 == 0, F.lit("")).when(eid % 11 == 0, F.lit("-5"))
                    .otherwise(F.col("value").cast("decimal(12,2)").cast("string")))
    arg = F.when(et == "click", rename_arg).when(et == "view", retarget_arg)
    return events.select(eid.alias("op_id"), "ts", (F.col("user_id") * 10 + eid % 5).alias("box_id"),
                         op.alias("op"), arg.alias("arg"))


def profile_edits(events: DataFrame) -> DataFrame:
    """Profile edit input: every event is a typed name, some blank, padded or missing."""
    eid, k = F.col("event_id"), F.col("event_id") % 4
    typed = (F.when(k == 0, F.lit("\t \n"))
             .when(k == 1, F.concat(F.lit("  Name "), (eid % 10).cast("string"), F.lit("\t")))
             .when(k == 3, F.concat(F.lit("User "), eid.cast("string"))))
    return events.select(eid.alias("edit_id"), "ts", "user_id", typed.alias("typed"))


def crossout_requests(events: DataFrame) -> DataFrame:
    """O40 input: every event asks to cross out cell event_id % 25 of a box."""
    eid = F.col("event_id")
    return events.select(eid.alias("req_id"), "ts", (F.col("user_id") * 10 + eid % 5).alias("box_id"),
                         (eid % 25).cast("int").alias("idx"))


def delete_requests(events: DataFrame) -> DataFrame:
    """O41 input: every 'error' event deletes its own transaction."""
    return events.where(F.col("event_type") == "error").select(
        F.col("event_id").alias("req_id"), "ts", F.col("event_id").alias("tx_id"))


def queue_items(events: DataFrame) -> DataFrame:
    """Queue drain input: every event is an item; every 97th fails at its first one to three attempts."""
    eid = F.col("event_id")
    return events.select(eid.alias("op_id"), "ts", F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device"),
                         F.when(eid % 97 == 0, 1 + eid % 3).otherwise(0).cast("int").alias("fails"))


def queue_money(events: DataFrame) -> DataFrame:
    """The same items with their box and money."""
    more = events.select(F.col("event_id").alias("op_id"), (F.col("user_id") * 10 + F.col("event_id") % 5).alias("box_id"),
                         F.when(F.col("event_type") == "purchase", "withdraw").otherwise("add").alias("op"),
                         F.col("value").cast("decimal(12,2)").alias("amount"))
    return queue_items(events).join(more, "op_id")


def device_fetches(events: DataFrame) -> DataFrame:
    """Queue drain input: at every view the device opens the app."""
    return events.where(F.col("event_type") == "view").select(
        F.col("event_id").alias("fetch_id"), "ts", F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device"))


def unified_log(events: DataFrame) -> DataFrame:
    """One log of all that happens: purchases withdraw, errors delete what an earlier event posted, clicks cross out
    cells, some sign-ups reset or delete the box, the rest adds."""
    eid, et = F.col("event_id"), F.col("event_type")
    op = (F.when(et == "purchase", "withdraw").when(et == "error", "delete_tx").when(et == "click", "crossout")
          .when((et == "signup") & (eid % 40 == 0), "reset").when((et == "signup") & (eid % 200 == 3), "delete_box").otherwise("add"))
    arg = F.when(et == "error", eid - 1 - eid % 7).when(et == "click", eid % 25)
    return events.select(eid.alias("op_id"), "ts", (F.col("user_id") * 10 + eid % 5).alias("box_id"), op.alias("op"),
                         F.when(op.isin("add", "withdraw"), F.col("value")).cast("decimal(12,2)").alias("amount"), arg.cast("string").alias("arg"))


def signup_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O06 input: sign-up rows with JSON user metadata; every 50th is broken."""
    return signups_of(_read(spark, sf_dir, "customer"))


def signups_of(c: DataFrame) -> DataFrame:
    """The same from a customer frame, which may stream."""
    k = F.col("c_custkey")
    meta = (F.when(k % 3 == 0, F.to_json(F.struct(F.col("c_name").alias("full_name"), F.lit("nick").alias("name"))))
            .when(k % 3 == 1, F.to_json(F.struct(F.col("c_name").alias("name"))))
            .otherwise(F.lit("{}")))
    meta = F.when(k % 50 == 0, F.concat(F.lit("{oops "), meta)).otherwise(meta)
    return c.select(k.alias("id"), F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email"),
                    meta.alias("raw_user_meta_data"))
