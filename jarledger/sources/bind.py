"""Bind the driver tables to the ledger model.

Binding E (events as the ledger) is the correctness binding, binding L
(lineitem as the ledger) the bench binding.  Every frame is lazy: nothing is
read until an operator's plan runs, and Catalyst prunes the columns it needs.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jarledger.functions.money import money
from jarledger.session import ensure_conf
from jarledger.sources.rates import rates_load

# Binding constants (chosen for the fixtures, see FIXTURES.md).
AS_OF_E = dt.date(2024, 1, 25)
AS_OF_L = dt.date(2000, 6, 15)
BOXES_PER_USER = 5
EVENT_CODES = ["click", "error", "purchase", "signup", "view"]
REGION_CURRENCY = ["EUR", "USD", "UAH", "GBP"]          # region 0..3, region 4 -> NULL
BOX_CURRENCY = ["EUR", "USD", "UAH", "GBP", None, "PLN"]  # by box id % 6
GRID_DENOMINATIONS = [5, 10, 20, 50, 100, 200, 500]
CURRENCY_LANGUAGE = {"EUR": "de", "UAH": "uk"}            # everyone else: en
# Landed rate feeds (invented constants): UAH per unit, and cross rates.
UAH_FEED = [(0, "EUR", 45.0), (1, "USD", 41.5), (2, "GBP", 52.5)]
CROSS_FEED = [
    ("EUR", "USD", 1.08), ("EUR", "GBP", 0.86),
    ("USD", "EUR", 0.925), ("USD", "GBP", 0.795),
    ("GBP", "EUR", 1.165), ("GBP", "USD", 1.26),
]


@dataclass(frozen=True)
class Ledger:
    profiles: DataFrame
    box_templates: DataFrame
    user_boxes: DataFrame
    transactions: DataFrame
    rates: DataFrame
    op_log: DataFrame
    as_of: dt.date


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _case(key: Column, values: list, start: int = 0) -> Column:
    expr = None
    for i, v in enumerate(values, start):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(key == i, lit) if expr is None else expr.when(key == i, lit)
    return expr


def rate_feeds(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    uah = spark.createDataFrame(UAH_FEED, "pos BIGINT, cc STRING, rate DOUBLE")
    cross = spark.createDataFrame(CROSS_FEED, "base STRING, quote STRING, rate DOUBLE")
    return uah, cross


def profiles_from_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = _read(spark, sf_dir, "customer")
    # nation is the fixed 25-row TPC-H dimension: a bounded broadcast.
    nation = F.broadcast(_read(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"))
    home = _case(F.col("n_regionkey"), REGION_CURRENCY)
    lang = F.coalesce(_case_map(home, CURRENCY_LANGUAGE), F.lit("en"))
    return (
        cust.join(nation, cust.c_nationkey == nation.n_nationkey, "left")
        .select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("full_name"),
            F.concat(F.lower("c_name"), F.lit("@example.test")).alias("email"),
            home.alias("home_currency"),
            lang.alias("language"),
        )
    )


def _case_map(key: Column, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr


def templates_from_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part")
    denoms = F.array(*[F.lit(v) for v in GRID_DENOMINATIONS])
    grid = F.transform(
        F.sequence(F.lit(0), (F.col("p_size") % 20).cast("int")),
        lambda i: F.element_at(denoms, ((i + F.col("p_partkey")) % len(GRID_DENOMINATIONS)).cast("int") + 1),
    )
    return part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.floor("p_retailprice").cast("int").alias("total_amount"),
        F.lit("UAH").alias("currency"),
        grid.alias("grid_config"),
    )


def transactions_from_events(events: DataFrame) -> DataFrame:
    """Row-wise projection only, so it also binds a streaming events frame."""
    code = _case_map(F.col("event_type"), {k: i for i, k in enumerate(EVENT_CODES)})
    eid = F.col("event_id")
    return events.select(
        eid.alias("id"),
        (F.col("user_id") * 10 + code).alias("box_id"),
        money(F.when(eid % 4 == 0, -F.col("value")).otherwise(F.col("value"))).alias("amount"),
        F.when(eid % 3 == 0, F.concat(F.lit("note "), (eid % 10).cast("string")))
        .when(eid % 3 == 1, F.lit("")).alias("note"),
        F.col("ts").alias("date"),
    )


def op_log_from_events(events: DataFrame) -> DataFrame:
    eid = F.col("event_id")
    et = F.col("event_type")
    op = (
        F.when(et == "purchase", "withdraw")
        .when(et == "error", "delete_tx")
        .when((et == "signup") & (eid % 40 == 0), "reset")
        .otherwise("add")
    )
    return events.select(
        eid.alias("op_id"),
        F.col("ts"),
        F.concat(F.lit("d"), (F.col("user_id") % 8).cast("string")).alias("device"),
        F.col("user_id").alias("box_id"),
        op.alias("op"),
        money("value").alias("amount"),
        F.lit(None).cast("string").alias("arg"),
        (eid % 997 == 0).alias("failed"),
    )


def boxes_from_customers(spark: SparkSession, sf_dir: str, tx: DataFrame) -> DataFrame:
    cust = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    boxes = cust.select(
        "c_custkey", "c_name",
        F.explode(F.sequence(F.lit(0), F.lit(BOXES_PER_USER - 1))).alias("k"),
    ).withColumn("id", F.col("c_custkey") * 10 + F.col("k"))
    # Σ amount per box: partial aggregation map-side, then one exchange.
    sums = tx.groupBy("box_id").agg(F.sum("amount").alias("tx_sum"))
    bid = F.col("id")
    template_id = F.when(bid % 3 == 0, F.col("c_custkey"))  # reaches more templates as the tables grow
    target = F.when(bid % 4 == 0, F.lit(None)).when(bid % 4 == 1, F.lit(0)).otherwise(100 + bid % 900)
    crossed = F.when(
        template_id.isNull(), F.array().cast("array<int>")
    ).otherwise(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (bid + i) % 3 == 0))
    current = F.when(bid % 7 == 0, F.lit(0)).otherwise(
        F.greatest(F.lit(0), F.coalesce(F.col("tx_sum"), F.lit(0)) + F.when(bid % 5 == 0, 100).otherwise(0))
    )
    return (
        boxes.join(sums, boxes.id == sums.box_id, "left")
        .select(
            bid.alias("id"),
            F.col("c_custkey").alias("user_id"),
            template_id.alias("template_id"),
            F.concat(F.col("c_name"), F.lit("/"), F.col("k").cast("string")).alias("name"),
            _case(bid % 6, BOX_CURRENCY).alias("currency"),
            money(current).alias("current_amount"),
            money(target).alias("target_amount"),
            (bid % 8 == 0).alias("is_archived"),
            crossed.alias("crossed_out_indices"),
            F.expr("timestampadd(MINUTE, id, TIMESTAMP_NTZ'2024-01-01 00:00:00')").alias("created_at"),
        )
    )


def bind_events(spark: SparkSession, sf_dir: str) -> Ledger:
    """Binding E: events as transactions, customers x 5 as boxes."""
    ensure_conf(spark)
    events = _read(spark, sf_dir, "events")
    tx = transactions_from_events(events)
    uah, cross = rate_feeds(spark)
    return Ledger(
        profiles=profiles_from_customers(spark, sf_dir),
        box_templates=templates_from_parts(spark, sf_dir),
        user_boxes=boxes_from_customers(spark, sf_dir, tx),
        transactions=tx,
        rates=rates_load(uah, cross),
        op_log=op_log_from_events(events),
        as_of=AS_OF_E,
    )


def bind_lineitem(spark: SparkSession, sf_dir: str) -> Ledger:
    """Binding L (bench): orders as boxes, lineitems as transactions."""
    ensure_conf(spark)
    li = _read(spark, sf_dir, "lineitem")
    orders = _read(spark, sf_dir, "orders")
    # lineitem has no key: a deterministic content hash stands in for an id
    # (stable under task retries, unlike monotonically_increasing_id).
    tx_id = F.xxhash64("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                       "l_quantity", "l_extendedprice", "l_shipdate")
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    tx = li.select(
        tx_id.alias("id"),
        F.col("l_orderkey").alias("box_id"),
        money(sign * F.col("l_extendedprice")).alias("amount"),
        F.when(F.col("l_linestatus") == "F", F.lit("")).otherwise(F.col("l_returnflag")).alias("note"),
        F.col("l_shipdate").alias("date"),
    )
    sums = tx.groupBy("box_id").agg(F.sum("amount").alias("tx_sum"))
    boxes = orders.join(sums, orders.o_orderkey == sums.box_id, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.lit(None).cast("bigint").alias("template_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.lit("EUR").alias("currency"),
        money(F.greatest(F.lit(0), F.coalesce(F.col("tx_sum"), F.lit(0)))).alias("current_amount"),
        money("o_totalprice").alias("target_amount"),
        (F.col("o_orderstatus") == "F").alias("is_archived"),
        F.array().cast("array<int>").alias("crossed_out_indices"),
        F.col("o_orderdate").alias("created_at"),
    )
    rf = F.col("l_returnflag")
    op = (
        F.when(rf == "R", "withdraw")
        .when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") == 7), "reset")
        .when(F.col("l_discount") == 0, "delete_tx")
        .otherwise("add")
    )
    op_log = li.select(
        tx_id.alias("op_id"),
        F.col("l_shipdate").alias("ts"),
        F.concat(F.lit("d"), (F.col("l_orderkey") % 64).cast("string")).alias("device"),
        F.col("l_suppkey").alias("box_id"),
        op.alias("op"),
        money("l_extendedprice").alias("amount"),
        F.lit(None).cast("string").alias("arg"),
        (F.col("l_linenumber") == 7).alias("failed"),
    )
    uah, cross = rate_feeds(spark)
    return Ledger(
        profiles=profiles_from_customers(spark, sf_dir),
        box_templates=templates_from_parts(spark, sf_dir),
        user_boxes=boxes,
        transactions=tx,
        rates=rates_load(uah, cross),
        op_log=op_log,
        as_of=AS_OF_L,
    )


# Per-box operators key on these columns; bucketing the stored tables on them
# co-locates a box's rows, so per-box aggregates, the box joins and the box
# windows need no exchange at all.
BUCKET_KEYS = {"user_boxes": ("id",), "transactions": ("box_id", "date"), "op_log": ("box_id", "ts")}
TABLES = ("profiles", "box_templates", "user_boxes", "transactions", "rates", "op_log")


def materialize(ledger: Ledger, root: str, buckets: int | None = None, prefix: str | None = None) -> Ledger:
    """Write the bound tables once under a shared folder and read them back:
    later plans start from stored tables (as a production ledger would), not
    from the binding's joins and aggregates.

    With ``buckets``, boxes, transactions and the op log are stored as
    external tables bucketed on the box id (and sorted by time inside each
    bucket); the same bucket count on both sides lets box joins run without
    a shuffle.
    """
    spark = ledger.transactions.sparkSession
    out = {}
    for name in TABLES:
        df = getattr(ledger, name)
        path = f"{root}/{name}"
        if buckets and name in BUCKET_KEYS:
            key, *order = BUCKET_KEYS[name]
            table = f"{prefix or 'ledger'}_{name}"
            (df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order)
             .option("path", path).saveAsTable(table))
            out[name] = spark.table(table)
        else:
            df.write.mode("overwrite").parquet(path)
            out[name] = spark.read.parquet(path)
    return Ledger(as_of=ledger.as_of, **out)
