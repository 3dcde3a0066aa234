"""Storage by month, the SQL surface, and the streams of devices and sign-ups."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from jarledger.operators import series
from jarledger.plans import sql_surface
from jarledger.session import ensure_conf
from jarledger.sources import derived, monthly
from jarledger.sources.bind import bind_events
from jarledger.sources.signup import profile_provision
from jarledger.streaming import device_streams
from jarledger.streaming.keyed_inserts import KeyedInserts

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")


def plan(df, mode="formatted"):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))


def test_a_month_query_reads_its_partitions_only(spark):
    ensure_conf(spark)
    L = bind_events(spark, SF)
    rows = L.transactions.unionByName(L.transactions.withColumn("date", F.expr("add_months(date, -5)").cast("timestamp_ntz")))
    stored = monthly.store_by_month(rows, tempfile.mkdtemp(prefix="monthly-") + "/tx")
    assert stored.count() == rows.count() and stored.select("month").distinct().count() >= 2
    first = L.as_of.replace(day=1)
    recent = monthly.since(stored, first)
    assert "PartitionFilters: [isnotnull(month" in plan(recent) and recent.columns == rows.columns
    assert recent.count() == rows.where(F.to_date("date") >= F.lit(first)).count()
    months = L.user_boxes.where("is_archived").select(monthly.month_of(F.col("created_at")).alias("month"))
    assert "dynamicpruning" in plan(monthly.net_of_months(stored, months), "extended").lower()


def test_functions_are_inlined_without_nested_loops(spark):
    ensure_conf(spark)
    L = bind_events(spark, SF)
    sql_surface.register(spark, L)
    for text in ("balance_week(DATE '2024-01-25')", "balance_month(DATE '2024-01-25')", "net_saved_month(DATE '2024-01-25')",
                 "box_history(10, false)", "ledger_reconcile()", "boxes_of(7)"):
        shown = plan(spark.sql(f"SELECT * FROM {text}"))
        assert "NestedLoop" not in shown and "Cartesian" not in shown, text
    assert spark.sql("SELECT * FROM boxes_of(7)").count() == 5
    got = spark.sql("SELECT b.name, w.balance FROM balance_week(DATE '2024-01-25') w JOIN user_boxes b ON b.id = w.box_id WHERE w.point = 6")
    want = series.balance_week(L.transactions, L.user_boxes, as_of=L.as_of).where("point = 6")
    assert sorted(r["balance"] for r in got.collect()) == sorted(r["balance"] for r in want.collect())


def _land(spark, table, parts):
    land = tempfile.mkdtemp(prefix="landing-")
    os.makedirs(f"{land}/inbox")
    for k, part in enumerate(parts):
        part.coalesce(1).write.parquet(f"{land}/{k}")
        f = next(x for x in os.listdir(f"{land}/{k}") if x.endswith(".parquet"))
        yield lambda k=k, f=f: os.link(f"{land}/{k}/{f}", f"{land}/inbox/{k}.parquet"), f"{land}/inbox"


def test_provisioning_takes_each_id_once(spark):
    cust = spark.read.parquet(f"{SF}/customer.parquet")
    half = cust.agg(F.expr("percentile_approx(c_custkey, 0.5)")).first()[0]
    work = tempfile.mkdtemp(prefix="streams-")
    parts = [cust.where(F.col("c_custkey") <= half), cust.where(F.col("c_custkey") > half - 20)]
    for arrive, inbox in _land(spark, "customer", parts):
        arrive()
        for _ in range(2):      # the second run finds nothing new
            got = device_streams.run_stream_provision(spark, inbox, out=f"{work}/out", checkpoint=f"{work}/ck", glob="*.parquet")
            n = got.count()
    want = profile_provision(derived.signup_rows(spark, SF))
    assert n == want.count() and sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_inserts_compare_runs_that_may_hold_the_key(spark, monkeypatch):
    schema = spark.createDataFrame([], "id long, v string").schema
    table, read = KeyedInserts(spark, tempfile.mkdtemp(prefix="inserts-"), "id", schema, ["v"]), []
    rows = lambda *r: spark.createDataFrame(list(r), schema)
    assert table.insert(rows((1, "b"), (1, "a"), (2, "x"), (None, "n")), 0) and not table.insert(rows((9, "z")), 0)
    whole = KeyedInserts.read
    monkeypatch.setattr(KeyedInserts, "read", lambda self, runs: read.append(len(runs)) or whole(self, runs))
    assert table.insert(rows((10, "p"), (11, "q")), 1) and table.insert(rows((2, "late"), (3, "w")), 2) and table.insert(rows((2, "again")), 3)
    assert table.insert(rows(), 4)
    assert read == [0, 1, 1]    # 3 came alone, its run cannot hold 2
    assert sorted(map(tuple, table.rows().collect())) == [(1, "a"), (2, "x"), (3, "w"), (10, "p"), (11, "q")]


def test_queue_drain_resumes_with_a_failed_head(spark):
    from jarledger.operators.queue import drain_rounds
    ev = spark.read.parquet(f"{SF}/events.parquet").withColumn("event_id", F.col("event_id") * 97 - F.when(F.col("event_id") % 3 == 0, 0).otherwise(1))
    cut = ev.orderBy("ts").limit(ev.count() // 2).agg(F.max("ts")).first()[0]
    work = tempfile.mkdtemp(prefix="streams-")
    for arrive, inbox in _land(spark, "events", [ev.where(F.col("ts") <= F.lit(cut)), ev.where(F.col("ts") > F.lit(cut))]):
        arrive()
        got = device_streams.run_stream_queue_drain(spark, inbox, out=f"{work}/out", checkpoint=f"{work}/ck", glob="*.parquet")
    want = drain_rounds(derived.queue_items(ev), derived.device_fetches(ev))
    assert want.where("fails > 0").count() > 100 and want.where("fails > 0 and posted_round is not null").count() > 0
    assert {tuple(r) for r in got.select("op_id", "posted_round", "posted_at").collect()} == {
        tuple(r) for r in want.where("posted_round is not null").select("op_id", "posted_round", "posted_at").collect()}
