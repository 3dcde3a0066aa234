"""Sources, validation and feed (G10, G16, G17, G18, snapshots)."""

import datetime as dt
from decimal import Decimal as D

from jarledger.operators import feed, filters, replay
from jarledger.session import shared_dir
from jarledger.sources import queue_dump, signup, snapshot
from tests.frames import AS_OF, boxes, profiles, ts, tx


def test_g10_validation(spark):
    t = tx(spark, [(1, 1, 5, " x ", ts(0)), (2, 1, -5, "  ", ts(0)), (3, 1, 0, None, ts(0)),
                   (4, 1, None, None, ts(0)), (5, None, 3, "", ts(0))])
    got = {r["id"]: (r["accepted"], r["reason"], r["note"]) for r in filters.tx_checked(t).collect()}
    assert got == {1: (True, None, "x"), 2: (True, None, None), 3: (False, "zero_amount", None),
                   4: (False, "missing_amount", None), 5: (False, "missing_box", None)}
    acc, rej = filters.tx_validate(t)
    assert acc.count() == 2 and rej.count() == 3


def test_entry_validation_parses_before_signing(spark):
    e = spark.createDataFrame([(1, "add", " 12.5 ", " hi "), (1, "withdraw", "7", ""), (1, "add", "12abc", None),
                               (1, "add", "-4", None), (1, "withdraw", "0", None)],
                              "box_id BIGINT, mode STRING, amount_text STRING, note STRING")
    got = [(r["amount"], r["accepted"], r["note"]) for r in filters.entry_validate(e).collect()]
    assert got == [(D("12.50"), True, "hi"), (D("-7.00"), True, None), (D("12.00"), True, None),
                   (None, False, None), (None, False, None)]


def test_box_normalise(spark):
    req = spark.createDataFrame([(1, 1, "  Car ", " usd ", 10.0), (2, 1, "  ", "EUR", 5.0), (3, 1, "Trip", None, -2.0)],
                                "request_id BIGINT, user_id BIGINT, name STRING, currency STRING, target DOUBLE")
    got = {r["request_id"]: (r["name"], r["currency"], r["target_amount"])
           for r in filters.box_normalise(req).collect()}
    assert got == {1: ("Car", "USD", D("10.00")), 3: ("Trip", "EUR", None)}


def test_g16_feed_row_in_german(spark):
    b = boxes(spark, [{"id": 1, "user_id": 7, "currency": "USD"}, {"id": 2, "user_id": 8, "currency": None}])
    p = profiles(spark, [(7, "a", "a@x", "EUR", "de"), (8, "b", "b@x", None, "xx")])
    t = tx(spark, [(1, 1, -3.5, "", dt.datetime(2024, 1, 20, 15, 7)), (2, 2, 4, None, dt.datetime(2024, 1, 25, 9, 3))])
    got = {r["id"]: r.asDict() for r in feed.activity_feed(t, b, p, as_of=AS_OF).collect()}
    r = got[1]
    assert (r["label"], r["sign"], r["amount_text"], r["symbol"]) == ("Auszahlung", "−", "3.50", "$")
    assert (r["is_today"], r["time_text"]) == (False, "20. Jan., 15:07")
    r = got[2]
    assert (r["label"], r["sign"], r["amount_text"], r["symbol"]) == ("Deposit", "+", "4.00", "€")
    assert (r["is_today"], r["time_text"]) == (True, "Today, 09:03 AM")


def test_feed_dates_in_ukrainian(spark):
    b = boxes(spark, [{"id": 1, "user_id": 7, "currency": "UAH"}, {"id": 2, "user_id": None, "currency": None}])
    p = profiles(spark, [(7, "a", "a@x", "UAH", "uk")])
    t = tx(spark, [(1, 1, 5, "", dt.datetime(2024, 5, 3, 0, 4)), (2, 1, 5, "", dt.datetime(2024, 1, 25, 23, 59)),
                   (3, 2, 5, "", dt.datetime(2024, 5, 3, 0, 4))])
    got = {r["id"]: r["time_text"] for r in feed.activity_feed(t, b, p, as_of=AS_OF).collect()}
    assert got == {1: "3 трав., 00:04", 2: "Сьогодні, 23:59", 3: "May 3, 12:04 AM"}


def test_profile_edit_last_name_wins(spark):
    p = profiles(spark, [(1, "a", "a@x", None, "en"), (2, "b", "b@x", None, "en"), (3, "c", "c@x", None, "en"),
                         (4, None, "d@x", None, "en")])
    day = dt.datetime(2024, 1, 1)
    edits = spark.createDataFrame([(1, day, 1, "x"), (2, day, 1, " y\t"), (3, None, 1, "z"), (4, day, 2, "\u00a0 "),
                                   (5, day, 4, None), (6, day, 9, "w"), (7, day, None, "v"), (2, day, 1, " y\t")],
                                  "edit_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, typed STRING")
    got = {r["id"]: r["full_name"] for r in replay.profile_edit(p, edits).collect()}
    assert got == {1: "y", 2: None, 3: "c", 4: None}
    assert replay.profile_edit(p, edits.limit(0)).count() == 4


def test_g17_queue_dumps(spark):
    d = spark.createDataFrame([
        ("d1", 1, "[]"), ("d1", 2, "{}"), ("d1", 3, "oops"),
        ("d2", 4, '[{"action":"withdraw","boxId":5,"amount":2.5,"note":null,"date":"2024-01-02T10:00:00.123Z"}]'),
        ("d3", 5, '{"action":"add","boxId":5,"amount":1,"date":"2024-01-02T10:00:00Z"}'),
        ("d4", 6, None),
    ], "device STRING, dump_id BIGINT, payload STRING")
    rows = queue_dump.op_log_ingest(d).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r["device"], r["action"], r["box_id"], r["amount"], r["seq"]) == ("d2", "withdraw", 5, D("2.50"), 0)
    assert r["ts"] == dt.datetime(2024, 1, 2, 10, 0, 0, 123000)


def test_g18_profile_names(spark):
    s = spark.createDataFrame([(1, "a@x", '{"name":"A"}'), (2, "b@x", '{"full_name":"B","name":"A"}'),
                               (3, "c@x", "{oops"), (4, "d@x", None)],
                              "id BIGINT, email STRING, raw_user_meta_data STRING")
    got = {r["id"]: r["full_name"] for r in signup.profile_provision(s).collect()}
    assert got == {1: "A", 2: "B", 3: None, 4: None}


def test_snapshot_falls_back_to_last_complete(spark):
    root = shared_dir(spark, "test-snapshots")
    b = boxes(spark, [{"id": 1}])
    t1 = tx(spark, [(1, 1, 5, None, ts(0))])
    v1 = snapshot.ledger_snapshot(b, t1, root)
    assert snapshot.latest_version(spark, root) == v1
    # A later load that dies before its manifest row is invisible to readers.
    t2 = tx(spark, [(2, 1, 6, None, ts(0)), (3, 1, 7, None, ts(0))])
    t2.write.parquet(f"{root}/v={v1 + 1}/transactions")
    assert [r["id"] for r in snapshot.read_snapshot(spark, root, "transactions").collect()] == [1]
    v3 = snapshot.ledger_snapshot(b, t2, root)
    assert v3 > v1
    assert sorted(r["id"] for r in snapshot.read_snapshot(spark, root, "transactions").collect()) == [2, 3]


def test_shared_dir_without_a_configured_checkpoint_dir(tmp_path):
    """A local session whose spark.checkpoint.dir is unset (a core setting
    that cannot be changed at runtime) still gets a registered scratch folder,
    so DataFrame.checkpoint() works.  Runs in its own process: the shared test
    session already has a context."""
    import os
    import subprocess
    import sys
    conf_dir = tmp_path / "conf"
    conf_dir.mkdir()
    code = (
        "import sys; sys.path.insert(0, %r)\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        "assert s.conf.get('spark.checkpoint.dir', None) is None\n"
        "from jarledger.session import shared_dir\n"
        "shared_dir(s, 'a'); shared_dir(s, 'b')\n"
        "assert s.sparkContext.getCheckpointDir()\n"
        "print(s.range(7).checkpoint().count())\n"
        "s.stop()\n"
    ) % os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, SPARK_CONF_DIR=str(conf_dir))
    out = subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0, out.stderr[-2000:]
    assert out.stdout.strip().splitlines()[-1] == "7"


def test_queue_dump_white_space_junk_and_trailing_text(spark):
    from jarledger.sources.queue_dump import op_log_ingest
    item = '{"action":"add","boxId":1,"amount":2.5}'
    payloads = [f"\n\t[{item}]\r\n", f"[{item}] oops", f"[3,{item},null]", item, "", None, "[", "[]"]
    dumps = spark.createDataFrame([("d", i, p) for i, p in enumerate(payloads)], "device string, dump_id long, payload string")
    got = [(r["dump_id"], r["seq"], r["action"]) for r in op_log_ingest(dumps).orderBy("dump_id").collect()]
    assert got == [(0, 0, "add"), (2, 1, "add")]


def test_js_trim(spark):
    from jarledger.functions.text import js_trim
    df = spark.createDataFrame([("\t\n",), (" \u00a0usd\u3000",), ("a b",), (None,)], "t string")
    assert [r[0] for r in df.select(js_trim(df["t"])).collect()] == ["", "usd", "a b", None]
