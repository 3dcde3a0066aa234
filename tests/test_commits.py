"""Commits of whole versions: snapshots, update logs, and who wins a version."""

import random
import tempfile

import pytest
from pyspark.errors import PySparkException

from jarledger.sources import snapshot
from jarledger.sources.manifest import Manifest
from jarledger.streaming.update_log import UpdateLog


def test_one_of_two_writers_gets_a_version(spark):
    root = tempfile.mkdtemp(prefix="commits-")
    a, b = Manifest(spark, root), Manifest(spark, root)
    assert a.latest() is None
    assert a.commit(1, {"who": "a"}) and not b.commit(1, {"who": "b"}) and b.commit(2, {"who": "b"})
    assert a.versions() == [1, 2] and a.entry(1) == {"who": "a"} and b.latest() == (2, {"who": "b"})


def test_snapshot_tables_are_of_one_complete_load(spark):
    root = tempfile.mkdtemp(prefix="snapshots-")
    table = lambda n: spark.range(n).toDF("id")
    assert snapshot.read_tables(spark, root) is None and snapshot.latest_version(spark, root) is None
    assert snapshot.ledger_snapshot(table(3), table(5), root) == 1
    broken = table(7).selectExpr("if(id > 3, raise_error('lost'), id) AS id")
    with pytest.raises(PySparkException):
        snapshot.ledger_snapshot(table(9), broken, root)       # boxes are written, transactions are not
    got = snapshot.read_tables(spark, root)
    assert {k: v.count() for k, v in got.items()} == {"user_boxes": 3, "transactions": 5}
    assert snapshot.ledger_snapshot(table(4), table(6), root) == 2
    assert snapshot.read_tables(spark, root, 1)["transactions"].count() == 5
    assert snapshot.read_snapshot(spark, root, "transactions").count() == 6


def test_a_read_error_is_not_taken_for_no_snapshot(spark):
    root = tempfile.mkdtemp(prefix="snapshots-")
    snapshot.ledger_snapshot(spark.range(1).toDF("id"), spark.range(1).toDF("id"), root)
    with open(f"{root}/_manifest/000000000002.json", "w") as f:
        f.write("{")
    with pytest.raises(ValueError):
        snapshot.read_tables(spark, root)


def test_update_log_opens_few_files_after_many_batches(spark):
    root, rng, want = tempfile.mkdtemp(prefix="updates-"), random.Random(1), {}
    schema = spark.createDataFrame([], "k long, v string").schema
    log = UpdateLog(spark, root, ["k"], schema, fan=4)
    assert log.latest().count() == 0
    for batch in range(70):
        rows = [(k, f"{batch}") for k in rng.sample(range(12), 3)]
        want.update(rows)
        df = spark.createDataFrame(rows, schema).coalesce(1)
        assert log.append(df, batch) and not log.append(df, batch)
    runs = log.state()[1]["runs"]
    assert len(runs) <= 3 * 4 and max(r["level"] for r in runs) == 3
    assert {r["k"]: r["v"] for r in log.latest().collect()} == want
    again = UpdateLog(spark, root, ["k"], schema, fan=4)
    assert not again.append(df, 69) and {r["k"]: r["v"] for r in again.latest().collect()} == want


def test_update_log_tells_writers_apart(spark, monkeypatch):
    root = tempfile.mkdtemp(prefix="updates-")
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    log = UpdateLog(spark, root, ["k"], df.schema)
    monkeypatch.setattr(log, "state", lambda: (0, {"batch": -1, "runs": [], "dead": []}))
    assert log.append(df, 0)
    with pytest.raises(RuntimeError):
        log.append(df, 1)       # another version 1 has been made meanwhile
