"""Golden cases for dimension joins and goal arithmetic."""

from decimal import Decimal as D

from pyspark.sql import functions as F

from jarledger.operators import aggregates as agg
from jarledger.operators import joins
from jarledger.sources import seed
from jarledger.sources.rates import rates_load
from tests.frames import boxes, profiles, templates, tx, ts


def test_g7_stored_zero_target_means_no_goal(spark):
    t = templates(spark, [(7, "tpl", 1000, "UAH", [5, 10])])
    b = boxes(spark, [{"id": 1, "template_id": 7, "target_amount": 0, "current_amount": 1200}])
    r = agg.goal_progress(b, t).first()
    assert (r["target"], r["progress"], r["is_full"], r["percent"]) == (D("0.00"), 0.0, False, 0)


def test_g8_null_target_falls_back_to_template(spark):
    t = templates(spark, [(7, "tpl", 1000, "UAH", [5, 10])])
    b = boxes(spark, [{"id": 1, "template_id": 7, "current_amount": 1200}])
    r = agg.goal_progress(b, t).first()
    assert (r["target"], r["progress"], r["is_full"], r["percent"]) == (D("1000.00"), 1.0, True, 100)


def test_percent_rounds_half_up(spark):
    b = boxes(spark, [{"id": 1, "target_amount": 200, "current_amount": 25},
                      {"id": 2, "target_amount": 400, "current_amount": 2}])
    got = {r["box_id"]: r["percent"] for r in agg.goal_progress(b, templates(spark, [])).collect()}
    assert got == {1: 13, 2: 1}  # 12.5 -> 13, 0.5 -> 1


def test_g14_seed_grids_do_not_add_up_to_totals(spark):
    t = seed.seed_templates(spark)
    b = boxes(spark, [{"id": 1, "template_id": -1000, "crossed_out_indices": [0, 3, 3, 99, -1]},
                      {"id": 2, "template_id": -5000}])
    got = {r["box_id"]: r.asDict() for r in agg.grid_fill(b, t).collect()}
    assert (got[1]["cells"], got[1]["grid_sum"], got[1]["template_total"]) == (22, 1010, 1000)
    assert (got[1]["crossed_cells"], got[1]["crossed_sum"], got[1]["remaining_sum"]) == (2, 55, 955)
    assert (got[2]["cells"], got[2]["grid_sum"], got[2]["template_total"]) == (17, 4400, 5000)


def test_template_seed_keeps_existing_rows(spark):
    existing = templates(spark, [(-1000, "mine", 1, "EUR", [1])])
    out = {r["id"]: r["name"] for r in seed.template_seed(existing, seed.seed_templates(spark)).collect()}
    assert out == {-1000: "mine", -5000: "Скарбничка 5000 грн"}


def _feeds(spark, uah_rows, cross_rows):
    u = spark.createDataFrame(uah_rows, "pos BIGINT, cc STRING, rate DOUBLE")
    c = spark.createDataFrame(cross_rows, "base STRING, quote STRING, rate DOUBLE")
    return rates_load(u, c)


def test_g15_home_currency_conversion(spark):
    rates = _feeds(spark, [(0, "EUR", 45.0), (1, "USD", 41.5), (2, "GBP", 52.5)],
                   [("EUR", "USD", 1.08), ("EUR", "GBP", 0.86)])
    p = profiles(spark, [(1, "a", "a@x", "UAH", "en"), (2, "b", "b@x", "EUR", "en"), (3, "c", "c@x", None, "en")])
    b = boxes(spark, [{"id": 10, "user_id": 1, "currency": "EUR", "current_amount": 2},
                      {"id": 11, "user_id": 1, "currency": None, "current_amount": 3},
                      {"id": 20, "user_id": 2, "currency": "usd", "current_amount": 108},
                      {"id": 21, "user_id": 2, "currency": "PLN", "current_amount": 5},
                      {"id": 30, "user_id": 3, "currency": "USD", "current_amount": 5}])
    got = {r["box_id"]: (r["home_equivalent"], r["shown"])
           for r in joins.box_home_equivalent(b, p, rates).collect()}
    assert abs(got[10][0] - 90.0) < 1e-9 and got[10][1]
    assert abs(got[11][0] - 135.0) < 1e-9
    assert abs(got[20][0] - 100.0) < 1e-9 and got[20][1]
    assert got[21] == (None, False)
    assert got[30] == (None, False)



def test_g15_rates_beyond_the_broadcast_bound(spark):
    """Under the default row bound the counted rate table is broadcast; with
    the bound at 0 it is joined by shuffle, with the same answer."""
    rates = _feeds(spark, [(0, "EUR", 45.0), (1, "USD", 41.5), (2, "GBP", 52.5)],
                   [("EUR", "USD", 1.08)])
    p = profiles(spark, [(1, "a", "a@x", "UAH", "en"), (2, "b", "b@x", "EUR", "en")])
    b = boxes(spark, [{"id": 10, "user_id": 1, "currency": "EUR", "current_amount": 2},
                      {"id": 20, "user_id": 2, "currency": "usd", "current_amount": 108}])
    under = joins.box_home_equivalent(b, p, rates)
    assert "BroadcastExchange" in under._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("jarledger.rates.broadcastRows", "0")
    try:
        j = joins.box_home_equivalent(b, p, rates)
        assert "BroadcastExchange" not in j._jdf.queryExecution().executedPlan().toString()
        got = {r["box_id"]: r["home_equivalent"] for r in j.collect()}
    finally:
        spark.conf.unset("jarledger.rates.broadcastRows")
    assert abs(got[10] - 90.0) < 1e-9 and abs(got[20] - 100.0) < 1e-9

def test_g15_uah_feed_without_eur_drops_uah_rates(spark):
    rates = _feeds(spark, [(0, "USD", 41.5), (1, "GBP", 52.5), (2, "", 9.0), (3, "XXX", -1.0)],
                   [("EUR", "USD", 1.08), ("EUR", "GBP", 0.86)])
    by_base = {}
    for r in rates.collect():
        by_base.setdefault(r["base"], {})[r["quote"]] = r["rate"]
    assert "UAH" not in by_base                       # base UAH: all three or nothing
    assert "UAH" not in by_base["EUR"]                # no EUR item in the UAH feed
    assert by_base["USD"]["UAH"] == 41.5 and by_base["USD"]["USD"] == 1.0
    p = profiles(spark, [(2, "b", "b@x", "EUR", "en")])
    b = boxes(spark, [{"id": 20, "user_id": 2, "currency": "UAH", "current_amount": 90}])
    assert joins.box_home_equivalent(b, p, rates).first()["home_equivalent"] is None


def test_uah_feed_last_item_wins(spark):
    rates = _feeds(spark, [(0, "EUR", 40.0), (1, "USD", 41.5), (2, "GBP", 52.5), (3, "EUR", 50.0)], [])
    r = rates.where((F.col("base") == "UAH") & (F.col("quote") == "EUR")).first()
    assert r["rate"] == 1 / 50.0


def test_cascade_delete_and_fk(spark):
    p = profiles(spark, [(1, "a", "a@x", None, "en"), (2, "b", "b@x", None, "en")])
    b = boxes(spark, [{"id": 10, "user_id": 1}, {"id": 20, "user_id": 2}, {"id": 21, "user_id": 2},
                      {"id": 30, "user_id": 3}])
    t = tx(spark, [(1, 10, 5, None, ts(0)), (2, 20, 5, None, ts(0)), (3, 21, 5, None, ts(0)),
                   (4, 99, 5, None, ts(0))])
    users = spark.createDataFrame([(1,)], "id BIGINT")
    ids = spark.createDataFrame([(21,)], "id BIGINT")
    p2, b2, t2 = joins.cascade_delete(p, b, t, users=users, box_ids=ids)
    assert sorted(r["id"] for r in p2.collect()) == [2]
    assert sorted(r["id"] for r in b2.collect()) == [20, 30]
    assert sorted(r["id"] for r in t2.collect()) == [2, 4]
    fk = {(r["kind"], r["child_id"]) for r in joins.fk_violations(p, templates(spark, []), b, t).collect()}
    assert fk == {("box_profile", 30), ("tx_box", 4)}


def test_reconcile_reports_drift_and_orphans(spark):
    b = boxes(spark, [{"id": 1, "current_amount": 0}, {"id": 2, "current_amount": 50}])
    t = tx(spark, [(1, 1, 30, None, ts(0)), (2, 9, 4, None, ts(0))])
    got = {r["box_id"]: (r["stored"], r["tx_sum"], r["drift"], r["opening"])
           for r in agg.ledger_reconcile(b, t).collect()}
    assert got[1] == (D("0.00"), D("30.00"), D("-30.00"), D("0.00"))
    assert got[2] == (D("50.00"), D("0.00"), D("50.00"), D("50.00"))
    assert got[9] == (None, D("4.00"), None, D("0.00"))


def test_history_limits_before_the_shuffle(spark):
    """Without broadcasts a box ships its newest rows of each task, not all: the partial limit stands below the exchange."""
    from jarledger.operators.history import recent_activity
    from jarledger.sources.bind import bind_events
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        L = bind_events(spark, "/root/testdata/sf0.001")
        plan = recent_activity(L.transactions, L.user_boxes)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    final, partial = plan.index("Final"), plan.index("Partial")
    assert final < plan.index("Exchange", final) < partial
