"""Registered queries: key -> callable(spark, sf_dir) -> DataFrame.

All run on binding E (FIXTURES.md) over the whole driver tables; keys are the
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jarledger.operators import aggregates as agg
from jarledger.operators import feed, filters, history, joins, replay, series, sets
from jarledger.session import ensure_conf, shared_dir
from jarledger.sources import derived, queue_dump, seed, signup, snapshot
from jarledger.sources.bind import _read, bind_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(key: str):
    """Register a query; it applies the session settings the ledger assumes
    (UTC days, AQE) before building its plan."""
    def deco(fn: Query) -> Query:
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_conf(spark)
            return fn(spark, sf_dir)
        QUERIES[key] = run
        return fn
    return deco


# ------------------------------------------------------------ sources / sinks

@register("ledger_scan")
def q_ledger_scan(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    tx = L.transactions.join(L.user_boxes.select(F.col("id").alias("box_id")), "box_id", "left_semi")
    return tx.orderBy(F.col("date").desc(), F.col("id").desc())


@register("op_log_ingest")
def q_op_log_ingest(spark, sf_dir):
    return queue_dump.op_log_ingest(queue_dump.dumps_from_events(_read(spark, sf_dir, "events")))


@register("ledger_snapshot")
def q_ledger_snapshot(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    root = shared_dir(spark, "snapshots")
    snapshot.ledger_snapshot(L.user_boxes, L.transactions, root)
    return snapshot.read_snapshot(spark, root, "transactions")


@register("ledger_snapshot_torn")
def q_ledger_snapshot_torn(spark, sf_dir):
    """O04 where a later load was lost after its boxes: both tables of the last complete one."""
    L = bind_events(spark, sf_dir)
    root = shared_dir(spark, "snapshots")
    snapshot.ledger_snapshot(L.user_boxes, L.transactions, root)
    L.user_boxes.where("not is_archived").write.parquet(f"{root}/load-lost/user_boxes")     # never committed
    got = snapshot.read_tables(spark, root)
    return (got["user_boxes"].select(F.lit("box").alias("kind"), "id", F.col("current_amount").alias("amount"))
            .unionByName(got["transactions"].select(F.lit("tx").alias("kind"), "id", "amount")))


@register("template_seed")
def q_template_seed(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    seeds = seed.seed_templates(spark)
    once = seed.template_seed(L.box_templates, seeds.where("id = -1000"))
    t = seed.template_seed(once, seeds)     # one is there already, one is new
    return t.select("id", "name", "total_amount", "currency",
                    F.size("grid_config").cast("bigint").alias("cells"),
                    F.aggregate("grid_config", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("grid_sum"))


@register("profile_provision")
def q_profile_provision(spark, sf_dir):
    return signup.profile_provision(derived.signup_rows(spark, sf_dir))


# ------------------------------------------------------------ filters

@register("active_boxes")
def q_active_boxes(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return filters.active_boxes(L.user_boxes).select("id", "user_id", "name", "currency", "current_amount")


@register("archived_boxes")
def q_archived_boxes(spark, sf_dir):
    return filters.archived_boxes(bind_events(spark, sf_dir).user_boxes)


@register("owner_boxes")
def q_owner_boxes(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return filters.owner_boxes(L.user_boxes, derived.uah_home_users(L.profiles)) \
        .select("id", "user_id", "name", "current_amount")


@register("box_transactions")
def q_box_transactions(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    goals = L.user_boxes.where(F.col("target_amount") > 0)
    return filters.box_transactions(L.transactions, goals)


@register("tx_validate")
def q_tx_validate(spark, sf_dir):
    return filters.tx_checked(bind_events(spark, sf_dir).transactions)


@register("tx_validate_rejects")
def q_tx_validate_rejects(spark, sf_dir):
    """O11 over rows with missing boxes, missing amounts and zero amounts."""
    return filters.tx_checked(derived.broken_transactions(bind_events(spark, sf_dir).transactions))


@register("entry_validate")
def q_entry_validate(spark, sf_dir):
    return filters.entry_validate(derived.typed_entries(_read(spark, sf_dir, "events")))


@register("box_normalise")
def q_box_normalise(spark, sf_dir):
    b = filters.box_normalise(derived.create_requests(spark, sf_dir))
    return b.select("request_id", "user_id", "name", "currency", "current_amount", "target_amount",
                    "is_archived", F.size("crossed_out_indices").cast("bigint").alias("crossed_cells"))


# ------------------------------------------------------------ joins

@register("boxes_with_template")
def q_boxes_with_template(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    j = joins.boxes_with_template(L.user_boxes, L.box_templates)
    return j.select("id", "template_id", "name", "created_at", "template_name", "template_total",
                    "template_currency", F.array_join("template_grid", ",").alias("template_grid"))


@register("tx_owner_scope")
def q_tx_owner_scope(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return joins.tx_owner_scope(L.transactions, L.user_boxes, derived.uah_home_users(L.profiles))


@register("box_home_equivalent")
def q_box_home_equivalent(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return joins.box_home_equivalent(L.user_boxes, L.profiles, L.rates)


@register("cascade_delete")
def q_cascade_delete(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    users = L.profiles.where(F.col("home_currency").isNull()).select("id")
    archived = L.user_boxes.where("is_archived").select("id")
    _, _, tx = joins.cascade_delete(L.profiles, L.user_boxes, L.transactions, users=users, box_ids=archived)
    return tx.select("id", "box_id", "amount")


@register("fk_violations")
def q_fk_violations(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return joins.fk_violations(L.profiles, L.box_templates, L.user_boxes, L.transactions)


@register("cascade_delete_boxes")
def q_cascade_delete_boxes(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    users = L.profiles.where(F.col("home_currency").isNull()).select("id")
    archived = L.user_boxes.where("is_archived").select("id")
    _, boxes, _ = joins.cascade_delete(L.profiles, L.user_boxes, L.transactions, users=users, box_ids=archived)
    return boxes.select("id", "user_id", "name")


@register("cascade_delete_profiles")
def q_cascade_delete_profiles(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    users = L.profiles.where(F.col("home_currency").isNull()).select("id")
    profiles, _, _ = joins.cascade_delete(L.profiles, L.user_boxes, L.transactions, users=users)
    return profiles.select("id", "full_name", "home_currency")


@register("fk_violations_orphans")
def q_fk_violations_orphans(spark, sf_dir):
    """O17 where parents are gone without their children: users without a home
    currency, templates below 1000, archived boxes."""
    L = bind_events(spark, sf_dir)
    boxes = filters.active_boxes(L.user_boxes)
    return joins.fk_violations(L.profiles.where(F.col("home_currency").isNotNull()),
                               L.box_templates.where(F.col("total_amount") >= 1000), boxes, L.transactions)


@register("ledger_reconcile_orphans")
def q_ledger_reconcile_orphans(spark, sf_dir):
    """O24 where archived boxes are gone but their transactions are not."""
    L = bind_events(spark, sf_dir)
    return agg.ledger_reconcile(filters.active_boxes(L.user_boxes), L.transactions)


@register("boxes_without_activity")
def q_boxes_without_activity(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return joins.boxes_without_activity(L.user_boxes, L.transactions)


# ------------------------------------------------------------ aggregates

@register("balance_fold")
def q_balance_fold(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    inserted = L.transactions.where(F.to_date("date") > F.lit(L.as_of))
    return agg.balance_fold(L.user_boxes, inserted)


@register("goal_progress")
def q_goal_progress(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return agg.goal_progress(L.user_boxes, L.box_templates)


@register("grid_fill")
def q_grid_fill(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return agg.grid_fill(L.user_boxes, L.box_templates)


@register("net_saved_month")
def q_net_saved_month(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return agg.net_saved_month(L.transactions, L.user_boxes, as_of=L.as_of)


@register("net_saved_month_by_currency")
def q_net_saved_month_by_currency(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return agg.net_saved_month_by_currency(L.transactions, L.user_boxes, as_of=L.as_of)


@register("ledger_reconcile")
def q_ledger_reconcile(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return agg.ledger_reconcile(L.user_boxes, L.transactions)


# ------------------------------------------------------------ series

@register("balance_week")
def q_balance_week(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.balance_week(L.transactions, L.user_boxes, as_of=L.as_of)


@register("balance_month")
def q_balance_month(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.balance_month(L.transactions, L.user_boxes, as_of=L.as_of)


@register("balance_all")
def q_balance_all(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.balance_all(L.transactions, L.user_boxes, as_of=L.as_of)


@register("chart_scale")
def q_chart_scale(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.week_scale(L.transactions, L.user_boxes, as_of=L.as_of)


@register("axis_labels")
def q_axis_labels(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.axis_labels(series.balance_all(L.transactions, L.user_boxes, as_of=L.as_of), 5)


@register("axis_labels_month")
def q_axis_labels_month(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.axis_labels(series.balance_month(L.transactions, L.user_boxes, as_of=L.as_of), 6)


@register("series_normalised")
def q_series_normalised(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return series.week_normalised(L.transactions, L.user_boxes, as_of=L.as_of)


# ------------------------------------------------------------ top-k, sets

@register("recent_activity")
def q_recent_activity(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return history.recent_activity(L.transactions, L.user_boxes)


@register("archive_history")
def q_archive_history(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return history.archive_history(L.transactions, L.user_boxes)


@register("first_activity")
def q_first_activity(spark, sf_dir):
    return sets.first_activity(bind_events(spark, sf_dir).transactions)


@register("active_days")
def q_active_days(spark, sf_dir):
    return sets.active_days(bind_events(spark, sf_dir).transactions)


@register("pending_union")
def q_pending_union(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return sets.pending_union(L.transactions, L.op_log)


# ------------------------------------------------------------ replay

@register("op_signing")
def q_op_signing(spark, sf_dir):
    return replay.op_signing(bind_events(spark, sf_dir).op_log)


@register("drain_until_failure")
def q_drain_until_failure(spark, sf_dir):
    q = replay.drain_until_failure(bind_events(spark, sf_dir).op_log)
    return q.select("op_id", "device", "posted")


@register("ordered_replay")
def q_ordered_replay(spark, sf_dir):
    return replay.ordered_replay(bind_events(spark, sf_dir).op_log)


@register("ordered_replay_ranges")
def q_ordered_replay_ranges(spark, sf_dir):
    """O37 in 48 ranges, so that boxes span ranges at every size."""
    return replay.ordered_replay(bind_events(spark, sf_dir).op_log, partitions=48)


@register("replay_steps")
def q_replay_steps(spark, sf_dir):
    return replay.replay_steps(bind_events(spark, sf_dir).op_log)


@register("box_attribute_merge")
def q_box_attribute_merge(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    ops = derived.attribute_ops(_read(spark, sf_dir, "events"))
    return replay.box_attribute_merge(L.user_boxes, ops)


@register("profile_edit")
def q_profile_edit(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return replay.profile_edit(L.profiles, derived.profile_edits(_read(spark, sf_dir, "events")))


@register("box_from_template")
def q_box_from_template(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    return replay.box_from_template(derived.template_requests(spark, sf_dir), L.box_templates)


@register("crossout_apply")
def q_crossout_apply(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    _, tx = replay.crossout_apply(L.user_boxes, L.box_templates,
                                  derived.crossout_requests(_read(spark, sf_dir, "events")))
    return tx


@register("crossout_indices")
def q_crossout_indices(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    arrays, _ = replay.crossout_apply(L.user_boxes, L.box_templates,
                                      derived.crossout_requests(_read(spark, sf_dir, "events")))
    return arrays.select("box_id", F.array_join("crossed_out_indices", ",").alias("crossed_out_indices"),
                         "n_added")


@register("tx_delete_apply")
def q_tx_delete_apply(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    bal, _ = replay.tx_delete_apply(L.user_boxes, L.transactions,
                                    derived.delete_requests(_read(spark, sf_dir, "events")))
    return bal


@register("tx_delete_remaining")
def q_tx_delete_remaining(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    _, left = replay.tx_delete_apply(L.user_boxes, L.transactions,
                                     derived.delete_requests(_read(spark, sf_dir, "events")))
    return left.select("id", "box_id", "amount")


# ------------------------------------------------------------ feed

@register("activity_feed")
def q_activity_feed(spark, sf_dir):
    L = bind_events(spark, sf_dir)
    recent = history.recent_activity(L.transactions, L.user_boxes)
    return feed.activity_feed(recent, L.user_boxes, L.profiles, as_of=L.as_of)


# ------------------------------------------------------------ streaming

@register("stream_balance_fold")
def q_stream_balance_fold(spark, sf_dir):
    from jarledger.streaming.ledger_streams import run_stream_balance_fold
    return run_stream_balance_fold(spark, sf_dir)


@register("stream_ordered_replay")
def q_stream_ordered_replay(spark, sf_dir):
    from jarledger.streaming.ledger_streams import run_stream_ordered_replay
    return run_stream_ordered_replay(spark, sf_dir)


@register("stream_daily_net")
def q_stream_daily_net(spark, sf_dir):
    from jarledger.streaming.ledger_streams import run_stream_daily_net
    return run_stream_daily_net(spark, sf_dir)


# ------------------------------------------------------------ composite views

@register("home_cards")
def q_home_cards(spark, sf_dir):
    from jarledger.plans.views import home_cards
    L = bind_events(spark, sf_dir)
    return home_cards(L.user_boxes, L.box_templates, L.transactions, L.profiles, L.rates, as_of=L.as_of)


@register("drain_and_fold")
def q_drain_and_fold(spark, sf_dir):
    from jarledger.plans.views import drain_and_fold
    return drain_and_fold(bind_events(spark, sf_dir).op_log)


# ------------------------------------------------------------ queues, one log of everything

@register("queue_drain_rounds")
def q_queue_drain_rounds(spark, sf_dir):
    from jarledger.operators.queue import drain_rounds
    events = _read(spark, sf_dir, "events")
    return drain_rounds(derived.queue_items(events), derived.device_fetches(events))


@register("stream_queue_drain")
def q_stream_queue_drain(spark, sf_dir):
    from jarledger.streaming.device_streams import run_stream_queue_drain
    return run_stream_queue_drain(spark, sf_dir)


@register("stream_profile_provision")
def q_stream_profile_provision(spark, sf_dir):
    from jarledger.streaming.device_streams import run_stream_provision
    return run_stream_provision(spark, sf_dir)


def _unified(spark, sf_dir):
    from jarledger.operators.unified import unified_replay
    L = bind_events(spark, sf_dir)
    return unified_replay(derived.unified_log(_read(spark, sf_dir, "events")), L.user_boxes, L.box_templates)


@register("unified_replay")
def q_unified_replay(spark, sf_dir):
    boxes, _ = _unified(spark, sf_dir)
    return boxes.withColumn("crossed_out_indices", F.array_join("crossed_out_indices", ","))


@register("unified_replay_rows")
def q_unified_replay_rows(spark, sf_dir):
    return _unified(spark, sf_dir)[1]


@register("open_home")
def q_open_home(spark, sf_dir):
    from jarledger.plans.views import open_home
    L, events = bind_events(spark, sf_dir), _read(spark, sf_dir, "events")
    return open_home(L.user_boxes, L.box_templates, L.transactions, L.profiles, L.rates, derived.queue_money(events),
                     derived.device_fetches(events), as_of=L.as_of)


# ------------------------------------------------------------ storage by month

@register("net_saved_month_stored")
def q_net_saved_month_stored(spark, sf_dir):
    """O23 from storage partitioned by month: only months from as_of's on are read."""
    from jarledger.sources import monthly
    L = bind_events(spark, sf_dir)
    stored = monthly.store_by_month(L.transactions, shared_dir(spark, "monthly"))
    return agg.net_saved_month(monthly.since(stored, L.as_of.replace(day=1)), L.user_boxes, as_of=L.as_of)


@register("net_of_months")
def q_net_of_months(spark, sf_dir):
    """Net per box of the months in which archived boxes were made."""
    from jarledger.sources import monthly
    L = bind_events(spark, sf_dir)
    stored = monthly.store_by_month(L.transactions, shared_dir(spark, "monthly"))
    return monthly.net_of_months(stored, L.user_boxes.where("is_archived").select(monthly.month_of(F.col("created_at")).alias("month")))


# ------------------------------------------------------------ SQL

def _sql(key: str, text: str):
    @register(key)
    def query(spark, sf_dir):
        from jarledger.plans.sql_surface import register as register_sql
        L = bind_events(spark, sf_dir)
        register_sql(spark, L)
        return spark.sql(text.format(as_of=f"DATE '{L.as_of}'"))


_sql("sql_balance_week", "SELECT * FROM balance_week({as_of})")
_sql("sql_balance_month", "SELECT * FROM balance_month({as_of})")
_sql("sql_net_saved_month", "SELECT * FROM net_saved_month({as_of})")
_sql("sql_recent_activity", "SELECT * FROM box_history(10, false)")
_sql("sql_archive_history", "SELECT * FROM box_history(15, true)")
_sql("sql_ledger_reconcile", "SELECT * FROM ledger_reconcile()")
