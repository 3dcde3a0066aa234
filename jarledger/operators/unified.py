"""One ordered log of all that happens to boxes: money, cross-outs, deletions, box deletion.

``log(op_id, ts, box_id, op, amount, arg)``, replayed per box in (ts, op_id)
order; ``arg`` is a cell for ``crossout`` and an op_id for ``delete_tx``:

* add, withdraw, reset: as in the guarded replay (O37);
* crossout: an index the box has not crossed is appended to its array, and if
  the template's grid has a value above 0 there, posts that money;
* delete_tx: takes back what the named op posted (an add, a cross-out, or a
  withdrawal that was not refused), once and only after it, whatever box the
  log names: the balance of the posted row's box becomes max(0, balance - amount);
* delete_box: the box and its rows go, later ops on it are refused.

All but the withdrawals' guard is settled beforehand by joins and aggregates
on (box, index), (target) and (box): which cross-out of a cell is the first,
which deletion of a row, where a box ends.  What is left is one guarded log.
Only whether a deleted withdrawal had been refused depends on balances.  Such
a deletion adds the money back or does nothing, so the log is replayed
with all of them posted, and boxes where that was wrong are replayed again with
what was found, until nothing changes: causes come before effects, so each
round settles at least the first wrong one of every box that is replayed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jarledger.functions.money import money, money_out
from jarledger.operators.replay import first_crossings, replay_steps
from jarledger.session import shared_dir

def _key() -> Column:
    return F.struct("ts", "op_id")


def _settled(log: DataFrame, boxes: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The guarded log ``(op_id, ts, box_id, op, amount, target, depends)``, and ``(box_id, crossed, ends)`` of every box."""
    b = boxes.select(F.col("id").alias("box_id"), "template_id", F.coalesce("crossed_out_indices", F.array().cast("array<int>")).alias("crossed"))
    ends = log.where("op = 'delete_box'").groupBy("box_id").agg(F.min(_key()).alias("ends"))
    known = log.join(b.select("box_id").hint("merge"), "box_id", "left_semi")   # no table of boxes or grids is broadcast, see crossout_apply
    live = known.join(ends, "box_id", "left").where(F.col("ends").isNull() | (_key() < F.col("ends"))).drop("ends")

    cross = live.where("op = 'crossout'").withColumn("idx", F.col("arg").cast("int")).where("idx is not null")
    uses = b.groupBy("box_id").agg(F.first("template_id").alias("template_id"))
    first = first_crossings(cross, b, _key()).join(uses.hint("merge"), "box_id")
    grid = templates.select(F.col("id").alias("template_id"), F.col("grid_config").alias("grid"))
    cell = F.when((F.col("idx") >= 0) & (F.col("idx") < F.size("grid")), F.get(F.col("grid"), F.col("idx")))
    crossed = first.join(grid.hint("merge"), "template_id", "left").select(
        "box_id", "idx", F.col("first.ts").alias("ts"), F.col("first.op_id").alias("op_id"), cell.alias("value"))
    money_in = crossed.where("value > 0").select("op_id", "ts", "box_id", F.lit("add").alias("op"), money("value").alias("amount"))

    plain = live.where(F.col("op").isin("add", "withdraw", "reset")).select("op_id", "ts", "box_id", "op", "amount")
    moves = plain.unionByName(money_in)
    posts = moves.where("op <> 'reset' and amount is not null and amount <> 0").select(
        F.col("op_id").alias("target"), F.col("box_id").alias("owner"), F.col("ts").alias("posted"), F.col("op").alias("kind"), F.abs("amount").alias("size"))
    asked = log.where("op = 'delete_tx'").select("op_id", "ts", F.col("arg").cast("bigint").alias("target")).where("target is not null")
    asked = asked.join(posts, "target").where(_key() > F.struct("posted", "target"))
    asked = asked.join(ends.withColumnRenamed("box_id", "owner"), "owner", "left").where(F.col("ends").isNull() | (_key() < F.col("ends")))
    once = asked.groupBy("target", "owner", "kind", "size").agg(F.min(_key()).alias("first"))
    undone = once.select(F.col("first.op_id").alias("op_id"), F.col("first.ts").alias("ts"), F.col("owner").alias("box_id"), F.lit("delete_tx").alias("op"),
                         money(F.when(F.col("kind") == "withdraw", -F.col("size")).otherwise(F.col("size"))).alias("amount"),
                         "target", (F.col("kind") == "withdraw").alias("depends"))
    guarded = moves.withColumns({"target": F.lit(None).cast("bigint"), "depends": F.lit(False)}).unionByName(undone)

    added = crossed.groupBy("box_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "op_id", "idx"))), lambda s: s["idx"]).alias("added"))
    state = (b.join(added, "box_id", "left").join(ends, "box_id", "left")
             .select("box_id", F.concat("crossed", F.coalesce("added", F.array().cast("array<int>"))).alias("crossed"), F.col("ends").isNotNull().alias("deleted")))
    return guarded, state


def unified_replay(log: DataFrame, boxes: DataFrame, templates: DataFrame, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``(box_id, balance, n_applied, crossed_out_indices, deleted)`` of every box (balance and array null once it is
    deleted), and the rows left, ``(op_id, box_id, amount)``."""
    spark = log.sparkSession
    shared_dir(spark, "replay")     # makes sure a checkpoint folder is set
    guarded, state = _settled(log, boxes, templates)
    guarded = guarded.checkpoint(eager=True)
    opening = boxes.select(F.col("id").alias("box_id"), F.col("current_amount").alias("balance"))
    active = opening.join(guarded.select("box_id").distinct(), "box_id", "left_semi")

    def replayed(rows: DataFrame, start: DataFrame, refused: DataFrame | None) -> DataFrame:
        """Steps of some boxes; a deletion of a withdrawal in ``refused`` does nothing."""
        if refused is not None:
            rows = rows.join(refused.select(F.col("op_id").alias("target"), F.lit(True).alias("none")), "target", "left").withColumn(
                "op", F.when(F.col("none"), F.lit("nothing")).otherwise(F.col("op")))
        return replay_steps(rows.select("op_id", "ts", "box_id", "op", "amount"), start, partitions).checkpoint(eager=True)

    asked = guarded.where("depends").select(F.col("target").alias("op_id"), "box_id")
    steps = replayed(guarded, active, None)
    held = None     # withdrawals that were refused, as the last round assumed
    while True:
        refused = steps.where("not applied").join(asked.select("op_id"), "op_id", "left_semi").select("op_id", "box_id").checkpoint(eager=True)
        if held is None:
            changed = refused.select("box_id").distinct()
        else:
            changed = (refused.join(held, "op_id", "left_anti").unionByName(held.join(refused, "op_id", "left_anti"))).select("box_id").distinct()
        changed = changed.checkpoint(eager=True)
        if changed.isEmpty():
            break
        again = replayed(guarded.join(changed, "box_id", "left_semi"), active.join(changed, "box_id", "left_semi"), refused)
        steps = steps.join(changed, "box_id", "left_anti").unionByName(again).checkpoint(eager=True)
        held = refused

    keyed = steps.join(guarded.select("op_id", "ts", "op", "amount", "target"), "op_id")
    last = keyed.groupBy("box_id").agg(F.max_by("balance", _key()).alias("balance"), F.count(F.when(F.col("applied") & (
        F.col("op") != "nothing"), 1)).alias("n_applied"))
    out = (state.join(opening, "box_id").withColumnRenamed("balance", "start").join(last, "box_id", "left")
           .select("box_id", F.when(~F.col("deleted"), money_out(F.coalesce("balance", "start"))).alias("balance"),
                   F.coalesce("n_applied", F.lit(0).cast("bigint")).alias("n_applied"),
                   F.when(~F.col("deleted"), F.col("crossed")).alias("crossed_out_indices"), "deleted"))
    posted = keyed.where("applied and op in ('add', 'withdraw')")
    gone = keyed.where("op = 'delete_tx' and applied").select(F.col("target").alias("op_id"))
    left = (posted.join(gone, "op_id", "left_anti").join(state.where("not deleted").select("box_id"), "box_id", "left_semi")
            .select("op_id", "box_id", money(F.when(F.col("op") == "withdraw", -F.abs("amount")).otherwise(F.abs("amount"))).alias("amount")))
    return out, left
