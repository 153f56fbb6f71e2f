"""One mixed log of order changes, replayed in order (O3, O5, O6, O7 together).

The batches of :mod:`kipmart.operators.changes` judge each kind of request
against the tables before the batch. Here cancels, status changes, quantity
edits and line deletes of one order meet in ``seq`` order, as they do when
requests are handled one at a time: a cancel is applied only while the order is
``pending`` at that moment, it puts back the quantities that the lines have then,
a delete puts back its line's quantity of then, and totals are those of the lines
at the last edit or delete that named the order.

* *Status.* Every event is a map of (pending or not): a cancel makes ``cancelled``
  of pending and changes nothing else, a status change makes its own of both. The
  maps are composed along each order inside range-sorted parts and over their
  borders (:mod:`kipmart.plans.scan`), so an order with a third of all events is
  no task's own. An event took effect if the composed map names it.
* *Lines.* A line ends at its first delete. Its quantity at a moment (a cancel, its
  delete, its order's last edit or delete) is an as-of join with the edits.

``seq`` is unique in the log. Orders and lines may carry ``since``: the ``seq`` that
placed them (missing or null: before the log); earlier events don't find them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.operators.changes import _in_stock, _int, apply_stock, with_defaults
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.scan import Maps, asof_join, local_scan, with_carry
from kipmart.plans.upsert import latest_per_key, merge_update

# What an event makes of a pending order (``p_``) and of another (``o_``): whether it
# is pending then, and the event that made it so (-1: none, it stays as it was).
MAP = ["p_pending", "p_by", "o_pending", "o_by"]
CANCEL, PENDING, OTHER = 1, 2, 3


def _status_maps(kind: np.ndarray, seq: np.ndarray) -> Maps:
    pending = (kind == PENDING) * 1
    return pending, seq, pending, np.where(kind == CANCEL, -1, seq)


def _then(f: Maps, g: Maps) -> Maps:
    """``f`` first, then ``g``."""
    f_p, f_pby, f_o, f_oby = f
    g_p, g_pby, g_o, g_oby = g

    def after(pending, by):
        now = pending == 1
        g_by = np.where(now, g_pby, g_oby)
        return np.where(now, g_p, np.where(g_oby == -1, 0, g_o)), np.where(g_by == -1, by, g_by)
    return (*after(f_p, f_pby), *after(np.where(f_oby == -1, 0, f_o), f_oby))


def _after(prefix: str, pending, by, known):
    """(pending, event that made it so) after the map of these columns."""
    c = {n: F.col(prefix + n) for n in MAP}
    new = F.when(pending, c["p_by"]).otherwise(c["o_by"])
    flag = F.when(pending, c["p_pending"]).otherwise(F.when(c["o_by"] == -1, 0).otherwise(c["o_pending"])) == 1
    return F.when(known, flag).otherwise(pending), F.when(known & (new != -1), new).otherwise(by)


def _since(df: DataFrame) -> DataFrame:
    return with_defaults(df, {"since": ("bigint", None)}).withColumn("since", F.coalesce("since", F.lit(-1).cast("bigint")))


def replay_order_log(T, log: DataFrame) -> dict:
    """Tables after the log: ``orders`` (id, status, items_total, total_amount;
    ``items_total`` is null for orders without an edit or delete), ``items``, ``products``,
    ``moves`` (product_id, delta) and ``rejected`` (seq, op, reason).

    ``log``: seq, op (cancel, status, edit, delete), order_id, item_id, quantity,
    status. As in the reference, an edit or delete recomputes the totals of the order that it
    names, whichever order its line belongs to; a status change of an unknown
    order and an edit of an unknown line find nothing and are not refused."""
    orders = _since(T.orders).select("id", "status", "shipping_fee", "total_amount", "since")
    items = _since(T.items).select("id", "order_id", "product_id", "quantity", "price", "is_preorder", "since")
    op = F.col("op")
    ev = log.select("seq", "op", F.coalesce(_int(F.col("order_id")), F.lit(0)).alias("order_id"),
                    F.coalesce(_int(F.col("item_id")), F.lit(0)).alias("item_id"),
                    _int(F.coalesce("quantity", F.lit(1))).alias("quantity"), "status")
    on_line = (F.col("item_id") == 0) | (F.col("order_id") == 0)
    bad = (F.when((op == "cancel") & (F.col("order_id") == 0), "missing id")
           .when((op == "edit") & (on_line | (F.col("quantity") < 1)), "missing data")
           .when((op == "delete") & on_line, "missing data")
           .when(~F.coalesce(op.isin("cancel", "status", "edit", "delete"), F.lit(False)), "unknown op"))
    judged = ev.withColumn("reason", bad)
    good = judged.filter(F.col("reason").isNull())

    # status of each order along its events
    known = orders.select(F.col("id").alias("order_id"), F.coalesce(F.col("status") == "pending", F.lit(False)).alias("open"),
                          F.lit(True).alias("found"), "since")
    asked = good.filter(op.isin("cancel", "status")).join(known, "order_id", "left")
    here = F.coalesce(F.col("found") & (F.col("since") < F.col("seq")), F.lit(False))
    lost = asked.filter(~here & (op == "cancel")).select("seq", "op", F.lit("not found").alias("reason"))
    kind = F.when(op == "cancel", CANCEL).when(F.col("status") == "pending", PENDING).otherwise(OTHER)
    scanned = local_scan(asked.filter(here).withColumn("__kind", kind), ["order_id"], [F.col("seq")], ["__kind", "seq"],
                         MAP, _status_maps, _then)
    pending, by = _after("__c_", F.col("open"), F.lit(-1).cast("bigint"), F.col("__c_p_by").isNotNull())
    _, by = _after("", pending, by, F.lit(True))
    states = write_temp_table(with_carry(scanned, MAP, _then).select("seq", "op", "order_id", "status", by.alias("by")),
                              "kipmart-states")
    cancels = states.filter((op == "cancel") & (F.col("by") == F.col("seq"))).select("order_id", "seq")
    late = states.filter((op == "cancel") & (F.col("by") != F.col("seq"))).select("seq", "op", F.lit("not pending").alias("reason"))
    last = states.groupBy("order_id").agg(F.max_by("by", "seq").alias("by")).filter("by >= 0")
    named = states.select(F.col("seq").alias("by"), F.when(op == "cancel", "cancelled").otherwise(F.col("status")).alias("__new"))
    new_status = last.join(named, "by").select(F.col("order_id").alias("id"), "__new", F.lit(True).alias("__hit"))

    # lines: ended by the first delete that finds them
    of_line = items.select(F.col("id").alias("item_id"), F.col("since").alias("line_since"))
    deletes = good.filter(op == "delete").join(of_line, "item_id", "left")
    found = F.coalesce(F.col("line_since") < F.col("seq"), F.lit(False))
    ended = write_temp_table(deletes.filter(found).groupBy("item_id").agg(F.min("seq").alias("end_seq")), "kipmart-ended")
    deletes = deletes.join(ended, "item_id", "left").withColumn(
        "__done", found & F.coalesce(F.col("seq") == F.col("end_seq"), F.lit(False)))
    gone = deletes.filter(~F.col("__done")).select("seq", "op", F.lit("not found").alias("reason"))
    touches = good.filter(op == "edit").select("order_id", "seq") \
        .unionByName(deletes.filter("__done").select("order_id", "seq")).groupBy("order_id").agg(F.max("seq").alias("seq"))
    touches = touches.join(known.select("order_id", F.col("since").alias("__s")), "order_id").filter("__s < seq").drop("__s")
    touches = write_temp_table(touches, "kipmart-touches")
    edits = good.filter(op == "edit").select("item_id", F.col("seq").alias("at"), F.col("quantity").alias("q"))
    edits = write_temp_table(edits.join(of_line, "item_id").filter("line_since < at").select("item_id", "at", "q"), "kipmart-edits")

    # quantities at the moments that count: of all lines of an order (cancel, total), and
    # of a line at its own end (delete; ``__end`` 1). Lines without an edit keep theirs.
    marks = ended.withColumn("edited", F.lit(False)).unionByName(
        edits.select("item_id", F.lit(None).cast("bigint").alias("end_seq"), F.lit(True).alias("edited"))) \
        .groupBy("item_id").agg(F.max("end_seq").alias("end_seq"), F.max("edited").alias("edited"))
    back = F.col("end_seq").isNotNull() & _in_stock()
    lines = items.withColumnRenamed("id", "item_id").join(marks, "item_id", "left") \
        .withColumn("__end", F.explode(F.when(back, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    moments = cancels.withColumn("why", F.lit("cancel")).unionByName(touches.withColumn("why", F.lit("total")))
    at_end = F.col("__end") == 1
    asks = lines.join(moments.withColumn("__end", F.lit(0)), ["order_id", "__end"], "left").filter(
        at_end | ((F.col("since") < F.col("seq")) & (F.col("end_seq").isNull() | (F.col("end_seq") > F.col("seq")))))
    edited, total = F.coalesce("edited", F.lit(False)), ~at_end & (F.col("why") == "total")
    asks = write_temp_table(asks.select(
        F.when(at_end, "delete").otherwise(F.col("why")).alias("why"), "quantity",
        F.when(total, F.col("order_id")).alias("order_id"), F.when(total, F.col("price")).alias("price"),
        F.when(~total, F.col("product_id")).alias("product_id"), F.when(edited, F.col("item_id")).alias("item_id"),
        F.when(edited, F.when(at_end, F.col("end_seq")).otherwise(F.col("seq"))).alias("at"), edited.alias("edited")), "kipmart-asks")
    cols = ["why", "order_id", "price", "product_id", "quantity"]
    seen = asof_join(asks.filter("edited").select("item_id", "at", *cols), edits, ["item_id"], ["at"], "edit")
    then = asks.filter("not edited").select(cols).unionByName(
        seen.withColumn("quantity", F.coalesce("edit.q", "quantity")).select(cols))
    moves = then.filter(F.col("why").isin("cancel", "delete")).select("product_id", F.col("quantity").alias("delta"))
    sums = then.filter(F.col("why") == "total").groupBy("order_id").agg(F.sum(F.col("price") * F.col("quantity")).alias("__sum"))
    totals = touches.select("order_id").join(sums, "order_id", "left").select(
        F.col("order_id").alias("id"), _int(F.coalesce("__sum", F.lit(0))).alias("__items"))
    done = orders.join(new_status, "id", "left").join(totals, "id", "left")
    after = done.select(
        "id", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("status")).alias("status"),
        F.col("__items").alias("items_total"),
        F.coalesce((F.col("__items") + _int(F.coalesce("shipping_fee", F.lit(0)))).cast("decimal(15,2)"),
                   F.col("total_amount")).alias("total_amount"))
    left = merge_update(T.items.join(ended.withColumnRenamed("item_id", "id"), "id", "left_anti"), latest_per_key(
        edits.select(F.col("item_id").alias("id"), "at", F.col("q").alias("quantity")), ["id"], seq="at"), ["id"], ["quantity"]) \
        .select("id", "order_id", "product_id", "quantity", "price", "is_preorder")
    rejected = judged.filter(F.col("reason").isNotNull()).select("seq", "op", "reason")
    for part in (lost, late, gone):
        rejected = rejected.unionByName(part)
    return {"orders": after, "items": left, "moves": moves, "products": apply_stock(T.products, moves), "rejected": rejected}
