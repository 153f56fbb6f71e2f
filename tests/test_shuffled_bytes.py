"""Steps that shuffle or write rows no more often than they must."""

import random

from pyspark.sql import functions as F

from kipmart.plans import materialize, scan
from kipmart.sources.tables import InlineShop


def _logical(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_asof_join_reads_its_sorted_rows_without_a_window_over_keys(spark):
    left = spark.createDataFrame([("a", 3, 1)], "k string, t int, seq long")
    out = scan.asof_join(left, spark.createDataFrame([("a", 2, 0, 7)], "k string, t int, seq long, v int"), ["k"], ["t", "seq"], "r")
    windows = [line for line in _logical(out).splitlines() if "Window [" in line and "windowspecdefinition(__pid" in line.replace(" ", "")]
    assert not [w for w in windows if "k#" in w]


def test_asof_join_over_small_batches_and_null_keys(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", "c", None]), rng.randrange(40), i) for i in range(300)]
    marks = [(rng.choice(["a", "b", None]), rng.randrange(40), i) for i in range(60)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = scan.asof_join(spark.createDataFrame(rows, "k string, t int, seq long"),
                             spark.createDataFrame(marks, "k string, t int, seq long"), ["k"], ["t", "seq"], "r").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for k, t, seq in rows:
        before = [(a, s) for x, a, s in marks if x == k and x is not None and a <= t]
        want[seq] = max(before, default=None)
    assert {r.seq: r.r and (r.r.t, r.r.seq) for r in out} == want
    assert sorted((r.k or "", r.t, r.seq) for r in out) == sorted((k or "", t, s) for k, t, s in rows)


def test_lines_out_of_a_sort_are_stored_without_another(spark, monkeypatch, tmp_path):
    stored = {}
    write = materialize.write_temp_table

    def spy(df, prefix="kipmart"):
        stored[prefix] = _logical(df)
        return write(df, prefix)

    lines = [(o, 1, 1, n, 1.0, 2.0, "N", None) for o in range(50, 0, -1) for n in (2, 1)]
    raw = spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,"
                                " l_extendedprice double, l_returnflag string, l_shipdate timestamp_ntz")
    shop = InlineShop(spark, {"lineitem": raw})
    shop.materialize = True
    monkeypatch.setattr(materialize, "write_temp_table", spy)
    items = shop.items
    assert "RepartitionByExpression" not in stored["kipmart-shop_items"]
    got = [(r.id, r.order_id) for r in items.orderBy("id").collect()]
    assert got == [(i + 1, i // 2 + 1) for i in range(100)]
    assert items.select(F.count_distinct("id")).first()[0] == 100


def test_only_edited_lines_are_sorted_with_the_edits(spark, monkeypatch):
    from kipmart.operators import orderlog
    asked = []
    join = orderlog.asof_join

    def spy(left, right, *rest):
        asked.append(sorted(r.item_id for r in left.select("item_id").collect()))
        return join(left, right, *rest)

    monkeypatch.setattr(orderlog, "asof_join", spy)
    tables = {"orders": spark.createDataFrame([(1, "pending", 5, 5)], "id long, status string, shipping_fee int, total_amount int"),
              "items": spark.createDataFrame([(i, 1, 100 + i, 2, 10, 0) for i in range(1, 6)],
                                             "id long, order_id long, product_id long, quantity long, price int, is_preorder int"),
              "products": spark.createDataFrame([(100 + i, 10) for i in range(1, 6)], "id long, stock int")}
    log = spark.createDataFrame([(1, "edit", 1, 2, 7, None), (2, "delete", 1, 3, None, None), (3, "cancel", 1, None, None, None)],
                                "seq long, op string, order_id long, item_id long, quantity long, status string")
    done = orderlog.replay_order_log(InlineShop(spark, tables), log)
    assert {r.id: r.stock for r in done["products"].collect()} == {101: 12, 102: 17, 103: 12, 104: 12, 105: 12}
    assert done["orders"].first().items_total == 130
    assert asked == [[2, 2]]
