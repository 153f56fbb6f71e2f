"""The clustered layout reads back to the same answers, and month ranges skip files."""

import tempfile

from kipmart.operators import reports as R
from kipmart.plans.materialize import cut_lineage, write_outputs
from kipmart.sources.layout import write_shop
from kipmart.sources.tables import load_shop


def test_written_layout_gives_same_reports(spark, shop):
    path = tempfile.mkdtemp(prefix="shop-layout-")
    write_shop(shop, path, files={"shop_orders": 4, "shop_items": 4})
    P = load_shop(spark, path, kind="parquet")
    for fn in (R.sales_summary, R.profit_overall, R.preorder_summary):
        assert fn(shop).collect() == fn(P).collect()
    assert R.sales_daily(shop, "1996-07").collect() == R.sales_daily(P, "1996-07").collect()


def test_write_outputs_and_cut_lineage(spark, shop):
    base = cut_lineage(shop.products.select("id", "stock"))
    out = write_outputs({"stock": base}, tempfile.mkdtemp(prefix="out-"))
    assert spark.read.parquet(out["stock"]).count() == shop.products.count()


def test_json_request_files_round_trip(spark, shop):
    from kipmart.plans.wire import write_json
    from kipmart.sources.requests import (order_request_bodies, order_request_lines,
                                          read_order_requests)
    path = tempfile.mkdtemp(prefix="req-")
    req, items = shop.table("req_orders"), shop.table("req_order_items")
    for most in (100, 2):
        bodies = order_request_bodies(req, items, most_items=most)
        bodies.write.mode("overwrite").text(f"{path}/bodies_{most}")
        parsed = read_order_requests(spark, f"{path}/bodies_{most}")
        heads, lines = order_request_lines(parsed)
        assert heads.select("request_id").distinct().count() == \
            req.count()
        assert lines.count() == items.count()
    write_json(shop.orders, path + "/orders_json")
    assert spark.read.json(path + "/orders_json").count() == shop.orders.count()


def test_temp_tables_can_be_dropped(spark):
    from kipmart.plans.materialize import drop_temp_tables, write_temp_table
    write_temp_table(spark.range(10), "kipmart-droptest")
    assert drop_temp_tables(spark, "kipmart-droptest") >= 1
    assert drop_temp_tables(spark, "kipmart-droptest") == 0


def test_month_partitioned_layout_prunes_and_agrees(spark, shop):
    from kipmart import params as P
    path = tempfile.mkdtemp(prefix="shop-month-")
    write_shop(shop, path, files={"shop_orders": 4, "shop_items": 4}, by_month=True)
    M = load_shop(spark, path, kind="parquet", raw_path="/root/testdata/sf0.001")
    assert "order_month" in M.items.columns
    for fn in (lambda T: R.sales_summary(T, P.MONTH), lambda T: R.profit_overall(T, P.MONTH),
               lambda T: R.preorder_by_week(T, P.YEAR), lambda T: R.sales_daily(T, P.MONTH),
               lambda T: R.preorder_by_day(T, P.MONTH)):
        assert fn(shop).collect() == fn(M).collect()
    plan = R.profit_overall(M, P.MONTH)._sc._jvm.PythonSQLUtils.explainString(
        R.profit_overall(M, P.MONTH)._jdf.queryExecution(), "formatted")
    parts = [ln for ln in plan.splitlines() if "PartitionFilters" in ln and "order_month" in ln]
    assert len(parts) >= 2          # both the order and the line scan are pruned


def test_only_touched_months_are_written(spark, tmp_path):
    import pathlib

    from kipmart.sources.layout import MONTH, overwrite_touched
    path = str(tmp_path / "orders")
    rows = [(k, "pending", f"1998-0{k % 4 + 1}" if k < 40 else None) for k in range(44)]
    spark.createDataFrame(rows, f"id long, status string, {MONTH} string").write.partitionBy(MONTH).parquet(path)
    files = lambda: {str(f.relative_to(path)): f.stat().st_mtime_ns for f in pathlib.Path(path).rglob("part-*.parquet")}
    before = files()
    changes = spark.createDataFrame([(2, "shipped"), (6, None), (41, "late"), (999, "x")], "id long, status string")
    assert overwrite_touched(spark, path, changes, ["status"]) == ["1998-03", None]
    after = files()
    kept = {f for f in before if "1998-03" not in f and "DEFAULT" not in f}
    assert kept and all(after[f] == before[f] for f in kept) and not (before.keys() - kept) & after.keys()
    want = sorted((i, {2: "shipped", 6: None, 41: "late"}.get(i, s) if i in (2, 6, 41) else s, m or "") for i, s, m in rows)
    got = lambda: sorted((r.id, r.status, r[MONTH] or "") for r in spark.read.parquet(path).collect())
    assert got() == want
    assert overwrite_touched(spark, path, changes, ["status"]) == ["1998-03", None] and got() == want
    assert overwrite_touched(spark, path, changes.filter("id = 999"), ["status"]) == []


def test_versions_before_and_after_a_migration(spark, tmp_path):
    from kipmart.sources.layout import read_versions
    old, new = str(tmp_path / "v1"), str(tmp_path / "v2")
    spark.createDataFrame([(1, "a")], "id long, status string").write.parquet(old)
    spark.createDataFrame([(2, None, "b", 7), (3, "cod", "c", 8)], "id long, payment_method string, status string, extra int").write.parquet(new)
    out = read_versions(spark, [old, new], {"payment_method": ("string", "transfer"), "shipping_fee": ("decimal(15,0)", 0)})
    assert out.columns == ["id", "status", "payment_method", "shipping_fee", "extra"]
    assert sorted(tuple(r) for r in out.collect()) == [(1, "a", "transfer", 0, None), (2, "b", None, 0, 7), (3, "c", "cod", 0, 8)]


def test_request_bodies_of_many_items_are_split(spark):
    from kipmart.sources.requests import order_request_bodies, parse_order_requests
    req = spark.createDataFrame([(1, "n"), (2, "m")], "request_id long, name string")
    lines = spark.createDataFrame([(1, k, 2, 1.5, 0) for k in range(7)], "request_id long, product_id long, quantity int, price double, is_preorder int")
    bodies = order_request_bodies(req, lines, most_items=3)
    parsed = parse_order_requests(bodies)
    assert sorted((r.request_id, len(r["items"])) for r in parsed.collect()) == [(1, 1), (1, 3), (1, 3), (2, 0)]
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
