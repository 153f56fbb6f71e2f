"""Invariants between operators (on the small generated tables)."""

from pyspark.sql import functions as F

from kipmart import params as P
from kipmart.operators import changes as U
from kipmart.operators import reports as R


def _stock(df):
    return {r.id: r.stock for r in df.select("id", "stock").collect()}


def test_stock_after_equals_stock_before_plus_ledger(shop):
    placed = U.place_orders(shop, shop.table("req_orders"), shop.table("req_order_items"), P.AS_OF)
    cancel = U.cancel_orders(shop, shop.table("chg_cancel"))
    delete = U.delete_items(shop, shop.table("chg_item_delete"))
    before = _stock(shop.products)
    for part, res in (("placed", placed), ("cancelled", cancel), ("deleted", delete)):
        ledger = U.stock_ledger(placed["moves"], cancel["moves"], delete["moves"])
        moves = {r.product_id: r[part] for r in ledger.collect()}
        after = _stock(res["products"])
        for pid, s in before.items():
            assert after[pid] == s + moves.get(pid, 0)


def test_status_counts_sum_to_summary_total(shop):
    total = R.sales_summary(shop).collect()[0].total
    by_status = R.status_counts(shop).agg(F.sum("total").alias("t")).collect()[0].t
    assert total == by_status


def test_profit_is_revenue_minus_cost(shop):
    r = R.profit_overall(shop).collect()[0]
    assert r.profit == r.revenue - r.cost
    for row in R.profit_by_product(shop, n=1000).collect():
        assert row.profit == row.revenue - row.cost


def test_monthly_profit_adds_up_to_overall(shop):
    months = R.profit_by_month(shop, n=100000).agg(F.sum("revenue").alias("r")).collect()[0].r
    assert months == R.profit_overall(shop).collect()[0].revenue


def test_duplicate_requests_do_not_change_overwrites(spark, shop):
    chg = shop.table("chg_stock")
    dup = chg.unionByName(chg.withColumn("seq", F.col("seq") - 10_000_000))
    assert _stock(U.set_stock(shop, chg)) == _stock(U.set_stock(shop, dup))
    st = shop.table("chg_status")
    dup = st.unionByName(st.withColumn("seq", F.col("seq") - 10_000_000))
    a = {r.id: r.status for r in U.set_status(shop, st).collect()}
    b = {r.id: r.status for r in U.set_status(shop, dup).collect()}
    assert a == b


def test_recomputed_totals_agree_with_mismatch_view(shop):
    n_mismatch = U.order_total_mismatch(shop).count()
    assert 0 < n_mismatch <= shop.orders.count()


def test_profit_bundle_equals_single_reports(shop):
    for month in (None, "1998-03", "2024-13", "abc"):
        b = R.profit(shop, month)
        assert b["overall"].collect() == R.profit_overall(shop, month).collect()
        assert b["by_product"].collect() == R.profit_by_product(shop, month).collect()
        assert b["by_month"].collect() == R.profit_by_month(shop).collect()
    m = R.profit(shop, "1998-03", materialize=True)
    assert m["overall"].collect() == R.profit_overall(shop, "1998-03").collect()


def test_reports_with_hot_product_and_hot_order(spark):
    """A product and an order each holding a third of the lines: the report
    plans (semi join, pre-aggregation, product join) stay exact with skew
    splitting forced on and broadcasts off."""
    import datetime as dt
    from collections import defaultdict
    from decimal import Decimal

    from kipmart.sources.tables import InlineShop
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(30000).select(
            F.col("id"),
            F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id") % 700 + 2).alias("order_id"),
            F.when(F.col("id") % 3 == 1, F.lit(5)).otherwise(F.col("id") % 90 + 1).alias("product_id"),
            (F.col("id") % 7 + 1).alias("quantity"),
            (F.col("id") % 1000 / 10).cast("decimal(15,2)").alias("price"),
            (F.col("id") % 2).cast("int").alias("is_preorder"))
        orders = spark.range(1, 702).select(
            F.col("id"), F.lit("n").alias("order_number"), F.lit("c").alias("customer_name"),
            F.lit("").alias("customer_phone"), F.lit(1).cast("decimal(15,2)").alias("total_amount"),
            F.lit(0).cast("decimal(15,0)").alias("shipping_fee"), F.lit(None).cast("string").alias("shipping_company"),
            F.lit("cod").alias("payment_method"),
            F.when(F.col("id") % 4 == 0, "cancelled").otherwise("pending").alias("status"),
            F.lit(None).cast("bigint").alias("member_id"),
            F.lit(dt.datetime(2000, 1, 1)).cast("timestamp_ntz").alias("created_at"))
        products = spark.range(1, 92).select(
            F.col("id"), F.lit(1).alias("category_id"), F.concat(F.lit("p"), F.col("id")).alias("name"),
            F.lit(None).cast("string").alias("name_lo"), F.lit(None).cast("string").alias("description"),
            F.lit(1).cast("decimal(12,2)").alias("price"),
            (F.col("id") % 5).cast("decimal(12,2)").alias("cost_price"), F.lit(3).alias("stock"),
            F.lit(None).cast("string").alias("image"), F.lit("s").alias("sku"))
        T = InlineShop(spark, {"items": items, "orders": orders, "products": products})
        live = {r.id for r in orders.collect() if r.status != "cancelled"}
        cost = {r.id: r.cost_price for r in products.collect()}
        rev, qty, total_cost = defaultdict(Decimal), defaultdict(int), Decimal(0)
        for r in items.collect():
            if r.order_id in live and r.product_id in cost:
                rev[r.product_id] += r.quantity * r.price
                qty[r.product_id] += r.quantity
                total_cost += r.quantity * cost[r.product_id]
        o = R.profit_overall(T).collect()[0]
        assert o.revenue == sum(rev.values()) and o.cost == total_cost
        assert o.units_sold == sum(qty.values())
        top = R.top_products(T, n=3).collect()
        want = sorted(qty.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
        assert [(r.id, r.total_qty) for r in top] == want
        assert top[0].id == 5
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
