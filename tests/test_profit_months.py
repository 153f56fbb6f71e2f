"""Profit by month: no groups by product, and the sums of the plain loop on odd rows."""

import random
from decimal import Decimal

from kipmart.operators import reports
from kipmart.sources.tables import InlineShop


def _shop(spark, orders, items, products):
    return InlineShop(spark, {
        "orders": spark.createDataFrame(orders, "id long, status string, created_at timestamp_ntz"),
        "items": spark.createDataFrame(items, "order_id long, product_id long, quantity long, price decimal(15,2)"),
        "products": spark.createDataFrame(products, "id long, name string, sku string, image string, cost_price decimal(12,2)")})


def _rows(seed=4):
    import datetime
    rng = random.Random(seed)
    orders = [(rng.choice([i, i, i, None]), rng.choice(["pending", "cancelled", None, "completed"]),
               rng.choice([None, datetime.datetime(2020 + rng.randrange(2), 1 + rng.randrange(12), 3)])) for i in range(60)]
    orders += orders[:5]
    money = lambda: rng.choice([None, Decimal(rng.randrange(5000)) / 100])
    items = [(rng.choice([rng.randrange(70), None]), rng.choice([rng.randrange(12), None]), rng.choice([rng.randrange(9), None]), money())
             for _ in range(600)]
    products = [(i, "n", "s", None, money()) for i in [*range(9), 3, 4]] + [(None, "n", "s", None, money())]
    return orders, items, products


def test_sums_of_odd_rows(spark):
    orders, items, products = _rows()
    want = {}
    for oid, status, at in orders:
        if oid is None or status is None or status == "cancelled":
            continue
        for o, p, q, price in items:
            for pid, _, _, _, cost in products:
                if o == oid and p is not None and p == pid:
                    month = at and at.strftime("%Y-%m")
                    s = want.setdefault(month, [None, None])
                    if q is not None and price is not None:
                        s[0] = (s[0] or 0) + q * price
                    if q is not None:
                        s[1] = (s[1] or 0) + q * (cost or 0)
    got = {r.month: [r.revenue, r.cost] for r in reports.profit_by_month(_shop(spark, orders, items, products), n=100).collect()}
    assert got == want
    shared = reports.profit(_shop(spark, orders, items, products), n_months=100)["by_month"]
    assert shared.schema == reports.profit_by_month(_shop(spark, orders, items, products)).schema
    assert {r.month: [r.revenue, r.cost] for r in shared.collect()} == want


def test_no_groups_by_product(spark):
    plan = reports.profit_by_month(_shop(spark, *_rows()))._jdf.queryExecution().optimizedPlan().toString()
    groups = [line.split("Aggregate [")[1].split("]")[0] for line in plan.splitlines() if "Aggregate [" in line]
    assert groups and not [g for g in groups if "product_id" in g]
