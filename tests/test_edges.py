"""Edge rows the generated tables lack (inline fixtures), and brute-force checks."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from kipmart.functions import calendar as cal
from kipmart.functions import text as X
from kipmart.functions.banners import normalise_banners
from kipmart.functions.i18n import localise
from kipmart.operators import cart as K
from kipmart.operators import catalog as C
from kipmart.operators import changes as U
from kipmart.operators import reports as R
from kipmart.sources.tables import InlineShop

ORDER_SCHEMA = ("id bigint, order_number string, customer_name string, customer_phone string, "
                "total_amount decimal(15,2), shipping_fee decimal(15,0), shipping_company string, "
                "payment_method string, status string, member_id bigint, created_at timestamp_ntz")
ITEM_SCHEMA = "id bigint, order_id bigint, product_id bigint, quantity bigint, price decimal(15,2), is_preorder int"
PRODUCT_SCHEMA = ("id bigint, category_id int, name string, name_lo string, description string, "
                  "price decimal(12,2), cost_price decimal(12,2), stock int, image string, sku string, "
                  "colors string, sizes string, status string, pre_order int, sort_order int, created_at date")


def _ts(s):
    return dt.datetime.fromisoformat(s)


def _one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_iso_week_edges(spark):
    df = spark.createDataFrame([(dt.date(2018, 12, 31),), (dt.date(2021, 1, 1),), (dt.date(1998, 1, 1),)],
                               "d date")
    got = {r.d: (r.k, r.w) for r in df.select(
        "d", cal.iso_week_key(F.col("d")).alias("k"), cal.week_of_year_mode1(F.col("d")).alias("w")).collect()}
    assert got[dt.date(2018, 12, 31)] == (201901, 53)
    assert got[dt.date(2021, 1, 1)] == (202053, 0)
    assert got[dt.date(1998, 1, 1)] == (199801, 1)


def test_month_parameter(spark):
    df = spark.createDataFrame([(_ts("2024-02-10 00:00:00"),), (_ts("2024-03-01 00:00:00"),)],
                               "t timestamp_ntz")
    assert df.filter(cal.month_filter(F.col("t"), "2024-02")).count() == 1
    assert df.filter(cal.month_filter(F.col("t"), "2024-13")).count() == 0
    assert df.filter(cal.month_filter(F.col("t"), "abc")).count() == 2
    assert df.filter(cal.month_filter(F.col("t"), "")).count() == 2
    assert cal.month_or_current("abc", dt.date(2025, 5, 3)) == "2025-05"


def test_phone_functions(spark):
    df = spark.createDataFrame([("020 5555-1234",), ("+856 20 5555 1234",), ("123",), ("",), (None,)],
                               "raw string")
    rows = df.select("raw", X.phone_digits("raw").alias("d"), X.phone_last8("raw").alias("k"),
                     X.request_phone8("raw").alias("q")).collect()
    got = {r.raw: (r.d, r.k, r.q) for r in rows}
    assert got["020 5555-1234"] == ("02055551234", "55551234", "55551234")
    assert got["+856 20 5555 1234"] == ("856205555 1234".replace(" ", ""), "55551234", "55551234")
    assert got["123"] == ("123", "123", "123")
    assert got[""] == ("", "", "")
    assert got[None] == (None, None, None)


def test_decode_colors_and_sizes(spark):
    df = spark.createDataFrame([('["a","b"]',), ("a, ,b,0",), ('{"k":"v"}',), ("5",), ("",), (None,)],
                               "c string")
    got = {r.c: r.d for r in df.select("c", X.decode_colors("c").alias("d")).collect()}
    assert got['["a","b"]'] == ["a", "b"]
    assert got["a, ,b,0"] == ["a", "b"]
    assert got['{"k":"v"}'] == ["v"]
    assert got["5"] == ["5"]
    assert got[""] == [] and got[None] == []
    s = spark.createDataFrame([('["S"]',), ("",), ("{bad",)], "c string")
    got = {r.c: r.d for r in s.select("c", X.decode_sizes("c").alias("d")).collect()}
    assert got['["S"]'] == ["S"] and got[""] == [] and got["{bad"] is None


def test_money_text(spark):
    df = spark.createDataFrame([(0.0,), (2.5,), (1234567.1235,), (None,), (1000.0,)], "x double")
    got = [r.m for r in df.select(X.money_text("x").alias("m")).collect()]
    assert got == ["₭0", "₭2.5", "₭1,234,567.124", "₭0", "₭1,000"]


def test_text_helpers(spark):
    df = spark.createDataFrame([("a<b>&\"c\"", "  Bee", "0205555"), (None, "", "02055551234"),
                                (None, None, "")], "t string, name string, phone string")
    rows = df.select(X.html_escape("t").alias("e"), X.initial("name", "phone").alias("i"),
                     X.first_truthy("name", "phone").alias("n"), X.slug(F.lit("12_ແດງ")).alias("s")).collect()
    assert rows[0].e == "a&lt;b&gt;&amp;&quot;c&quot;" and rows[1].e == ""
    assert [r.i for r in rows] == ["B", "34", "?"]
    assert [r.n for r in rows] == ["  Bee", "02055551234", ""]
    assert rows[0].s == "12----"
    assert _one(spark.range(1).select(X.php_intval(F.lit(" 12ab")).alias("v"))).v == 12
    assert _one(spark.range(1).select(X.php_intval(F.lit("x")).alias("v"))).v == 0
    assert _one(spark.range(1).select(X.color_hex(F.lit("ແດງ")).alias("v"))).v == "#e74c3c"
    assert _one(spark.range(1).select(X.color_hex(F.lit("")).alias("v"))).v == "#ccc"
    assert _one(spark.range(1).select(X.color_hex(F.lit("teal")).alias("v"))).v == "teal"


def _orders(spark, rows):
    return spark.createDataFrame(rows, ORDER_SCHEMA)


def test_payment_and_status_edges(spark):
    t = _ts("1998-03-02 00:00:00")
    o = _orders(spark, [
        (1, "n", "c", "", Decimal("10.00"), Decimal(0), None, "transfer", None, None, t),
        (2, "n", "c", "", Decimal("20.00"), Decimal(0), None, "card", "pending", None, t),
        (3, "n", "c", "", Decimal("40.00"), Decimal(0), None, None, "pending", None, t),
        (4, "n", "c", "", Decimal("80.00"), Decimal(0), None, "cod", "cancelled", None, t),
        (5, "n", "c", "", Decimal("160.00"), Decimal(0), None, "cod", "pending", None, t),
    ])
    T = InlineShop(spark, {"orders": o})
    r = _one(R.sales_summary(T))
    assert r.total == Decimal("310.00") and r["count"] == 5
    # V1 / V3: NULL status is neither live nor cancelled; card / NULL method in no bucket
    assert r.transfer_total == 0 and r.transfer_count == 0
    assert r.cod_total == Decimal("160.00") and r.cod_count == 1
    assert r.cancelled_total == Decimal("80.00") and r.cancelled_count == 1
    groups = {row.status: row.cnt for row in R.status_counts(T).collect()}
    assert groups[None] == 1 and groups["pending"] == 3


def test_empty_tables(spark):
    T = InlineShop(spark, {"orders": _orders(spark, []),
                           "items": spark.createDataFrame([], ITEM_SCHEMA),
                           "products": spark.createDataFrame([], PRODUCT_SCHEMA)})
    r = _one(R.profit_overall(T))
    assert (r.revenue, r.cost, r.profit, r.units_sold) == (0, 0, 0, 0)
    s = _one(R.sales_summary(T))
    assert s.total is None and s["count"] == 0 and s.transfer_count == 0


def _product_rows(spark, stock):
    return spark.createDataFrame(
        [(i, 1, f"p{i}", None, None, Decimal("1.00"), Decimal("1.00"), stock, None, "s", None, None,
          "active", 0, None, dt.date(2000, 1, 1)) for i in (1, 2)], PRODUCT_SCHEMA)


def test_stock_asymmetry(spark):
    """Placing skips pre-order lines; a customer cancel restores all lines."""
    t = _ts("2001-01-01 00:00:00")
    products = _product_rows(spark, 10)
    orders = _orders(spark, [(7, "n", "c", "", Decimal("1.00"), Decimal(0), None, "cod", "pending", None, t)])
    req = spark.createDataFrame([(1, "A", "020-555", 0, Decimal("9.50"), None)],
                                "request_id bigint, name string, phone string, member_id bigint, "
                                "items_total decimal(15,2), shipping_fee int")
    lines = spark.createDataFrame([(1, 1, 3, Decimal("1.00"), 0), (1, 2, 4, Decimal("1.00"), 1)],
                                  "request_id bigint, product_id bigint, quantity bigint, "
                                  "price decimal(15,2), is_preorder int")
    T = InlineShop(spark, {"orders": orders, "products": products,
                           "items": spark.createDataFrame([], ITEM_SCHEMA)})
    placed = U.place_orders(T, req, lines, dt.datetime(2001, 2, 3, 4, 5, 6))
    stock = {r.id: r.stock for r in placed["products"].collect()}
    assert stock == {1: 7, 2: 10}
    h = _one(placed["orders"])
    assert h.id == 8 and h.items_total == 9 and h.shipping_fee == 0 and h.total_amount == 9
    assert h.member_id is None and h.customer_phone == "020555" and h.order_number == "BUN-20010203-0000008"
    # cancel the placed order: both lines come back, the pre-order one too
    T2 = InlineShop(spark, {"orders": placed["orders"].drop("request_id"), "products": placed["products"],
                            "items": placed["lines"].withColumn("id", F.lit(1).cast("bigint"))})
    chg = spark.createDataFrame([(8, 1), (8, 2), (99, 3)], "id bigint, seq bigint")
    res = U.cancel_orders(T2, chg)
    assert {r.id: r.stock for r in res["products"].collect()} == {1: 10, 2: 14}
    assert {(r.seq, r.reason) for r in res["rejected"].collect()} == {(2, "not pending"), (3, "not found")}
    res_c = U.cancel_orders(T2, chg, mode="consistent")
    assert {r.id: r.stock for r in res_c["products"].collect()} == {1: 10, 2: 10}


def _fold(events):
    """Row-by-row replay of the shop front's cart rules (brute force)."""
    carts = {}
    for e in sorted(events, key=lambda e: e["seq"]):
        lines = carts.setdefault(e["cart_id"], {})
        key = (e["product_id"], e["color"] or "")
        a = e["action"]
        if a == "clear":
            lines.clear()
        elif a == "add":
            if key in lines:
                lines[key][1] += e["qty"]
            else:
                lines[key] = [e["price"], e["qty"]]
        elif a == "remove":
            lines.pop(key, None)
        elif a == "set":
            if e["qty"] < 1:
                lines.pop(key, None)
            elif key in lines:
                lines[key][1] = e["qty"]
    return {(c, k[0], k[1]): (v[1], v[0]) for c, ls in carts.items() for k, v in ls.items()}


CART_SCHEMA = ("cart_id bigint, seq bigint, product_id bigint, color string, action string, "
               "qty bigint, price decimal(15,2)")


def test_cart_edge_cases(spark):
    rows = [
        (1, 1, 1, "", "set", 5, Decimal("1")),      # set before add: no-op
        (1, 2, 1, "", "add", 2, Decimal("3")),
        (1, 3, 1, "", "remove", 1, Decimal("9")),
        (1, 4, 1, "", "add", 1, Decimal("4")),      # re-add after remove: new price
        (1, 5, 1, "", "add", 2, Decimal("7")),      # later add keeps the first price
        (1, 6, 2, "r", "add", 1, Decimal("2")),
        (1, 7, 2, "r", "set", 0, Decimal("2")),     # set 0 removes
        (2, 8, 1, "", "add", 1, Decimal("1")),
        (2, 9, 1, "", "clear", 1, Decimal("1")),
        (2, 10, 3, "", "add", 1, Decimal("5")),
        (2, 11, 3, "", "set", 4, Decimal("5")),
        (2, 12, 3, "", "add", 2, Decimal("6")),
        (3, 13, 1, None, "add", 1, Decimal("1")),
    ]
    ev = spark.createDataFrame(rows, CART_SCHEMA)
    got = {(r.cart_id, r.product_id, r.color): (r.qty, r.price) for r in K.cart_replay(ev).collect()}
    want = _fold([dict(zip(["cart_id", "seq", "product_id", "color", "action", "qty", "price"], r))
                  for r in rows])
    assert got == want
    assert got[(1, 1, "")] == (3, Decimal("4.00"))
    assert got[(2, 3, "")] == (6, Decimal("5.00"))
    assert (1, 2, "r") not in got


def test_cart_replay_matches_fold_on_events(spark, shop):
    ev = shop.table("cart_events")
    rows = [r.asDict() for r in ev.collect()]
    got = {(r.cart_id, r.product_id, r.color): (r.qty, r.price) for r in K.cart_replay(ev).collect()}
    assert got == _fold(rows)


def test_banners(spark):
    df = spark.createDataFrame([('["x",{"img":"y","link":"z"}]',), ("[]",), ("malformed",)], "j string")
    got = [[tuple(b) for b in r.b] for r in df.select(normalise_banners(F.col("j")).alias("b")).collect()]
    assert got == [[("x", ""), ("y", "z")], [], []]


def test_localise(spark):
    df = spark.createDataFrame([("en", "nav.home"), ("fr", "nav.home"), ("en", "zzz")], "lang string, key string")
    assert [r.t for r in df.select(localise(F.col("lang"), F.col("key")).alias("t")).collect()] == \
        ["Home", "ໜ້າຫຼັກ", "zzz"]


def test_category_changes(spark, shop):
    chg = spark.createDataFrame([
        (1, "insert", None, " Fresh "), (2, "insert", None, "Brand#3"), (3, "insert", None, ""),
        (4, "update", 4, "Brand#4"), (5, "update", 5, "brand#6"), (6, "delete", 7, None),
        (7, "delete", 99, None), (8, "delete", 25, None), (9, "update", 1, "BRAND#1")],
        "seq int, op string, id int, name string")
    res = {r.seq: (r.status, r.reason, r.name) for r in U.apply_category_changes(shop, chg).collect()}
    assert res[1] == ("applied", None, "Fresh")
    assert res[2] == ("rejected", "duplicate name", "Brand#3")
    assert res[3] == ("rejected", "name required", "")
    assert res[4] == ("applied", None, "Brand#4")      # its own name: no clash
    assert res[5][1] == "duplicate name"               # brand#6 exists under another id
    assert res[6][1] == "has products"
    assert res[7] == ("applied", None, None)           # 'Empty' has no product
    assert res[8][1] == "has products"                 # inactive products still count
    assert res[9][1] == "duplicate name"               # 'brand#1 ' (id 98) differs only by case/blank


def test_listing_search_is_case_insensitive_pattern(spark, shop):
    a = C.product_listing(shop, search="SMALL", decoded=False).count()
    b = C.product_listing(shop, search="small", decoded=False).count()
    assert a == b > 0
    # V14: '%' in user text is a wildcard; '' keeps rows whose name or description is set
    assert C.product_listing(shop, search="", decoded=False).count() == \
        shop.products.filter("status = 'active'").count()


def test_generic_upsert_by_name(spark):
    """The same upsert with another key."""
    from kipmart.plans.upsert import upsert
    base = spark.createDataFrame([(1, "alice", "x"), (2, "bob", "y")], "id bigint, name string, role string")
    ch = spark.createDataFrame([("bob", "z", 5), ("carol", "w", 3), ("carol", "v", 4), ("dan", "u", 1)],
                               "name string, role string, seq bigint")
    got = {r.name: (r.id, r.role) for r in upsert(base, ch, ["name"], ["role"]).collect()}
    assert got == {"alice": (1, "x"), "bob": (2, "z"), "dan": (3, "u"), "carol": (4, "v")}


def test_orphan_lines(spark, shop):
    """J2 keeps lines of deleted products (NULL name); J1 reports drop them."""
    from kipmart.operators import orders as O
    products = {r.id for r in shop.products.select("id").collect()}
    detail = O.order_detail(shop).collect()
    orphans = [r for r in detail if r.product_id not in products]
    assert orphans and all(r.product_name is None and r.product_image is None for r in orphans)
    top_ids = {r.id for r in R.profit_by_product(shop, n=100000).collect()}
    assert top_ids <= products
    # the pre-order summary has no product join: orphan pre-order lines still count
    pre_orphans = [r for r in orphans if r.is_preorder == 1]
    if pre_orphans:
        with_orphans = R.preorder_summary(shop).collect()[0].total_lines
        joined = R.preorder_lines(shop).count()
        assert with_orphans >= joined


def test_cart_replay_with_a_hot_cart(spark):
    """One cart holds a third of all events; the replay stays exact with AQE's
    skew-join splitting forced on."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        acts = F.element_at(F.array(*[F.lit(a) for a in ("add", "add", "add", "set", "remove", "clear",
                                                         "add", "set")]),
                            (F.col("id") * 7 % 8 + 1).cast("int"))
        ev = spark.range(9000).select(
            F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 40).alias("cart_id"),
            F.col("id").alias("seq"),
            (F.col("id") * 13 % 5).alias("product_id"),
            F.when(F.col("id") % 2 == 0, F.lit("r")).otherwise(F.lit("")).alias("color"),
            F.when((F.col("id") * 7 % 8 == 5) & (F.col("id") % 97 != 0), F.lit("add")).otherwise(acts)
            .alias("action"),
            (F.col("id") % 4).alias("qty"),
            (F.col("id") % 50).cast("decimal(15,2)").alias("price"))
        rows = [r.asDict() for r in ev.collect()]
        got = {(r.cart_id, r.product_id, r.color): (r.qty, r.price) for r in K.cart_replay(ev).collect()}
        assert got == _fold(rows)
        assert any(k[0] == 7 for k in got)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_small_library_helpers(spark, shop):
    import tempfile

    from kipmart.operators.cart import carrier_map_as_map
    from kipmart.sources.requests import ORDER_REQUEST, read_changes
    # S6 on products: missing migration columns appear with their defaults
    bare = shop.products.drop("cost_price", "pre_order", "colors")
    filled = U.with_defaults(bare, U.PRODUCT_DEFAULTS)
    r = filled.select("cost_price", "pre_order", "colors").first()
    assert (r.cost_price, r.pre_order, r.colors) == (Decimal("0.00"), 0, None)
    # U6/U7 request form: list position becomes sort_order, empty paths skipped
    req = spark.createDataFrame([(5, ["a.jpg", "", "c.jpg"])], "id bigint, extra_images array<string>")
    assert [(r.sort_order, r.image_path) for r in U.images_from_lists(req).collect()] == \
        [(0, "a.jpg"), (2, "c.jpg")]
    # K5 map form: one map per user, emptied carriers dropped
    ev = spark.createDataFrame([(1, 1, "a", "N-1"), (1, 2, "b", "N-2"), (1, 3, "b", "")],
                               "user_id bigint, seq bigint, carrier string, member_number string")
    assert carrier_map_as_map(ev).first().carriers == {"a": "N-1"}
    # change batches from files with an explicit schema
    path = tempfile.mkdtemp(prefix="chg-")
    spark.createDataFrame([(1, "x")], "request_id bigint, name string").write.mode("overwrite").json(path)
    assert read_changes(spark, path, ORDER_REQUEST).first().name == "x"


def test_week_functions_match_iso_calendar_1990_2035(spark):
    """V7 over every day of 1990-2035 against Python's ISO calendar."""
    start = dt.date(1990, 1, 1)
    n = (dt.date(2035, 12, 31) - start).days + 1
    days = spark.range(n).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("d"))
    got = {r.d: (r.k, r.w) for r in days.select(
        "d", cal.iso_week_key(F.col("d")).alias("k"), cal.week_of_year_mode1(F.col("d")).alias("w")).collect()}
    assert len(got) == n
    for d, (k, w) in got.items():
        iy, iw, _ = d.isocalendar()
        assert k == iy * 100 + iw
        assert w == (0 if iy < d.year else 53 if iy > d.year else iw)
