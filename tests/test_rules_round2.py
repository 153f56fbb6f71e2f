"""Hand-written expectations for rules that the fixture tables cannot show."""

import datetime as dt

from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.functions.banners import can_add_slide, normalise_banners
from kipmart.operators import cart as K
from kipmart.operators import changes as U
from kipmart.operators import members as M
from kipmart.plans.spread import hot_keys, spread_join
from kipmart.sources.requests import parse_order_requests, rejected_order_requests
from kipmart.sources.tables import InlineShop

ITEMS = "id bigint, order_id bigint, product_id bigint, quantity bigint, price decimal(15,2), is_preorder int"


def test_order_numbers_are_never_cut(spark):
    ids = [1, 2 ** 28 - 1, *range(2 ** 28, 2 ** 28 + 64), 10 ** 10, 10 ** 10 + 1]
    df = spark.createDataFrame([(i, dt.datetime(2024, 2, 3)) for i in ids], "id bigint, at timestamp_ntz")
    got = [r.n for r in df.select(X.order_number(F.col("at"), F.col("id")).alias("n")).collect()]
    assert len(set(got)) == len(ids)
    assert got[0] == "BUN-20240203-0000001" and got[1] == "BUN-20240203-FFFFFFF"
    assert got[2] == "BUN-20240203-10000000" and got[-2] == "BUN-20240203-2540BE400"


def test_codes_are_padded_never_cut(spark):
    df = spark.createDataFrame([("7",), ("1234567",), (None,)], "c string")
    assert [r.p for r in df.select(X.pad_code(F.col("c")).alias("p")).collect()] == ["000007", "1234567", None]


def test_stored_banners_beyond_the_cap_stay(spark):
    ten, seven = "[" + ",".join(['"x"'] * 10) + "]", "[" + ",".join(['"x"'] * 7) + "]"
    df = spark.createDataFrame([(ten,), (seven,), (None,)], "j string")
    rows = df.select(F.size(normalise_banners(F.col("j"))).alias("n"), can_add_slide(F.col("j")).alias("ok")).collect()
    assert [(r.n, r.ok) for r in rows] == [(10, False), (7, True), (0, True)]


def test_lines_of_one_long_order_have_their_own_ids(spark, tmp_path):
    from kipmart.sources.adapter import _shop_items
    rows = spark.range(1500).select(
        F.lit(1).cast("bigint").alias("l_orderkey"), (F.col("id") + 1).alias("l_partkey"), F.lit(1).alias("l_suppkey"),
        F.col("id").alias("l_linenumber"), F.lit(1.0).alias("l_quantity"), F.lit(2.0).alias("l_extendedprice"),
        F.lit("N").alias("l_returnflag"), F.lit("x").alias("l_shipdate"))
    two = rows.unionByName(rows.limit(5).withColumn("l_orderkey", F.lit(2).cast("bigint")))
    got = _shop_items(two).collect()
    assert len({r.id for r in got}) == 1505 == max(r.id for r in got)


def test_a_line_without_a_preorder_flag_goes_back_to_stock(spark):
    T = InlineShop(spark, {
        "orders": spark.createDataFrame([(1, 10)], "id bigint, shipping_fee int"),
        "items": spark.createDataFrame([(1, 1, 5, 2, None, None), (2, 1, 5, 4, None, 1)], ITEMS),
        "products": spark.createDataFrame([(5, 5)], "id bigint, stock int")})
    req = spark.createDataFrame([(1, 1, 1), (2, 1, 2)], "item_id bigint, order_id bigint, seq bigint")
    assert [r.stock for r in U.delete_items(T, req)["products"].collect()] == [7]


def test_total_stands_in_for_items_total(spark):
    T = InlineShop(spark, {"orders": spark.createDataFrame([(1,)], "id bigint"),
                           "products": spark.createDataFrame([(5, 5)], "id bigint, stock int")})
    body = ['{"request_id":"1","total":"9000.7","shipping_fee":25.5,"member_id":"12","items":[{"id":"5","qty":"2","price":"3"}]}',
            '{"request_id":2,"total":9000,"items_total":10,"member_id":0,"items":[{"id":5,"qty":1,"is_preorder":true}]}',
            '{"request_id":3}', "no json", "", None]
    bodies = spark.createDataFrame([(b,) for b in body], "body string")
    parsed = parse_order_requests(bodies)
    heads = parsed.drop("items")
    lines = parsed.select("request_id", F.explode("items").alias("i")).select(
        "request_id", F.col("i.id").alias("product_id"), F.col("i.qty").alias("quantity"),
        F.col("i.price").alias("price"), F.col("i.is_preorder").alias("is_preorder"))
    out = U.place_orders(T, heads, lines, dt.datetime(2024, 1, 1))
    got = {r.request_id: (r.items_total, r.shipping_fee, r.total_amount, r.member_id) for r in out["orders"].collect()}
    assert got == {1: (9000, 25, 9025, 12), 2: (10, 0, 10, None), 3: (0, 0, 0, None)}
    assert {(r.product_id, r.quantity, r.is_preorder) for r in out["lines"].collect()} == {(5, 2, 0), (5, 1, 1)}
    assert [r.stock for r in out["products"].collect()] == [3]
    bad = {r.body: r.reason for r in rejected_order_requests(bodies).collect()}
    assert bad["no json"] == "malformed JSON" and bad[""] == bad[None] == "empty body" and len(bad) == 3


def test_cart_lines_without_a_quantity_count_as_one(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (1, None, 2.0), (1, 3, 1.0)], "cart_id int, qty int, price double")
    assert [(r["count"], r.total) for r in K.cart_totals(df).collect()] == [(5, 10.0)]


def test_carrier_numbers_are_trimmed(spark):
    df = spark.createDataFrame([(1, 1, "a", " N-1 "), (1, 2, "b", " x"), (1, 3, "b", "  ")],
                               "user_id int, seq int, carrier string, member_number string")
    assert [tuple(r) for r in K.carrier_map(df).collect()] == [(1, "a", "N-1")]


def test_members_without_a_phone_are_refused(spark):
    base = spark.createDataFrame([(1, "020", "n", "a", "m")], "id bigint, phone string, name string, shipping_company string, member_number string")
    ch = spark.createDataFrame([("", "b", "x", 1), (" ", "b", "x", 2), ("0 20", "c", "y", 3)],
                               "phone string, shipping_company string, member_number string, seq bigint")
    assert [tuple(r) for r in M.members_upserted(base, ch).collect()] == [(1, "020", "n", "c", "y")]


def test_one_name_is_stored_once_per_batch(spark):
    T = InlineShop(spark, {"categories": spark.createDataFrame([(1, "A", "a"), (2, "B", None), (3, "C", "c")], "id int, name string, description string"),
                           "products": spark.createDataFrame([(1, 3)], "id bigint, category_id int")})
    ch = spark.createDataFrame([
        (1, "insert", None, " New ", "d "), (2, "insert", None, "NEW", "e"), (3, "update", 2, "new", None),
        (4, "update", 1, "Z", "z"), (5, "update", 1, "Y", None), (6, "update", 2, "y ", "q"), (7, "delete", 3, None, None),
        (8, "insert", None, "Last", None)], "seq int, op string, id int, name string, description string")
    status = {r.seq: r.reason for r in U.apply_category_changes(T, ch).collect()}
    assert status == {1: None, 2: "duplicate name", 3: "duplicate name", 4: None, 5: None, 6: "duplicate name",
                      7: "has products", 8: None}
    after = sorted(tuple(r) for r in U.categories_after_changes(T, ch).collect())
    assert after == [(1, "Y", ""), (2, "B", None), (3, "C", "c"), (4, "New", "d"), (5, "Last", "")]


def test_hot_keys_are_dealt_over_tasks(spark):
    big = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id")).alias("k"), F.col("id").alias("seq"))
    small = big.groupBy("k").agg(F.count("*").alias("n"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = spread_join(big, small, ["k"], rows_per_task=500)
        assert joined.count() == 9000
        per = joined.groupBy(F.spark_partition_id().alias("p")).agg(F.sum(F.when(F.col("k") == 1, 1).otherwise(0)).alias("hot")).collect()
        assert max(r.hot for r in per) < 0.75 * 3000 and sum(1 for r in per if r.hot) > 1
        parts = joined.sparkSession.range(1).select(hot_keys(big, ["k"], 500).alias("m")).first().m
        assert list(parts.values()) == [7]  # one key of 3,001 rows; the others are left alone
        assert not spark.range(1).select(hot_keys(big, ["k"]).alias("m")).first().m
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    for how, want in (("inner", 9000), ("left_semi", 9000), ("left_anti", 0)):
        assert spread_join(big, small, ["k"], how, rows_per_task=500).count() == want
    assert sorted(tuple(r) for r in spread_join(big, small, ["k"], rows_per_task=500).select("k", "seq", "n").limit(9000).collect()) == \
        sorted(tuple(r) for r in big.join(small, "k").select("k", "seq", "n").collect())


def test_jdbc_options_of_each_table():
    import pytest

    from kipmart.sources.tables import JDBC_TABLES, jdbc_options, jdbc_reader_options
    jdbc = {"url": "jdbc:x", "bounds": {"shop_items": (1, 900), "shop_orders": (5, 50)}}
    items = jdbc_reader_options(JDBC_TABLES["shop_items"], **jdbc_options("shop_items", jdbc))
    assert items["dbtable"] == "order_items" and items["lowerBound"] == "1" and items["upperBound"] == "900"
    assert items["preferTimestampNTZ"] == "true" and items["partitionColumn"] == "id"
    products = jdbc_reader_options(JDBC_TABLES["shop_products"], **jdbc_options("shop_products", jdbc))
    assert products["dbtable"] == "products" and "lowerBound" not in products
    with pytest.raises(ValueError):
        jdbc_options("shop_orders", {"url": "jdbc:x"})
