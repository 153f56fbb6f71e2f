"""Order and catalogue change batches.

Each function takes the current tables and a batch of requests (a DataFrame
with a ``seq`` column giving request order) and returns the new table(s) as
lazy DataFrames. Rules for several requests on one key inside a batch:

* overwrites (status, address, stock, sort order, quantity): highest ``seq`` wins;
* cancel: the lowest ``seq`` is applied, later ones are refused (the order is
  no longer pending);
* stock movements add up.

Stock movements are aggregated per product (partial aggregation, so a hot
product is collapsed map-side) and then joined once to the product table —
never one update per line as in the reference.

``mode="reference"`` reproduces the reference's stock asymmetry (V20):
placing does not take pre-order lines from stock, but a customer cancel puts
back every line. ``mode="consistent"`` skips pre-order lines on cancel too.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.plans.ids import sequence_number
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.spread import spread_join
from kipmart.plans.upsert import latest_per_key, merge_update, split_valid

# Columns added by the migrations, with their declared defaults.
ORDER_DEFAULTS = {
    "items_total": ("decimal(15,0)", 0),
    "shipping_fee": ("decimal(15,0)", 0),
    "shipping_company": ("string", None),
    "member_number": ("string", None),
    "payment_method": ("string", "transfer"),
    "member_id": ("bigint", None),
    "customer_address": ("string", None),
    "note": ("string", None),
    "payment_slip": ("string", None),
}
PRODUCT_DEFAULTS = {
    "colors": ("string", None),
    "cost_price": ("decimal(12,2)", 0),
    "pre_order": ("int", 0),
    "sizes": ("string", None),
    "sort_order": ("int", None),
}


# ----------------------------------------------------------------------- S6
def with_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default (existing columns, and
    their NULLs, are left alone)."""
    present = set(df.columns)
    missing = {name: F.lit(value).cast(dtype) for name, (dtype, value) in defaults.items()
               if name not in present}
    return df.withColumns(missing) if missing else df


def orders_with_shipping_defaults(T) -> DataFrame:
    o = with_defaults(T.orders, ORDER_DEFAULTS)
    return o.select("id", *ORDER_DEFAULTS.keys())


# ----------------------------------------------------------------------- A3
def _int(c: Column) -> Column:
    """PHP ``(int)`` truncates toward zero."""
    return c.cast("bigint")


def order_totals(items: DataFrame, orders: DataFrame) -> DataFrame:
    """A3: ``items_total = (int) COALESCE(SUM(price*quantity), 0)`` and
    ``total_amount = items_total + (int) COALESCE(shipping_fee, 0)`` per order."""
    s = (items.groupBy("order_id")
         .agg(F.sum(F.col("price") * F.col("quantity")).alias("__sum")))
    o = orders.select("id", "shipping_fee")
    j = o.join(s, o.id == s.order_id, "left")
    items_total = _int(F.coalesce(F.col("__sum"), F.lit(0)))
    return j.select("id", items_total.alias("items_total"),
                    (items_total + _int(F.coalesce(F.col("shipping_fee"), F.lit(0))))
                    .alias("total_amount"))


def order_totals_recomputed(T) -> DataFrame:
    return order_totals(T.items, T.orders)


def order_total_mismatch(T) -> DataFrame:
    """Orders whose stored total differs from their lines plus shipping."""
    s = (T.items.groupBy("order_id")
         .agg(F.sum(F.col("price") * F.col("quantity")).alias("lines_total")))
    o = T.orders.select("id", "total_amount", "shipping_fee")
    j = o.join(s, o.id == s.order_id, "left").drop("order_id")
    lines = F.coalesce(F.col("lines_total"), F.lit(0))
    expected = lines + F.coalesce(F.col("shipping_fee"), F.lit(0))
    return (j.withColumn("lines_total", lines)
            .withColumn("diff", F.col("total_amount") - expected)
            .filter(F.col("diff") != 0)
            .select("id", "total_amount", "lines_total", "shipping_fee", "diff"))


# ------------------------------------------------------------------ stock moves
def apply_stock(products: DataFrame, moves: DataFrame) -> DataFrame:
    """Add per-product movements (``product_id``, ``delta``) to ``stock``;
    movements of unknown products change nothing."""
    d = moves.groupBy("product_id").agg(F.sum("delta").alias("__d"))
    j = products.join(d, products.id == d.product_id, "left")
    return j.select(*[F.col(c) for c in products.columns if c != "stock"],
                    (F.col("stock") + F.coalesce(F.col("__d"), F.lit(0))).cast("int").alias("stock"))


# ----------------------------------------------------------------------- O1
def _in_stock() -> Column:
    """Lines that are no pre-order (a missing flag counts as none)."""
    return F.coalesce(F.col("is_preorder"), F.lit(0)) == 0


def _next_id(table: DataFrame, start_id: int | None):
    """First free id: the caller's high-water mark when known (no scan), else
    ``max(id) + 1`` as a scalar subquery (one pass over the id column)."""
    if start_id is not None:
        return F.lit(start_id).cast("bigint")
    return table.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).scalar()


def place_orders(T, requests: DataFrame, lines: DataFrame, as_of: _dt.datetime,
                 start_id: int | None = None) -> dict:
    """O1: headers, lines and stock after a batch of order requests.

    ``requests``: request_id, name, phone, member_id, items_total, shipping_fee
    (optional: total, which stands in for a missing items_total; address, note, slip, shipping_company, member_number,
    payment_method). ``lines``: request_id, product_id, quantity, price,
    is_preorder. New ids follow the current highest id in request order.
    """
    r = with_defaults(requests, {"total": ("decimal(15,2)", None), "address": ("string", None), "note": ("string", None),
                                 "slip": ("string", None), "shipping_company": ("string", None),
                                 "member_number": ("string", None),
                                 "payment_method": ("string", None)})
    items_total = F.coalesce(_int(F.coalesce(F.col("items_total"), F.col("total"))), F.lit(0).cast("bigint"))
    fee = F.coalesce(_int(F.col("shipping_fee")), F.lit(0).cast("bigint"))
    member = _int(F.col("member_id"))
    now = F.lit(as_of.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    numbered = sequence_number(r, [F.col("request_id").asc()], _next_id(T.orders, start_id), "id")
    headers = numbered.select(
        "request_id", "id",
        X.order_number(now, F.col("id")).alias("order_number"),
        X.php_trim(F.coalesce(F.col("name"), F.lit(""))).alias("customer_name"),
        X.phone_digits(X.php_trim(F.coalesce(F.col("phone"), F.lit("")))).alias("customer_phone"),
        X.php_trim(F.coalesce(F.col("address"), F.lit(""))).alias("customer_address"),
        (items_total + fee).alias("total_amount"),
        items_total.alias("items_total"),
        fee.alias("shipping_fee"),
        X.php_trim(F.coalesce(F.col("shipping_company"), F.lit(""))).alias("shipping_company"),
        X.php_trim(F.coalesce(F.col("member_number"), F.lit(""))).alias("member_number"),
        F.coalesce(X.php_trim(F.col("payment_method")), F.lit("transfer")).alias("payment_method"),
        F.coalesce(F.col("slip"), F.lit("")).alias("payment_slip"),
        X.php_trim(F.coalesce(F.col("note"), F.lit(""))).alias("note"),
        F.when(member != 0, member).alias("member_id"),
        F.lit("pending").alias("status"),
        now.alias("created_at"))
    ids = headers.select("request_id", F.col("id").alias("order_id"))
    is_pre = F.when(F.coalesce(F.col("is_preorder").cast("string"), F.lit("")).isin("", "0"), 0) \
        .otherwise(1)
    new_lines = (lines.join(ids, "request_id")
                 .select("order_id", "product_id", "quantity", "price", is_pre.alias("is_preorder")))
    moves = (new_lines.filter(F.col("is_preorder") == 0)
             .select("product_id", (-F.col("quantity")).alias("delta")))
    return {"orders": headers, "lines": new_lines, "moves": moves,
            "products": apply_stock(T.products, moves)}


def tables_after_placing(T, placed: dict, start_line: int | None = None) -> dict:
    """The order and line tables after :func:`place_orders`. New lines get ids
    after the current highest, by order and what they hold. Columns that only the new
    rows have are NULL in the old ones."""
    lines = placed["lines"]
    order = [F.col(c) for c in ("order_id", "product_id", "quantity", "price", "is_preorder")]
    return {"orders": T.orders.unionByName(placed["orders"].drop("request_id"), allowMissingColumns=True),
            "items": T.items.unionByName(sequence_number(lines, order, _next_id(T.items, start_line), "id"),
                                         allowMissingColumns=True)}


# ----------------------------------------------------------------------- O3
def cancel_orders(T, requests: DataFrame, mode: str = "reference") -> dict:
    """O3: customer cancels. A request is applied when the order exists and is
    exactly ``pending``; only the earliest request per order can be applied.
    Restored stock: all lines (``reference``) or non-pre-order lines only."""
    r = requests.withColumn("id", _int(F.col("id")))
    o = T.orders.select("id", F.col("status").alias("__status"), F.lit(True).alias("__exists"))
    first = (latest_per_key(r.select("id", "seq"), ["id"], earliest=True)
             .withColumnRenamed("seq", "__first"))
    tagged = spread_join(r, first.join(o, "id", "left"), ["id"])
    reason = (F.when(F.col("id") == 0, F.lit("missing id"))
              .when(F.col("__exists").isNull(), F.lit("not found"))
              .when(F.col("__status").isNull() | (F.col("__status") != "pending"), F.lit("not pending"))
              .when(F.col("seq") != F.col("__first"), F.lit("not pending")))
    tagged = tagged.withColumn("reason", reason)
    accepted = tagged.filter(F.col("reason").isNull()).select("id", "seq")
    rejected = tagged.filter(F.col("reason").isNotNull()).select("seq", "id", "reason")
    hit = accepted.select("id", F.lit("cancelled").alias("status"))
    orders = merge_update(T.orders, hit, ["id"], ["status"])
    li = spread_join(T.items, accepted.select(F.col("id").alias("order_id")), ["order_id"], "left_semi", by="id")
    if mode == "consistent":
        li = li.filter(_in_stock())
    moves = li.select("product_id", F.col("quantity").alias("delta"))
    return {"accepted": accepted, "rejected": rejected, "orders": orders, "moves": moves,
            "products": apply_stock(T.products, moves)}


# ----------------------------------------------------------------------- O4
def readdress_orders(T, requests: DataFrame) -> DataFrame:
    """Latest address per order, trimmed; no state check."""
    r = requests.withColumn("id", _int(F.col("id"))).filter(F.col("id") != 0)
    latest = latest_per_key(r.select("id", "address", "seq"), ["id"])
    ch = latest.select("id", X.php_trim(F.coalesce(F.col("address"), F.lit("")))
                       .alias("customer_address"))
    base = with_defaults(T.orders, {"customer_address": ("string", None)})
    return merge_update(base, ch, ["id"], ["customer_address"])


def _touched(T, valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The orders that requests name, and their lines: totals are recomputed
    from those lines alone, never from the whole line table."""
    touched = valid.select(F.col("order_id").alias("id")).distinct()
    return touched, spread_join(T.items, touched.withColumnRenamed("id", "order_id"), ["order_id"],
                                "left_semi", by="id")


# ----------------------------------------------------------------------- O5
def edit_item_quantities(T, requests: DataFrame) -> dict:
    """Set line quantities (latest valid request per line wins), then
    recompute the totals of every order named by a valid request. Stock is
    not touched."""
    r = requests.select(_int(F.col("item_id")).alias("item_id"), _int(F.col("order_id")).alias("order_id"),
                        _int(F.coalesce(F.col("quantity"), F.lit(1))).alias("quantity"), "seq")
    valid, rejected = split_valid(r, [
        (F.col("item_id") == 0, "missing item id"),
        (F.col("quantity") < 1, "quantity below 1"),
        (F.col("order_id") == 0, "missing order id"),
    ])
    latest = latest_per_key(valid.select("item_id", "quantity", "seq"), ["item_id"])
    ch = latest.select(F.col("item_id").alias("id"), "quantity")
    items = merge_update(T.items, ch, ["id"], ["quantity"])
    touched, lines = _touched(T, valid)
    orders = T.orders.join(touched, "id", "left_semi")
    totals = order_totals(merge_update(lines, ch, ["id"], ["quantity"]), orders)
    return {"items": items, "totals": totals, "rejected": rejected}


# ----------------------------------------------------------------------- O6
def delete_items(T, requests: DataFrame) -> dict:
    """Delete lines; non-pre-order lines go back to stock; totals of the
    named orders are recomputed (an emptied order keeps its shipping fee)."""
    r = requests.select(_int(F.col("item_id")).alias("item_id"),
                        _int(F.col("order_id")).alias("order_id"), "seq")
    valid, bad = split_valid(r, [
        (F.col("item_id") == 0, "missing item id"),
        (F.col("order_id") == 0, "missing order id"),
    ])
    first = latest_per_key(valid, ["item_id"], earliest=True)
    it = T.items.select(F.col("id").alias("item_id"), "product_id", "quantity", "is_preorder")
    found = first.join(it, "item_id")
    # a line that does not exist, or a repeated delete of one line, is refused
    missing = (valid.join(found.select("item_id", F.col("seq").alias("__s")), "item_id", "left")
               .filter(F.col("__s").isNull() | (F.col("seq") != F.col("__s")))
               .select("item_id", "order_id", "seq", F.lit("not found").alias("reason")))
    rejected = bad.unionByName(missing)
    items = T.items.join(found.select(F.col("item_id").alias("id")), "id", "left_anti")
    moves = (found.filter(_in_stock())
             .select("product_id", F.col("quantity").alias("delta")))
    touched, lines = _touched(T, valid)
    orders = T.orders.join(touched, "id", "left_semi")
    totals = order_totals(lines.join(found.select(F.col("item_id").alias("id")), "id", "left_anti"), orders)
    return {"items": items, "moves": moves, "products": apply_stock(T.products, moves),
            "totals": totals, "rejected": rejected}


# ----------------------------------------------------------------------- O7
def set_status(T, requests: DataFrame) -> DataFrame:
    """Any status string, latest per order; no transition check, no stock."""
    latest = latest_per_key(requests.select(_int(F.col("id")).alias("id"), "status", "seq"), ["id"])
    return merge_update(T.orders, latest.select("id", "status"), ["id"], ["status"])


# ----------------------------------------------------------------------- O8
def stock_ledger(placed_moves: DataFrame, cancel_moves: DataFrame,
                 delete_moves: DataFrame) -> DataFrame:
    """Net stock movement per product from placing, cancelling and line
    deletes, with its parts."""
    parts = (placed_moves.select("product_id", F.col("delta").alias("placed"),
                                 F.lit(0).cast("bigint").alias("cancelled"),
                                 F.lit(0).cast("bigint").alias("deleted"))
             .unionByName(cancel_moves.select("product_id", F.lit(0).cast("bigint").alias("placed"),
                                              F.col("delta").alias("cancelled"),
                                              F.lit(0).cast("bigint").alias("deleted")))
             .unionByName(delete_moves.select("product_id", F.lit(0).cast("bigint").alias("placed"),
                                              F.lit(0).cast("bigint").alias("cancelled"),
                                              F.col("delta").alias("deleted"))))
    return (parts.groupBy("product_id")
            .agg(F.sum("placed").alias("placed"), F.sum("cancelled").alias("cancelled"),
                 F.sum("deleted").alias("deleted"))
            .withColumn("net", F.col("placed") + F.col("cancelled") + F.col("deleted")))


# ------------------------------------------------------------------ U6 - U10
def replace_product_images(T, changes: DataFrame) -> DataFrame:
    """Every product named in ``changes`` (product_id, pos, image_path) loses
    its image rows and gets the non-empty new paths, ``sort_order`` = position."""
    named = changes.select("product_id").distinct()
    kept = T.product_images.join(named, "product_id", "left_anti") \
        .select("product_id", "sort_order", "image_path")
    new = (changes.filter(~X.is_falsy(F.col("image_path")))
           .select("product_id", F.col("pos").cast("int").alias("sort_order"), "image_path"))
    return kept.unionByName(new)


PRODUCT_EDIT_COLUMNS = ["category_id", "name", "description", "price", "cost_price", "stock",
                        "image", "sku", "weight", "dimensions", "colors", "sizes", "status", "pre_order"]


def update_products(T, changes: DataFrame) -> DataFrame:
    """U6 (record part): the latest edit per product overwrites every edited
    column; lists are stored as JSON text (absent → ``[]``), a missing cost or
    pre-order flag becomes 0. Columns not in the form (sort order, created) stay."""
    r = with_defaults(changes, {"colors": ("array<string>", None), "sizes": ("array<string>", None),
                                "cost_price": ("decimal(12,2)", None), "pre_order": ("int", None),
                                "weight": ("string", None), "dimensions": ("string", None)})
    r = r.select(
        _int(F.col("id")).alias("id"), "seq", F.col("category_id").cast("int").alias("category_id"),
        "name", "description", F.col("price").cast("decimal(12,2)").alias("price"),
        F.coalesce(F.col("cost_price").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("cost_price"),
        F.col("stock").cast("int").alias("stock"), "image", "sku", "weight", "dimensions",
        X.encode_list("colors").alias("colors"), X.encode_list("sizes").alias("sizes"), "status",
        F.coalesce(F.col("pre_order").cast("int"), F.lit(0)).alias("pre_order"))
    latest = latest_per_key(r, ["id"])
    base = with_defaults(T.products, {"weight": ("string", None), "dimensions": ("string", None)})
    return merge_update(base, latest.drop("seq"), ["id"], PRODUCT_EDIT_COLUMNS)


def images_from_lists(products: DataFrame, list_col: str = "extra_images") -> DataFrame:
    """U6/U7 request form: an ``extra_images`` array per product → image rows."""
    return (products.select(F.col("id").alias("product_id"),
                            F.posexplode(list_col).alias("sort_order", "image_path"))
            .filter(~X.is_falsy(F.col("image_path"))))


def insert_products(T, new: DataFrame, start_id: int | None = None) -> dict:
    """New products get ids after the current highest, in request
    order; lists are stored as JSON text; missing cost/pre-order default to 0.
    Returns the new ``products`` (all stored columns), their ``images`` (the
    non-empty paths of ``extra_images``, by position) and the whole table ``after``."""
    start = _next_id(T.products, start_id)
    r = with_defaults(new, {"colors": ("array<string>", None), "sizes": ("array<string>", None),
                            "extra_images": ("array<string>", None), "pre_order": ("int", None),
                            "cost_price": ("decimal(12,2)", None),
                            **{c: ("string", None) for c in ("description", "image", "sku", "weight", "dimensions")}})
    numbered = sequence_number(r, [F.col("seq").asc()], start, "id")
    products = numbered.select(
        "id", "category_id", "name", "description", "price",
        F.coalesce(F.col("cost_price").cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)")).alias("cost_price"),
        "stock", "image", "sku", "weight", "dimensions", X.encode_list("colors").alias("colors"), X.encode_list("sizes").alias("sizes"),
        F.coalesce(F.col("pre_order").cast("int"), F.lit(0)).alias("pre_order"))
    return {"products": products, "images": images_from_lists(numbered),
            "after": T.products.unionByName(products, allowMissingColumns=True)}


def delete_products(T, requests: DataFrame) -> dict:
    """U8: products and their image rows go; order lines stay (orphans)."""
    ids = requests.select(_int(F.col("id")).alias("id")).distinct()
    return {"products": T.products.join(ids, "id", "left_anti"),
            "product_images": T.product_images.join(ids.withColumnRenamed("id", "product_id"),
                                                    "product_id", "left_anti")}


def set_stock(T, requests: DataFrame) -> DataFrame:
    """Latest stock per product."""
    latest = latest_per_key(requests.select(_int(F.col("id")).alias("id"),
                                            _int(F.col("stock")).cast("int").alias("stock"), "seq"),
                            ["id"])
    return merge_update(T.products, latest.select("id", "stock"), ["id"], ["stock"])


def reorder_products(T, requests: DataFrame) -> DataFrame:
    """Latest sort order per product."""
    latest = latest_per_key(requests.select(_int(F.col("id")).alias("id"),
                                            _int(F.col("sort_order")).cast("int").alias("sort_order"),
                                            "seq"), ["id"])
    return merge_update(T.products, latest.select("id", "sort_order"), ["id"], ["sort_order"])


# ----------------------------------------------------------------------- U11
def apply_category_changes(T, changes: DataFrame) -> DataFrame:
    """Insert / update / delete requests, checked against the table before
    the batch; of several requests that would store one name, the lowest ``seq``
    is applied. Name checks ignore case and trailing blanks (V13); stored names
    and descriptions are trimmed. Returns every request with ``status`` and
    ``reason``."""
    from kipmart.operators.catalog import name_key
    c = T.categories
    per_name = (c.groupBy(name_key(F.col("name")).alias("__k"))
                .agg(F.count(F.lit(1)).alias("__n"), F.min("id").alias("__min")))
    per_cat = (T.products.groupBy(F.col("category_id").alias("id"))
               .agg(F.count(F.lit(1)).alias("__products")))
    ch = with_defaults(changes, {"description": ("string", None)}).withColumn("__k", name_key(F.col("name")))
    j = ch.join(per_name, "__k", "left").join(per_cat, "id", "left")
    n = F.coalesce(F.col("__n"), F.lit(0))
    other_same_name = (n >= 2) | ((n == 1) & (F.col("__min") != F.col("id")))
    op = F.col("op")
    reason = (F.when((op == "insert") & X.is_falsy(F.col("name")), "name required")
              .when((op == "insert") & (n > 0), "duplicate name")
              .when((op == "update") & (F.col("id").isNull() | (F.col("id") == 0)
                                        | X.is_falsy(F.col("name"))), "missing data")
              .when((op == "update") & other_same_name, "duplicate name")
              .when((op == "delete") & (F.col("id").isNull() | (F.col("id") == 0)), "missing id")
              .when((op == "delete") & (F.coalesce(F.col("__products"), F.lit(0)) > 0), "has products")
              .when(~op.isin("insert", "update", "delete"), "unknown op"))
    j = j.withColumn("reason", reason)
    stores = op.isin("insert", "update") & F.col("reason").isNull()
    firsts = (j.filter(stores).groupBy(F.lower(X.php_trim(F.col("name"))).alias("__k"))
              .agg(F.min("seq").alias("__first")))
    j = j.join(firsts, "__k", "left")
    reason = F.when(stores & (F.col("__first") < F.col("seq")), "duplicate name").otherwise(F.col("reason"))
    return j.select("seq", "op", "id",
                    F.when(op == "delete", F.col("name")).otherwise(X.php_trim(F.col("name")))
                    .alias("name"),
                    X.php_trim(F.coalesce(F.col("description"), F.lit(""))).alias("description"),
                    F.when(reason.isNull(), "applied").otherwise("rejected").alias("status"),
                    reason.alias("reason"))


def categories_after_changes(T, changes: DataFrame, start_id: int | None = None) -> DataFrame:
    """The category table after the applied requests. Renames take the
    highest ``seq`` per category, a deleted category is gone whatever else was
    asked of it, inserts get ids after the current highest in request order."""
    # judged once; renames, deletes and inserts read the result
    done = write_temp_table(apply_category_changes(T, changes).filter(F.col("status") == "applied"), "kipmart-judged")
    renames = latest_per_key(done.filter(F.col("op") == "update").select("id", "name", "description", "seq"), ["id"])
    base = with_defaults(T.categories, {"description": ("string", None)}).select("id", "name", "description")
    kept = merge_update(base, renames, ["id"], ["name", "description"]) \
        .join(done.filter(F.col("op") == "delete").select("id").distinct(), "id", "left_anti")
    new = sequence_number(done.filter(F.col("op") == "insert").select("seq", "name", "description"),
                          [F.col("seq").asc()], _next_id(T.categories, start_id), "id")
    return kept.unionByName(new.select("id", "name", "description"))
