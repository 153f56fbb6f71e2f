"""Order reads.

Point lookups of the reference (one member, one phone, one order) are served
in bulk: a request table is equi-joined to the orders on a derived key, so a
million lookups cost one shuffle join instead of a million scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X

PENDING_BUCKET = ("pending", "confirmed", "shipped")
DONE_BUCKET = ("delivered",)


def _newest():
    return [F.col("created_at").desc(), F.col("id").asc()]


def orders_by_member(T, members: DataFrame | None = None) -> DataFrame:
    """F8: orders of each requested member (column ``id``), newest first."""
    m = (members if members is not None else T.members).select(F.col("id").alias("member_id"))
    return T.orders.join(m, "member_id", "left_semi").orderBy(F.col("member_id"), *_newest())


def orders_by_phone(T, requests: DataFrame | None = None) -> DataFrame:
    """orders whose stored phone ends like each requested phone.

    Both sides get a materialised last-8 key, so the lookup is an equi-join.
    """
    r = (requests if requests is not None else T.members).select(
        F.col("phone").alias("request_phone"))
    r = r.withColumn("phone8", X.request_phone8(F.col("request_phone"))).distinct()
    o = T.orders.withColumn("phone8", X.phone_last8(F.col("customer_phone")))
    return (o.join(r, "phone8").drop("phone8")
            .orderBy(F.col("request_phone"), *_newest()))


def order_bucket(col="status"):
    s = F.col(col)
    return (F.when(s.isin(*PENDING_BUCKET), "pending")
            .when(s.isin(*DONE_BUCKET), "done").otherwise("other"))


def orders_bucketed(T) -> DataFrame:
    """the customer page's tab for every order, in one column."""
    return T.orders.select("id", "status", order_bucket().alias("bucket"))


def orders_by_status(T, status: str | None = None) -> DataFrame:
    """admin list; ``status=None`` is the server behaviour (no filter)."""
    o = T.orders
    if status is not None:
        o = o.filter(F.col("status") == status)
    return o.orderBy(*_newest())


def order_detail(T, orders: DataFrame | None = None) -> DataFrame:
    """Lines with product name and image; lines of deleted products stay
    with NULLs. ``orders`` (column ``id``) narrows to some orders."""
    i = T.items
    if orders is not None:
        i = i.join(orders.select(F.col("id").alias("order_id")), "order_id", "left_semi")
    p = T.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                          F.col("image").alias("product_image"))
    return (i.join(p, "product_id", "left")
            .select("id", "order_id", "product_id", "quantity", "price", "is_preorder",
                    "product_name", "product_image",
                    (F.col("price") * F.col("quantity")).alias("line_total")))


def orders_with_preorder_count(T) -> DataFrame:
    """Every order with its count of pre-order lines (the correlated
    subquery as a left join to a per-order pre-aggregate), newest first."""
    n = (T.items.filter(F.col("is_preorder") == 1).groupBy("order_id")
         .agg(F.count(F.lit(1)).alias("has_preorder")))
    o = T.orders
    return (o.join(n, o.id == n.order_id, "left").drop("order_id")
            .withColumn("has_preorder", F.coalesce(F.col("has_preorder"), F.lit(0)))
            .orderBy(*_newest()))


def phones_normalised(T) -> DataFrame:
    """T1-T3 over every stored phone."""
    return T.orders.select("id", "customer_phone",
                           X.phone_digits(X.php_trim(F.col("customer_phone"))).alias("digits"),
                           X.phone_no_blanks(F.col("customer_phone")).alias("no_blanks"),
                           X.phone_last8(F.col("customer_phone")).alias("phone8"))


def money_text(T) -> DataFrame:
    """T12 over order totals and shipping fees."""
    return T.orders.select("id", X.money_text(F.col("total_amount")).alias("total_text"),
                           X.money_text(F.col("shipping_fee")).alias("fee_text"))


def order_status_labels(T) -> DataFrame:
    """Admin and customer labels of every order's status."""
    return T.orders.select(
        "id", "status",
        X.status_label(F.col("status"), X.ADMIN_STATUS_LABELS).alias("admin_label"),
        X.status_label(F.col("status"), X.CUSTOMER_STATUS_LABELS).alias("customer_label"))


def display_dates(T) -> DataFrame:
    """Formatted order dates; ``—`` when missing."""
    return T.orders.select("id", X.display_date(F.col("created_at")).alias("created_text"))


def order_numbers(T) -> DataFrame:
    """O2: the number of every order."""
    return T.orders.select("id", X.order_number(F.col("created_at"), F.col("id")).alias("order_number"))


def orders_from_json(encoded: DataFrame, column: str = "json") -> DataFrame:
    """S4, read back: the columns of order rows that were written as JSON texts."""
    fields = {"id": "bigint", "order_number": "string", "customer_phone": "string", "total_amount": "decimal(15,2)",
              "payment_method": "string", "status": "string", "member_id": "bigint", "created_at": "string"}
    schema = ", ".join(f"{n} {t}" for n, t in fields.items())
    return encoded.select(F.explode(F.array(F.from_json(F.col(column), schema))).alias("r")).select(
        *[F.col(f"r.{n}") for n in fields if n != "created_at"], F.left(F.replace(F.col("r.created_at"), F.lit("T"), F.lit(" ")), F.lit(19)).alias("created_at"))
