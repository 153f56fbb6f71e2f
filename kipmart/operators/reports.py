"""Sales, profit and pre-order reports.

Plan shape, chosen for large fact tables:

* order lines are **pre-aggregated** by the join key they need next
  (``product_id`` or ``order_id``/``(order_id, product_id)``) before they meet
  a dimension, so the product join sees one row per product, not one per line;
* "is the order live" is a ``left_semi`` join when no order column is needed;
  when the month/day is needed only ``id`` and ``created_at`` are carried;
* period filters are ranges on ``created_at`` and reach the Parquet scan;
* aggregates are two-phase (partial → final), so a hot product or day is
  collapsed map-side before any shuffle; AQE splits a hot ``order_id`` in the
  line ⋈ order join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.functions import calendar as cal

CANCELLED = "cancelled"


def _live(col="status"):
    # V1: NULL status is dropped too (three-valued logic), as in the reference.
    return F.col(col) != CANCELLED


def _amount_sum(cond, amount="total_amount"):
    return F.sum(F.when(cond, F.col(amount)).otherwise(F.lit(0)))


def _orders_in(T, kind: str | None = None, value=None) -> DataFrame:
    """Orders of a period. On tables stored by order month the matching
    partition predicate is added, so other months are never listed."""
    o = T.orders
    pred = cal.period_filter(F.col("created_at"), kind, value)
    part = cal.month_partition_filter(kind, value)
    if part is not None and cal.MONTH_PARTITION in o.columns:
        pred = pred & part
    return o.filter(pred)


def _items_in(T, kind: str | None = None, value=None) -> DataFrame:
    """Order lines, pruned to the period's months when the line table is
    stored by order month (the order join still decides exactly)."""
    i = T.items
    part = cal.month_partition_filter(kind, value)
    if part is not None and cal.MONTH_PARTITION in i.columns:
        i = i.filter(part)
    return i


# --------------------------------------------------------------------------- R1
def sales_summary(T, month: str | None = None) -> DataFrame:
    """Eight conditional measures in one scan (V2, V3, V4)."""
    o = _orders_in(T, "month", month)
    live = _live()
    transfer = (F.col("payment_method") == "transfer") & live
    cod = (F.col("payment_method") == "cod") & live
    cancelled = F.col("status") == CANCELLED
    return o.agg(
        F.sum("total_amount").alias("total"),
        F.count(F.lit(1)).alias("count"),
        _amount_sum(transfer).alias("transfer_total"),
        _amount_sum(cod).alias("cod_total"),
        _amount_sum(cancelled).alias("cancelled_total"),
        F.count(F.when(cancelled, 1)).alias("cancelled_count"),
        F.count(F.when(transfer, 1)).alias("transfer_count"),
        F.count(F.when(cod, 1)).alias("cod_count"),
    )


# --------------------------------------------------------------------- R2 / F4
def active_products(T) -> DataFrame:
    return T.products.filter(F.col("status") == "active")


def active_product_count(T) -> DataFrame:
    """R2."""
    return active_products(T).agg(F.count(F.lit(1)).alias("count"))


def low_stock(T, threshold: int = 5) -> DataFrame:
    """active products with ``stock < threshold`` (all columns)."""
    return active_products(T).filter(F.col("stock") < threshold)


def stock_flag(T, threshold: int = 5) -> DataFrame:
    """the red/green stock flag of the product table."""
    p = T.products
    return p.select("id", "stock",
                    F.when(F.col("stock") < threshold, "low").otherwise("ok").alias("stock_flag"))


# --------------------------------------------------------------------------- R4
def sales_monthly(T, n: int = 12) -> DataFrame:
    """Latest ``n`` months that have orders (V11), newest first."""
    o = T.orders.select("created_at", "status", "payment_method", "total_amount")
    live = _live()
    return (o.groupBy(cal.month_key(F.col("created_at")).alias("month"))
            .agg(_amount_sum(live).alias("total"),
                 _amount_sum((F.col("payment_method") == "transfer") & live).alias("transfer_total"),
                 _amount_sum((F.col("payment_method") == "cod") & live).alias("cod_total"),
                 F.count(F.lit(1)).alias("orders"),
                 F.count(F.when(F.col("status") == CANCELLED, 1)).alias("cancelled"))
            .orderBy(F.col("month").desc())
            .limit(n))


# ------------------------------------------------------------- shared line bases
def live_lines(T, month: str | None = None) -> DataFrame:
    """Order lines of non-cancelled orders (optionally one month), semi-joined:
    the order table only contributes its key."""
    o = _orders_in(T, "month", month).filter(_live()).select(F.col("id").alias("order_id"))
    return _items_in(T, "month", month).join(o, "order_id", "left_semi")


def _per_product(lines: DataFrame) -> DataFrame:
    q = F.col("quantity")
    return lines.groupBy("product_id").agg(
        F.sum(q).alias("qty"),
        F.sum(q * F.col("price")).alias("revenue"))


def _with_cost(agg: DataFrame, T) -> DataFrame:
    """Inner join to products (J1: lines of deleted products vanish) and cost."""
    p = T.products.select(F.col("id").alias("product_id"), "name", "sku", "image", "cost_price")
    j = agg.join(p, "product_id")
    return j.withColumn("cost", F.col("qty") * F.coalesce(F.col("cost_price"), F.lit(0)))


# --------------------------------------------------------------------------- R5
def top_products(T, n: int = 10) -> DataFrame:
    """Units and revenue of non-cancelled lines per product, top ``n`` by
    units (ties by id, V10)."""
    agg = _per_product(live_lines(T))
    p = T.products.select(F.col("id").alias("product_id"), "name", "sku", "image")
    return (agg.join(p, "product_id")
            .select(F.col("product_id").alias("id"), "name", "sku", "image",
                    F.col("qty").alias("total_qty"), F.col("revenue").alias("total_revenue"))
            .orderBy(F.col("total_qty").desc(), F.col("id").asc())
            .limit(n))


# --------------------------------------------------------------------- R6 - R8
def profit_overall(T, month: str | None = None) -> DataFrame:
    """Revenue, cost, profit, units; zeros on empty input."""
    j = _with_cost(_per_product(live_lines(T, month)), T)
    rev = F.coalesce(F.sum("revenue"), F.lit(0))
    cost = F.coalesce(F.sum("cost"), F.lit(0))
    return j.agg(rev.alias("revenue"), cost.alias("cost"), (rev - cost).alias("profit"),
                 F.coalesce(F.sum("qty"), F.lit(0)).alias("units_sold"))


def profit_by_product(T, month: str | None = None, n: int = 15) -> DataFrame:
    """Per-product profit, top ``n`` (ties by id)."""
    j = _with_cost(_per_product(live_lines(T, month)), T)
    return (j.select(F.col("product_id").alias("id"), "name", "sku", "image", "cost_price",
                     "qty", "revenue", "cost", (F.col("revenue") - F.col("cost")).alias("profit"))
            .orderBy(F.col("profit").desc(), F.col("id").asc())
            .limit(n))


def _month_lines(T) -> DataFrame:
    """Lines of live orders with the order's month."""
    o = (T.orders.filter(_live())
         .select(F.col("id").alias("order_id"), cal.month_key(F.col("created_at")).alias("month")))
    return T.items.select("order_id", "product_id", "quantity", "price").join(o, "order_id")


def _month_product_base(T) -> DataFrame:
    """Live lines collapsed to one row per (month, product), with cost."""
    q = F.col("quantity")
    per = _month_lines(T).groupBy("month", "product_id").agg(
        F.sum(q).alias("qty"), F.sum(q * F.col("price")).alias("revenue"))
    return _with_cost(per, T)


def profit_by_month(T, n: int = 12) -> DataFrame:
    """Profit per month over all time, newest ``n`` months. Lines meet their
    product one by one: nearly each is its own (month, product), and groups of
    those would only fill a task's memory; months are few."""
    p = T.products.select(F.col("id").alias("product_id"), "cost_price")
    lines = _month_lines(T).join(p, "product_id")
    q = F.col("quantity")
    return (lines.groupBy("month")
            .agg(F.sum(q * F.col("price")).alias("revenue"),
                 F.sum(q * F.coalesce(F.col("cost_price"), F.lit(0))).alias("cost"))
            .withColumn("profit", F.col("revenue") - F.col("cost"))
            .orderBy(F.col("month").desc())
            .limit(n))


def profit(T, month: str | None = None, n_products: int = 15, n_months: int = 12,
           materialize: bool = False) -> dict[str, DataFrame]:
    """The ``profit`` report bundle over one shared base.

    The line ⋈ order ⋈ product work is done once, down to one row per
    (month, product); the three parts are small aggregates of that base. With
    ``materialize=True`` the base is checkpointed (reliable storage) so the
    three parts do not recompute it.
    """
    base = _month_product_base(T)
    if materialize:
        from kipmart.plans.materialize import cut_lineage
        base = cut_lineage(base)
    in_month = base
    if month and cal._MONTH_RE.match(month):  # malformed month = no filter
        in_month = base.filter(F.col("month") == month)
    rev = F.coalesce(F.sum("revenue"), F.lit(0))
    cost = F.coalesce(F.sum("cost"), F.lit(0))
    overall = in_month.agg(rev.alias("revenue"), cost.alias("cost"), (rev - cost).alias("profit"),
                           F.coalesce(F.sum("qty"), F.lit(0)).alias("units_sold"))
    by_product = (in_month.groupBy(F.col("product_id").alias("id"), "name", "sku", "image", "cost_price")
                  .agg(F.sum("qty").alias("qty"), F.sum("revenue").alias("revenue"),
                       F.sum("cost").alias("cost"))
                  .withColumn("profit", F.col("revenue") - F.col("cost"))
                  .orderBy(F.col("profit").desc(), F.col("id").asc()).limit(n_products))
    by_month = (base.groupBy("month")
                .agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"))
                .withColumn("profit", F.col("revenue") - F.col("cost"))
                .orderBy(F.col("month").desc()).limit(n_months))
    return {"overall": overall, "by_product": by_product, "by_month": by_month}


# --------------------------------------------------------------------------- R9
def status_counts(T, month: str | None = None) -> DataFrame:
    """Count and total per status; the NULL status group is kept."""
    o = _orders_in(T, "month", month)
    return o.groupBy("status").agg(F.count(F.lit(1)).alias("cnt"),
                                   F.sum("total_amount").alias("total"))


# -------------------------------------------------------------------------- R10
def sales_daily(T, month: str | None, as_of: _dt.date | None = None) -> DataFrame:
    """Per day of one month (default: the month of ``as_of``), ascending."""
    m = cal.month_or_current(month, as_of or _dt.date.today())
    o = _orders_in(T, "strict_month", m)
    return (o.groupBy(F.to_date("created_at").alias("day"))
            .agg(_amount_sum(_live()).alias("total"),
                 F.count(F.lit(1)).alias("orders"),
                 F.count(F.when(F.col("status") == CANCELLED, 1)).alias("cancelled"))
            .orderBy("day"))


# --------------------------------------------------------------------------- F2
def day_orders(T, day: str | None, as_of: _dt.date | None = None) -> DataFrame:
    """F2 (R11): orders of one day, newest first (ties by id)."""
    if not day or not cal._DATE_RE.match(day):
        day = (as_of or _dt.date.today()).strftime("%Y-%m-%d")
    o = _orders_in(T, "day", day)
    return (o.select("id", "order_number", "customer_name", "customer_phone", "total_amount",
                     "payment_method", "status", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("id").asc()))


# ------------------------------------------------------------------- R12 - R16
def _preorder_per_order(T, kind: str | None = None, value=None) -> DataFrame:
    """Pre-order lines of live orders, collapsed to one row per order before the
    join, so ``COUNT(DISTINCT o.id)`` becomes a plain count."""
    q = F.col("quantity")
    per_order = (_items_in(T, kind, value).filter(F.col("is_preorder") == 1)
                 .groupBy("order_id")
                 .agg(F.sum(q).alias("units"), F.sum(q * F.col("price")).alias("value")))
    o = _orders_in(T, kind, value).filter(_live()).select(F.col("id").alias("order_id"), "created_at")
    return per_order.join(o, "order_id")


def _period_agg(df: DataFrame, key, *labels) -> DataFrame:
    return (df.groupBy(key.alias("period_key"))
            .agg(*labels,
                 F.count(F.lit(1)).alias("order_count"),
                 F.coalesce(F.sum("units"), F.lit(0)).alias("total_units"),
                 F.coalesce(F.sum("value"), F.lit(0)).alias("total_value"))
            .orderBy("period_key"))


def _labelled(per: DataFrame, label) -> DataFrame:
    """The period's label, made from its key: text inside the aggregate would
    turn it into a sort-based one."""
    rest = [c for c in per.columns if c != "period_key"]
    return per.select("period_key", label.alias("period_label"), *rest)


def preorder_by_day(T, month: str | None, as_of: _dt.date | None = None) -> DataFrame:
    """Pre-order activity per day of one month."""
    m = cal.month_or_current(month, as_of or _dt.date.today())
    df = _preorder_per_order(T, "strict_month", m)
    return _labelled(_period_agg(df, F.to_date("created_at")), cal.day_label(F.col("period_key")))


def preorder_by_week(T, year: int) -> DataFrame:
    """Per ISO week of orders placed in calendar ``year`` (V7, V8). The label
    is taken from the group's first observed day, as the reference does."""
    df = _preorder_per_order(T, "year", year)
    per = _period_agg(df, cal.iso_week_key(F.col("created_at")), F.min(F.to_date("created_at")).alias("week_start"))
    return _labelled(per, cal.week_label(F.col("week_start")))


def preorder_by_year(T) -> DataFrame:
    """R14."""
    df = _preorder_per_order(T)
    per = _period_agg(df, F.year("created_at"))
    return _labelled(per, cal.year_label(F.make_date(F.col("period_key"), F.lit(1), F.lit(1))))


def preorder_by_month(T, year: int) -> DataFrame:
    """Per month of ``year`` with the Lao month label."""
    df = _preorder_per_order(T, "year", year)
    per = _period_agg(df, cal.month_key(F.col("created_at")))
    return _labelled(per, cal.lao_month_label(F.to_date(F.concat("period_key", F.lit("-01")))))


def preorder_years(T) -> DataFrame:
    """Distinct years with live pre-order lines, newest first."""
    df = _preorder_per_order(T)
    return df.select(F.year("created_at").alias("y")).distinct().orderBy(F.col("y").desc())


# ------------------------------------------------------------------- R17 - R19
def _preorder_lines(T) -> DataFrame:
    o = T.orders.filter(_live()).select(F.col("id").alias("order_id"), "customer_phone")
    return T.items.filter(F.col("is_preorder") == 1).join(o, "order_id")


def preorder_summary(T) -> DataFrame:
    """Lines, units, value, distinct products, distinct phones. No product
    join here (V12)."""
    q = F.col("quantity")
    return _preorder_lines(T).agg(
        F.count(F.lit(1)).alias("total_lines"),
        F.coalesce(F.sum(q), F.lit(0)).alias("total_units"),
        F.coalesce(F.sum(q * F.col("price")), F.lit(0)).alias("total_value"),
        F.count_distinct("product_id").alias("unique_products"),
        F.count_distinct("customer_phone").alias("unique_customers"))


def preorder_lines(T) -> DataFrame:
    """Pre-order detail over the 3-way join, newest first (ties by line id)."""
    i = T.items.filter(F.col("is_preorder") == 1).select(
        "id", "quantity", "price", "product_id", "order_id")
    p = T.products.select(F.col("id").alias("product_id"),
                          F.coalesce("name_lo", "name").alias("product_name"),
                          F.col("image").alias("product_image"), "sku")
    o = T.orders.filter(_live()).select(
        F.col("id").alias("order_id"), "order_number", "customer_name", "customer_phone",
        "status", "payment_method", "created_at")
    return (i.join(p, "product_id").join(o, "order_id")
            .select("id", "quantity", "price", "product_id", "product_name", "product_image",
                    "sku", "order_id", "order_number", "customer_name", "customer_phone",
                    "status", "payment_method", "created_at")
            .orderBy(F.col("created_at").desc(), F.col("id").asc()))


def preorder_by_product(T) -> DataFrame:
    """Units and distinct orders per product, by units descending."""
    o = T.orders.filter(_live()).select(F.col("id").alias("order_id"))
    per = (T.items.filter(F.col("is_preorder") == 1).join(o, "order_id", "left_semi")
           .groupBy("product_id")
           .agg(F.sum("quantity").alias("total_units"),
                F.count_distinct("order_id").alias("order_count")))
    p = T.products.select(F.col("id").alias("product_id"),
                          F.coalesce("name_lo", "name").alias("product_name"),
                          F.col("image").alias("product_image"), "sku")
    return (per.join(p, "product_id")
            .orderBy(F.col("total_units").desc(), F.col("product_id"))
            .select("product_name", "product_image", "sku", "total_units", "order_count"))
