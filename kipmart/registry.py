"""Named queries: key → callable(spark, sf_dir) → DataFrame (wire format).

Each key is one operator of the inventory, run over whole tables with the
request parameters of :mod:`kipmart.params`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart import params as P
from kipmart.functions import text as X
from kipmart.operators import cart as K
from kipmart.operators import catalog as C
from kipmart.operators import categorylog as G
from kipmart.operators import changes as U
from kipmart.operators import members as M
from kipmart.operators import orderlog as L
from kipmart.operators import orders as O
from kipmart.operators import reports as R
from kipmart.operators import search as H
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.wire import as_json, to_wire
from kipmart.sources import requests as S
from kipmart.sources.layout import mixed_versions
from kipmart.sources.tables import load_shop

REGISTRY: dict[str, Callable] = {}


def register(key: str, fn: Callable, wire: bool = True):
    REGISTRY[key] = (fn, wire)


_SHOPS: dict = {}


def _shop(spark: SparkSession, sf_dir: str):
    """One table namespace per (session, folder): the fixture adapter derives
    each shop table once, writes it as clustered Parquet under
    ``spark.checkpoint.dir``, and every query of the run scans that (the
    production read path, with pushdown on the shop columns)."""
    try:
        app = spark.sparkContext.applicationId
    except Exception:  # Spark Connect
        app = spark.conf.get("spark.app.id", "")
    key = (app, id(spark), sf_dir)
    if key not in _SHOPS:
        _SHOPS[key] = load_shop(spark, sf_dir, materialize=True)
    return _SHOPS[key]


def _shop_query(fn, wire):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(_shop(spark, sf_dir))
        return to_wire(df) if wire else df
    return run


# reports
register("sales_summary", lambda T: R.sales_summary(T))
register("sales_summary_month", lambda T: R.sales_summary(T, P.MONTH))
register("active_product_count", R.active_product_count)
register("low_stock", lambda T: R.low_stock(T, P.LOW_STOCK))
register("stock_flag", lambda T: R.stock_flag(T, P.LOW_STOCK))
register("sales_monthly", R.sales_monthly)
register("top_products", R.top_products)
register("profit_overall", lambda T: R.profit_overall(T))
register("profit_overall_month", lambda T: R.profit_overall(T, P.MONTH))
register("profit_by_product", lambda T: R.profit_by_product(T))
register("profit_by_month", R.profit_by_month)
register("status_counts", lambda T: R.status_counts(T))
register("sales_daily", lambda T: R.sales_daily(T, P.MONTH, P.AS_OF.date()))
register("day_orders", lambda T: R.day_orders(T, P.DAY, P.AS_OF.date()))
register("preorder_by_day", lambda T: R.preorder_by_day(T, P.MONTH, P.AS_OF.date()))
register("preorder_by_week", lambda T: R.preorder_by_week(T, P.YEAR))
register("preorder_by_year", R.preorder_by_year)
register("preorder_by_month", lambda T: R.preorder_by_month(T, P.YEAR))
register("preorder_years", R.preorder_years)
register("preorder_summary", R.preorder_summary)
register("preorder_lines", R.preorder_lines)
register("preorder_by_product", R.preorder_by_product)

# catalogue
register("category_by_id", lambda T: C.category_by_id(T, C.category_requests(T)))
register("category_product_counts", C.category_product_counts)
register("deletable_categories", C.deletable_categories)
register("category_name_duplicates", C.category_name_duplicates)
register("category_name_conflicts", C.category_name_conflicts)
register("category_list_numbered", C.category_list_numbered)
register("product_listing", lambda T: C.listing_as_text(C.product_listing(T)))
register("product_search", lambda T: C.listing_as_text(C.product_listing(T, search=P.SEARCH)))
register("product_search_bulk", lambda T: H.product_search_bulk(T, H.search_requests(T)))
register("product_listing_category",
         lambda T: C.listing_as_text(C.product_listing(T, active_only=False, category=P.CATEGORY)))
register("product_listing_total", C.product_listing_total)
register("product_gallery", lambda T: C.product_gallery(T).select(
    "product_id", F.array_join("images", "|").alias("gallery")))
register("product_single", lambda T: C.listing_as_text(C.product_single(T)).withColumn("images", F.array_join("images", "|")))
register("check_stock", lambda T: C.check_stock(T, C.stock_check_requests(T)))
register("product_colors", C.product_colors)
register("product_sizes", C.product_sizes)
register("colors_hex", C.colors_hex)

# order reads
register("orders_by_member", O.orders_by_member)
register("orders_by_phone", O.orders_by_phone)
register("orders_bucketed", O.orders_bucketed)
register("orders_by_status", lambda T: O.orders_by_status(T, P.STATUS))
register("order_detail", O.order_detail)
register("orders_with_preorder_count", O.orders_with_preorder_count)
register("phones_normalised", O.phones_normalised)
register("money_text", O.money_text)
register("order_status_labels", O.order_status_labels)
register("display_dates", O.display_dates)
register("order_numbers", O.order_numbers)

# members and codes
def _otps(T):
    return T.derived("otps", lambda T: M.latest_otp_per_phone(T.table("otp_requests")))


def _checked(T):
    return T.derived("otp_checked", lambda T: M.otp_attempts_checked(_otps(T), T.table("otp_attempts")))


register("latest_otp_per_phone", _otps)
register("otp_attempts_checked", _checked)
register("otps_remaining", lambda T: M.otps_remaining(_otps(T), _checked(T)))
register("otps_rearmed", lambda T: M.otps_rearmed(_otps(T), _checked(T)))

def _as_of(T):
    return T.derived("otp_as_of", lambda T: M.otp_attempts_as_of(T.table("otp_requests"), T.table("otp_attempt_log")))


register("otp_attempts_as_of", _as_of)
register("otps_after_log", lambda T: M.otps_after_log(T.table("otp_requests"), _as_of(T)))
register("otp_tokens_checked", lambda T: M.otp_tokens_checked(
    T.table("otp_requests"), M.otp_tokens_issued(_as_of(T)), T.table("token_attempts")))
register("known_phone_requests",
         lambda T: M.known_phone_requests(T.table("otp_requests"), T.members).select("seq", "phone"))
register("new_phone_requests",
         lambda T: M.new_phone_requests(T.table("otp_requests"), T.members).select("seq", "phone"))
register("members_upserted", lambda T: M.members_upserted(T.members, T.table("chg_members")))
register("member_display_name", lambda T: M.member_display_name(T.members))
register("member_initials", lambda T: M.member_initials(T.members))


# order and catalogue change batches
def _placed(T):
    return T.derived("placed", lambda T: U.place_orders(T, T.table("req_orders"),
                                                        T.table("req_order_items"), P.AS_OF))


def _cancel(T):
    return T.derived("cancel", lambda T: U.cancel_orders(T, T.table("chg_cancel")))


def _edit(T):
    return T.derived("edit", lambda T: U.edit_item_quantities(T, T.table("chg_item_qty")))


def _delete(T):
    return T.derived("delete", lambda T: U.delete_items(T, T.table("chg_item_delete")))


def _log(T):
    return T.derived("order_log_replayed", lambda T: L.replay_order_log(T, T.table("order_log")))


register("order_log_replayed", lambda T: _log(T)["orders"])
register("order_log_lines", lambda T: _log(T)["items"].select("id", "order_id", "quantity"))
register("order_log_stock", lambda T: _log(T)["products"].select("id", "stock"))
register("order_log_rejected", lambda T: _log(T)["rejected"])
register("orders_with_shipping_defaults", U.orders_with_shipping_defaults)
register("order_totals_recomputed", U.order_totals_recomputed)
register("order_total_mismatch", U.order_total_mismatch)
register("orders_placed", lambda T: _placed(T)["orders"])
register("order_lines_placed", lambda T: _placed(T)["lines"])
register("stock_after_orders", lambda T: _placed(T)["products"].select("id", "stock"))
register("orders_after_cancel", lambda T: _cancel(T)["orders"].select("id", "status"))
register("stock_after_cancel", lambda T: _cancel(T)["products"].select("id", "stock"))
register("cancel_rejected", lambda T: _cancel(T)["rejected"])
register("orders_readdressed",
         lambda T: U.readdress_orders(T, T.table("chg_address")).select("id", "customer_address"))
register("items_after_edit", lambda T: _edit(T)["items"].select("id", "order_id", "quantity"))
register("totals_after_edit", lambda T: _edit(T)["totals"])
register("order_edits_rejected", lambda T: _edit(T)["rejected"])
register("items_after_delete",
         lambda T: _delete(T)["items"].select("id", "order_id", "product_id", "quantity"))
register("stock_after_item_delete", lambda T: _delete(T)["products"].select("id", "stock"))
register("totals_after_delete", lambda T: _delete(T)["totals"])
register("orders_status_set", lambda T: U.set_status(T, T.table("chg_status")).select("id", "status"))
register("stock_ledger", lambda T: U.stock_ledger(_placed(T)["moves"], _cancel(T)["moves"],
                                                  _delete(T)["moves"]))
register("product_images_replaced", lambda T: U.replace_product_images(T, T.table("chg_product_images")))
register("products_updated", lambda T: U.update_products(T, T.table("chg_product_update")).select(
    "id", "category_id", "name", "price", "cost_price", "stock", "colors", "sizes", "status", "pre_order"))
def _inserted(T):
    return T.derived("inserted", lambda T: U.insert_products(T, T.table("new_products")))


register("products_inserted", lambda T: _inserted(T)["products"])
register("product_images_inserted", lambda T: _inserted(T)["images"])
register("products_after_delete",
         lambda T: U.delete_products(T, T.table("chg_product_delete"))["products"].select("id", "name"))
register("product_images_after_delete",
         lambda T: U.delete_products(T, T.table("chg_product_delete"))["product_images"])
register("stock_set", lambda T: U.set_stock(T, T.table("chg_stock")).select("id", "stock"))
register("products_reordered",
         lambda T: U.reorder_products(T, T.table("chg_sort")).select("id", "sort_order"))
register("category_changes_applied",
         lambda T: U.apply_category_changes(T, T.table("chg_categories")).drop("description"))
register("categories_after_changes", lambda T: U.categories_after_changes(T, T.table("chg_categories")))


def _category_log(T):
    return T.derived("category_log_replayed", lambda T: G.replay_category_log(T, T.table("category_log")))


register("category_log_judged", lambda T: _category_log(T)["requests"])
register("categories_replayed", lambda T: _category_log(T)["categories"])

# carts
register("cart_replay", lambda T: K.cart_replay(T.table("cart_events")))
register("cart_running", lambda T: K.cart_running(T.table("cart_events")))
register("cart_totals", lambda T: K.cart_totals(K.cart_replay(T.table("cart_events"))))
register("cart_key_slug", lambda T: K.cart_key_slug(K.cart_replay(T.table("cart_events"))))
register("cart_lines_normalised",
         lambda T: K.cart_lines_normalised(K.cart_replay(T.table("cart_events")), T.products))
register("cart_merged", lambda T: K.cart_merged(T.table("cart_events"), T.products))
register("carrier_map", lambda T: K.carrier_map(T.table("carrier_events")))


# sources, sinks, scalar helpers
def _parsed_requests(T):
    bodies = S.order_request_bodies(T.table("req_orders"), T.table("req_order_items"))
    parsed = S.parse_order_requests(bodies)
    return (parsed.select("request_id", "name", "phone", F.explode("items").alias("i"))
            .select("request_id", "name", "phone", F.col("i.id").alias("product_id"),
                    F.col("i.qty").alias("qty"), F.col("i.price").alias("price"),
                    F.col("i.is_preorder").alias("is_preorder")))


register("order_requests_parsed", _parsed_requests)
register("escaped_text", lambda T: T.table("documents").select(
    "doc_id", X.html_escape(F.col("text")).alias("escaped")))

def _mixed_versions(T):
    """Orders up to 1995 as they were stored before the shipping migration, later ones after it."""
    early = F.col("created_at") < F.lit("1996-01-01").cast("timestamp_ntz")
    old = write_temp_table(T.orders.filter(early).drop("shipping_fee", "shipping_company", "payment_method"), "kipmart-v1")
    new = write_temp_table(T.orders.filter(~early), "kipmart-v2")
    return mixed_versions([old, new], U.ORDER_DEFAULTS)


register("orders_mixed_versions", lambda T: _mixed_versions(T).select(
    "id", "status", "items_total", "shipping_fee", "shipping_company", "payment_method", "created_at"))
register("orders_as_json", lambda T: O.orders_from_json(as_json(T.orders)))
register("orders_after_placing", lambda T: U.tables_after_placing(T, _placed(T))["orders"].select(
    "id", "customer_phone", "status", "total_amount", "created_at"))
register("items_after_placing", lambda T: U.tables_after_placing(T, _placed(T))["items"].select(
    "id", "order_id", "product_id", "quantity", "price", "is_preorder"))
register("fit_ratio", lambda T: T.table("image_sizes").select(
    "id", X.fit_ratio(F.col("w"), F.col("h")).alias("ratio"),
    X.js_round(F.col("w") * X.fit_ratio(F.col("w"), F.col("h"))).alias("w2"),
    X.js_round(F.col("h") * X.fit_ratio(F.col("w"), F.col("h"))).alias("h2")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: _shop_query(fn, wire) for k, (fn, wire) in REGISTRY.items()}
