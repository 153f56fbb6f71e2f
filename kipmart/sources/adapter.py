"""Fixture adapter: shop tables and change batches derived from the driver's
TPC-H-style tables.

Each view is SQL text shared by Spark and the DuckDB oracle, so both sides of
the correctness check start from identical inputs. ``{name}`` placeholders are
filled with DataFrames on the Spark side (``spark.sql(text, name=df)``) and with
plain table names on the oracle side. Where the natural Spark form differs from
the portable text (row fan-out by ``explode`` instead of a join with a literal
table) the Spark text is given separately; both produce the same rows.

In production the shop tables exist natively and :func:`kipmart.sources.tables.load_shop`
reads them directly; this module only exists to turn the test data into them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    name: str
    deps: tuple[str, ...]
    sql: str
    spark_sql: str | None = None
    spark_fn: Callable[..., DataFrame] | None = None
    #: the Spark form comes out of a sort by range in the stored order
    in_order: bool = False

    def text(self, engine: str) -> str:
        if engine == "spark" and self.spark_sql is not None:
            return self.spark_sql
        return self.sql


RAW_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
              "events", "documents", "embeddings", "pages", "benchmark", "labels",
              "conversations")

VIEWS: dict[str, View] = {}

#: Lines of every 53rd part name a product that does not exist (orphan lines):
#: the part's key plus this, far above any product's id.
ORPHAN = 10 ** 12


def _v(name, deps, sql, spark_sql=None, spark_fn=None, in_order=False):
    VIEWS[name] = View(name, tuple(deps), sql.strip(), spark_sql.strip() if spark_sql else None,
                       spark_fn, in_order)


def _shop_items(lineitem: DataFrame) -> DataFrame:
    """Spark form of ``shop_items``: the line id comes from
    :func:`kipmart.plans.ids.sequence_number` over a total order, which spreads a hot order
    over several tasks and never runs out of numbers within an order."""
    from kipmart.plans.ids import sequence_number
    order = [F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                      "l_extendedprice", "l_quantity", "l_shipdate")]
    li = lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                         "l_extendedprice", "l_returnflag", "l_shipdate")
    n = sequence_number(li, order, 1, "id")
    return n.select("id",
                    F.col("l_orderkey").alias("order_id"),
                    F.when(F.col("l_partkey") % 53 == 0, F.col("l_partkey") + ORPHAN)
                    .otherwise(F.col("l_partkey")).alias("product_id"),
                    F.col("l_quantity").cast("bigint").alias("quantity"),
                    F.col("l_extendedprice").cast("decimal(15,2)").alias("price"),
                    F.when(F.col("l_returnflag") == "N", 1).otherwise(0).alias("is_preorder"))


_v("shop_orders", ["orders"], """
select o_orderkey as id,
       concat('BUN-', replace(substr(cast(o_orderdate as string),1,10),'-',''), '-', lpad(cast(o_orderkey as string), cast(greatest(7, length(cast(o_orderkey as string))) as int), '0')) as order_number,
       concat('Customer#', lpad(cast(o_custkey as string), cast(greatest(9, length(cast(o_custkey as string))) as int), '0')) as customer_name,
       case o_custkey % 4
         when 0 then concat('020', cast(55000000 + o_custkey as string))
         when 1 then concat('+85620', cast(55000000 + o_custkey as string))
         when 2 then concat('020 ', substr(cast(55000000 + o_custkey as string),1,4), '-', substr(cast(55000000 + o_custkey as string),5,4))
         else '' end as customer_phone,
       cast(o_totalprice as decimal(15,2)) as total_amount,
       cast(case when o_orderkey % 5 = 0 then 0 else 25 end as decimal(15,0)) as shipping_fee,
       case o_orderkey % 3 when 0 then 'anousith' when 1 then 'houngaloun' else null end as shipping_company,
       case when o_orderkey % 89 = 0 then null
            when o_orderpriority in ('1-URGENT','2-HIGH') then 'cod' else 'transfer' end as payment_method,
       case when o_orderkey % 97 = 0 then null
            when o_orderstatus = 'P' then 'pending'
            when o_orderstatus = 'O' and o_orderkey % 2 = 0 then 'confirmed'
            when o_orderstatus = 'O' then 'shipped'
            when o_orderkey % 3 = 0 then 'cancelled'
            when o_orderkey % 3 = 1 then 'completed'
            else 'delivered' end as status,
       case when o_orderkey % 10 = 0 then null else o_custkey end as member_id,
       o_orderdate as created_at
from {orders}
""")

_v("shop_items", ["lineitem"], """
select row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
                          l_quantity, l_shipdate) as id,
       l_orderkey as order_id,
       case when l_partkey % 53 = 0 then l_partkey + 1000000000000 else l_partkey end as product_id,
       cast(l_quantity as bigint) as quantity,
       cast(l_extendedprice as decimal(15,2)) as price,
       case when l_returnflag = 'N' then 1 else 0 end as is_preorder
from {lineitem}
""", spark_fn=_shop_items, in_order=True)

_v("shop_products", ["part"], """
select p_partkey as id,
       case when p_partkey % 41 = 0 then null else cast(substr(p_brand,7) as int) end as category_id,
       p_name as name,
       case when p_partkey % 3 = 0 then concat('ສິນຄ້າ ', p_name) else null end as name_lo,
       case when p_partkey % 31 = 0 then null else p_type end as description,
       cast(p_retailprice as decimal(12,2)) as price,
       case when p_partkey % 7 = 0 then null else cast(p_retailprice as decimal(12,2)) end as cost_price,
       p_size % 12 - 1 as stock,
       case when p_partkey % 5 = 0 then null else concat('uploads/prod_', cast(p_partkey as string), '.jpg') end as image,
       concat('SKU-', lpad(cast(p_partkey as string), cast(greatest(6, length(cast(p_partkey as string))) as int), '0')) as sku,
       case p_partkey % 4 when 0 then '["ແດງ","ດຳ"]' when 1 then 'ແດງ, ,ດຳ' when 2 then '' else null end as colors,
       case p_partkey % 3 when 0 then '["S","M"]' when 1 then '' else null end as sizes,
       case when p_brand = 'Brand#25' or p_size > 45 then 'inactive' else 'active' end as status,
       cast(p_partkey % 2 as int) as pre_order,
       case when p_partkey % 3 = 0 then p_size else null end as sort_order,
       cast(concat(cast(1995 + p_partkey % 6 as string), '-0', cast(1 + p_partkey % 9 as string), '-1', cast(p_partkey % 10 as string)) as date) as created_at
from {part}
""")

_v("shop_categories", ["part"], """
select distinct cast(substr(p_brand,7) as int) as id, p_brand as name, cast(null as string) as description from {part}
union all select 98, 'brand#1 ', 'same name as id 1 but for case and a trailing blank'
union all select 99, 'Empty', 'category without products'
""")

# every sixth product has no image rows
_v("shop_product_images", ["part"], """
select p_partkey * 10 + n as id, p_partkey as product_id, n as sort_order,
       concat('uploads/prod_', cast(p_partkey as string), case when n = 0 then '' else concat('_', cast(n as string)) end, '.jpg') as image_path
from {part}, (select 0 as n union all select 1 union all select 2) t
where p_partkey % 6 <> 0
""", spark_sql="""
select p_partkey * 10 + n as id, p_partkey as product_id, n as sort_order,
       concat('uploads/prod_', cast(p_partkey as string), case when n = 0 then '' else concat('_', cast(n as string)) end, '.jpg') as image_path
from {part} lateral view explode(array(0, 1, 2)) t as n
where p_partkey % 6 <> 0
""")

_v("shop_members", ["customer"], """
select c_custkey as id,
       concat('020', cast(55000000 + c_custkey as string)) as phone,
       case c_custkey % 4 when 0 then '' when 1 then null else c_name end as name,
       case c_custkey % 2 when 0 then 'anousith' else null end as shipping_company,
       case c_custkey % 2 when 0 then concat('ANS-', cast(c_custkey as string)) else null end as member_number
from {customer}
""")

# ---- change batches and event inputs (``seq`` = request order) -------------

# every order is asked to be cancelled twice: the first request of a pending
# order is applied, the second is refused
_v("chg_cancel", ["orders"], """
select o_orderkey as id, o_orderkey * 2 as seq from {orders}
union all select o_orderkey, o_orderkey * 2 + 1 from {orders}
""")

# the quantity of every pre-order line is edited (0 is refused)
_v("chg_item_qty", ["shop_items"], """
select id as item_id, order_id, id % 5 as quantity, id as seq from {shop_items} where is_preorder = 1
""")

# lines of inactive products are deleted from their orders
_v("chg_item_delete", ["shop_items", "shop_products"], """
select i.id as item_id, i.order_id, i.id as seq
from {shop_items} i join {shop_products} p on p.id = i.product_id
where p.status = 'inactive'
""")

# one log: two cancels an order, status changes between them, edits and deletes of
# lines (some twice, some malformed), all mixed by seq
_v("order_log", ["shop_orders", "shop_items"], """
select id * 1000000 + (id % 9) * 1000 + 990 as seq, 'cancel' as op, id as order_id, cast(null as bigint) as item_id,
       cast(null as bigint) as quantity, cast(null as string) as status from {shop_orders}
union all select id * 1000000 + (3 + id % 5) * 1000 + 991, 'cancel', id, null, null, null from {shop_orders}
union all select id * 1000000 + 3992, 'status', id, null, null, 'pending' from {shop_orders} where id % 3 = 0
union all select id * 1000000 + 5993, 'status', id, null, null, 'confirmed' from {shop_orders} where id % 5 = 0
union all select id, 'cancel', 1000000000 + id, null, null, null from {shop_orders} where id % 50 = 0
union all select order_id * 1000000 + (id % 9) * 1000 + (id % 450) * 2, 'edit', case when id % 60 = 0 then 0 else order_id end, id, id % 6, null
from {shop_items} where id % 4 = 0
union all select order_id * 1000000 + (id % 8) * 1000 + (id % 450) * 2 + 1, 'delete', order_id, id, null, null
from {shop_items} where id % 7 = 0
union all select order_id * 1000000 + 9000 + (id % 450) * 2 + 1, 'delete', order_id, id, null, null from {shop_items} where id % 14 = 0
""")

_v("chg_status", ["shop_orders"], """
select id, case id % 3 when 0 then 'confirmed' when 1 then 'cancelled' else 'anything' end as status, id as seq
from {shop_orders} where status = 'pending'
""")

_v("chg_stock", ["shop_products"], """
select id, 50 as stock, id as seq from {shop_products} where stock < 5
""")

# every product gets a position; unpositioned ones get a second, later one
_v("chg_sort", ["shop_products"], """
select id, cast(id % 7 as int) as sort_order, id as seq from {shop_products}
union all select id, cast(id % 11 as int), id + 1000000 from {shop_products} where sort_order is null
""")

_v("chg_members", ["events"], """
select concat('020', cast(55000000 + user_id * 20 as string)) as phone,
       case event_id % 2 when 0 then 'anousith' else 'houngaloun' end as shipping_company,
       concat('M-', cast(event_id - event_id % 3 as string)) as member_number, event_id as seq, ts as changed_at
from {events} where event_type = 'purchase'
""")

_v("req_orders", ["orders"], """
select o_orderkey as request_id, concat('Customer#', cast(o_custkey as string)) as name,
       concat('020-', cast(55000000 + o_custkey as string)) as phone,
       case when o_orderkey % 4 = 0 then 0 else o_custkey end as member_id,
       cast(o_totalprice as decimal(15,2)) as items_total,
       case when o_orderkey % 3 = 0 then null else 25 end as shipping_fee
from {orders}
""")

_v("req_order_items", ["shop_items"], """
select order_id as request_id, product_id, quantity, price, is_preorder from {shop_items}
""")

_v("otp_requests", ["events"], """
select concat('020', cast(55000000 + user_id * 20 as string)) as phone, lpad(cast(event_id % 1000000 as string),6,'0') as otp,
       ts as requested_at, event_id as seq
from {events} where event_type = 'signup'
""")

_v("otp_attempts", ["otp_requests"], """
select seq, phone,
       case when seq % 3 = 2 then '999999' else otp end as otp,
       case when seq % 3 = 1 then requested_at + interval 7 minutes else requested_at + interval 2 minutes end as attempted_at
from {otp_requests}
""")

# every attempt, and for most requests one more with their code, typed with a blank
_v("otp_attempt_log", ["otp_attempts", "otp_requests"], """
select seq, phone, otp, attempted_at from {otp_attempts}
union all select seq + 1000000000, concat(' ', phone), otp, requested_at + interval 3 minutes from {otp_requests} where seq % 4 <> 1
""")

# completions: with the token of that attempt, or a wrong one, after 6 or 11 minutes; twice
_v("token_attempts", ["otp_attempt_log"], """
select seq * 2 as seq, phone, case when seq % 5 = 4 then 'T0' else concat(' T', cast(seq as string)) end as token,
       case when seq % 7 = 3 then attempted_at + interval 11 minutes else attempted_at + interval 6 minutes end as attempted_at
from {otp_attempt_log}
union all select seq * 2 + 1, phone, concat('T', cast(seq as string)), attempted_at + interval 8 minutes from {otp_attempt_log}
""")

# five products a cart, all carts together the whole range of products
_v("cart_events", ["events", "part"], """
select user_id as cart_id, event_id as seq, ts,
       1 + (user_id * 5 + cast(regexp_extract(props, '([0-9]+)', 1) as bigint) % 5)
         % (select max(p_partkey) from {part}) as product_id,
       case when event_id % 2 = 0 then 'ແດງ' else '' end as color,
       case event_type when 'click' then 'add' when 'signup' then 'add' when 'view' then 'set'
                       when 'error' then 'remove' else 'clear' end as action,
       case event_type when 'view' then event_id % 4 else 1 + event_id % 3 end as qty,
       cast(value as decimal(15,2)) as price
from {events}
""")

_v("chg_address", ["shop_orders"], """
select id, concat('  addr ', cast(id as string), ' ') as address, id as seq from {shop_orders}
where shipping_company = 'anousith'
""")

_v("chg_product_images", ["shop_products"], """
select p.id as product_id, n as pos, case when n = 1 then '' else concat('uploads/new_', cast(p.id as string), '_', cast(n as string), '.jpg') end as image_path
from {shop_products} p, (select 0 as n union all select 1 union all select 2) t where p.image is null
""", spark_sql="""
select p.id as product_id, n as pos, case when n = 1 then '' else concat('uploads/new_', cast(p.id as string), '_', cast(n as string), '.jpg') end as image_path
from {shop_products} p lateral view explode(array(0, 1, 2)) t as n where p.image is null
""")

# products without an image get an edit of their whole record
_v("chg_product_update", ["shop_products"], """
select id, id as seq, category_id, concat(name, ' v2') as name, description, price, cost_price,
       stock + 1 as stock, image, sku, status, pre_order
from {shop_products} where image is null
""")

_v("new_products", ["shop_products"], """
select id as seq, category_id, concat('new ', name) as name, description, price, cost_price, 5 as stock, image,
       concat(sku, '-N') as sku, '2 kg' as weight, '1x2x3' as dimensions,
       case when id % 2 = 0 then ['red', 'black'] end as colors, case when id % 3 = 0 then ['S', 'M'] end as sizes,
       [concat('uploads/more_', cast(id as string), '.jpg'), '', 'uploads/any.jpg'] as extra_images
from {shop_products}
""", spark_sql="""
select id as seq, category_id, concat('new ', name) as name, description, price, cost_price, 5 as stock, image,
       concat(sku, '-N') as sku, '2 kg' as weight, '1x2x3' as dimensions,
       case when id % 2 = 0 then array('red', 'black') end as colors, case when id % 3 = 0 then array('S', 'M') end as sizes,
       array(concat('uploads/more_', cast(id as string), '.jpg'), '', 'uploads/any.jpg') as extra_images
from {shop_products}
""")

_v("chg_product_delete", ["shop_products"], """
select id, id as seq from {shop_products} where status = 'inactive'
""")

# for every category: an insert named by its description (NULL → refused),
# a rename to the lower-cased name (clashes with the case/blank variant), a delete;
# then the inserts once more (clash with the first ones), and renames to one name
_v("chg_categories", ["shop_categories"], """
select id * 3 as seq, 'insert' as op, cast(null as int) as id, description as name, concat(' of ', name) as description from {shop_categories}
union all select id * 3 + 1, 'update', id, lower(name), cast(null as string) from {shop_categories}
union all select id * 3 + 2, 'delete', id, cast(null as string), cast(null as string) from {shop_categories}
union all select id * 3 + 10000, 'insert', cast(null as int), description || ' ', 'again' from {shop_categories}
union all select id * 3 + 10001, 'update', id, concat(' Joint ', cast(id % 7 as string)), ' x ' from {shop_categories}
""")

# the same and then: every category's old name inserted again, every category renamed to
# the next one's old name, renames and deletes of categories that this log inserts
_v("category_log", ["chg_categories", "shop_categories"], """
select seq, op, id, name, description from {chg_categories}
union all select id * 3 + 20000, 'insert', cast(null as int), name, 'once more' from {shop_categories}
union all select id * 3 + 20001, 'update', id, concat('Brand#', cast(id + 1 as string)), ' next ' from {shop_categories}
union all select id * 3 + 30000, 'update', 100 + id % 9, concat('New ', cast(id % 4 as string)), cast(null as string) from {shop_categories}
union all select id * 3 + 30001, 'delete', 100 + id % 9, cast(null as string), cast(null as string) from {shop_categories} where id % 2 = 0
""")

_v("carrier_events", ["events"], """
select user_id, event_id as seq, case event_id % 2 when 0 then 'anousith' else 'houngaloun' end as carrier,
       case when event_type = 'error' then '' else concat('N-', cast(event_id as string)) end as member_number
from {events}
""")

_v("image_sizes", ["part"], """
select p_partkey as id, 400 + p_partkey * 3 as w, 200 + p_partkey as h from {part}
""")


def closure(names) -> list[str]:
    """Views needed by ``names``, dependencies first."""
    out: list[str] = []

    def visit(n):
        if n in RAW_TABLES or n in out:
            return
        for d in VIEWS[n].deps:
            visit(d)
        out.append(n)

    for n in names:
        visit(n)
    return out


def oracle_with(views, body: str) -> str:
    """DuckDB text: the needed adapter views as CTEs in front of ``body``."""
    needed = closure(views)
    if not needed:
        return body.strip()
    ctes = []
    for n in needed:
        text = VIEWS[n].text("duckdb").format(**{d: d for d in VIEWS[n].deps})
        ctes.append(f"{n} as (\n{text}\n)")
    return "with " + ",\n".join(ctes) + "\n" + body.strip()
