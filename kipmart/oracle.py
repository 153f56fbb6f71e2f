"""Independent DuckDB restatement of every registered query (the correctness
oracle). Each entry is written from the reference's SQL semantics directly —
not generated from the Spark plan — over the same adapter views.

Output conventions match :func:`kipmart.plans.wire.to_wire`: dates and
timestamps as text, money as double, integers as bigint.
"""

from __future__ import annotations

from kipmart.sources.adapter import oracle_with
from kipmart import params as P


def D(x):
    return f"strftime(cast({x} as date), '%Y-%m-%d')"


def TS(x):
    return f"strftime({x}, '%Y-%m-%d %H:%M:%S')"


def M(x):
    return f"cast({x} as double)"


def I(x):  # noqa: E743
    return f"cast({x} as bigint)"


PRODUCT_COLS = (f"id, {I('category_id')} as category_id, name, name_lo, description, "
                f"{M('price')} as price, {M('cost_price')} as cost_price, {I('stock')} as stock, "
                f"image, sku, colors, sizes, status, {I('pre_order')} as pre_order, "
                f"{I('sort_order')} as sort_order, {D('created_at')} as created_at")


def order_cols(a=""):
    return (f"{a}id as id, {a}order_number as order_number, {a}customer_name as customer_name, "
            f"{a}customer_phone as customer_phone, {M(a + 'total_amount')} as total_amount, "
            f"{M(a + 'shipping_fee')} as shipping_fee, {a}shipping_company as shipping_company, "
            f"{a}payment_method as payment_method, {a}status as status, "
            f"{a}member_id as member_id, {TS(a + 'created_at')} as created_at")


ORDER_COLS = order_cols()
#: Month names of the period labels.
LAO_MONTHS_SQL = ("['ມັງກອນ','ກຸມພາ','ມີນາ','ເມສາ','ພຶດສະພາ','ມິຖຸນາ',"
                  "'ກໍລະກົດ','ສິງຫາ','ກັນຍາ','ຕຸລາ','ພະຈິກ','ທັນວາ']")

Q: dict[str, tuple[list[str], str]] = {}


def q(key, views, body):
    Q[key] = (views, body)


# ------------------------------------------------------------------ reports
# Rules: a live order has a status and it is not 'cancelled' (V1); money sums are
# taken over whole tables; product reports drop lines without a product.
_LIVE = "coalesce(status, 'cancelled') != 'cancelled'"
_PAID = {m: f"(payment_method = '{m}' and {_LIVE})" for m in ("transfer", "cod")}


def _money(condition):
    """Order money under a condition; 0 without any such order."""
    return M(f"coalesce(sum(total_amount) filter (where {condition}), 0)")


def _orders(condition):
    return I(f"count_if({condition})")


def _in_month(month):
    return f"created_at >= date '{month}-01' and created_at < date '{month}-01' + interval 1 month"


def _summary(rows):
    return f"""
with picked as (from shop_orders where {rows}),
     live as (select count(*) as n, sum(total_amount) as s from picked)
select {M('live.s')} as total, live.n as count,
       {_money(_PAID['transfer'])} as transfer_total, {_money(_PAID['cod'])} as cod_total,
       {_money("status = 'cancelled'")} as cancelled_total, {_orders("status = 'cancelled'")} as cancelled_count,
       {_orders(_PAID['transfer'])} as transfer_count, {_orders(_PAID['cod'])} as cod_count
from picked cross join live group by live.s, live.n
"""


q("sales_summary", ["shop_orders"], f"from ({_summary('true')})")
q("sales_summary_month", ["shop_orders"], f"from ({_summary(_in_month(P.MONTH))})")

q("active_product_count", ["shop_products"], "select count_if(status = 'active') as count from shop_products")

q("low_stock", ["shop_products"], f"""
select {PRODUCT_COLS} from (from shop_products where status = 'active') where not stock >= 5
""")

q("stock_flag", ["shop_products"], f"""
select id, {I('stock')} as stock, if(coalesce(stock >= 5, true), 'ok', 'low') as stock_flag from shop_products
""")

q("sales_monthly", ["shop_orders"], f"""
select strftime(m, '%Y-%m') as month, {_money(_LIVE)} as total,
       {_money(_PAID['transfer'])} as transfer_total, {_money(_PAID['cod'])} as cod_total,
       count(*) as orders, {_orders("status = 'cancelled'")} as cancelled
from (select *, date_trunc('month', created_at) as m from shop_orders)
group by m
qualify row_number() over (order by m desc) <= 12
order by m desc
""")

_LIVE_ORDERS = f"(select * from shop_orders where {_LIVE})"


def _per(key, rows="true", lines="true"):
    """Live lines summed per key, before any product is looked at."""
    return f"""(select {key}, product_id, sum(quantity) as units, sum(quantity * price) as value
   from (select i.*, h.created_at from shop_items i join {_LIVE_ORDERS} h on i.order_id = h.id where {lines})
   where {rows} group by all)"""


_COSTS = f"""select s.*, s.units * coalesce(p.cost_price, 0) as cost, p.id, p.name, p.sku, p.image, p.cost_price
   from {{sums}} s join shop_products p on s.product_id = p.id"""

q("top_products", ["shop_items", "shop_products", "shop_orders"], f"""
select id, name, sku, image, {I('units')} as total_qty, {M('value')} as total_revenue
from ({_COSTS.format(sums=_per("0 as k"))})
order by units desc, id fetch first 10 rows only
""")


def _profit_total(rows):
    return f"""
select {M('coalesce(sum(value), 0)')} as revenue, {M('coalesce(sum(cost), 0)')} as cost,
       {M('coalesce(sum(value - cost), 0)')} as profit, {I('coalesce(sum(units), 0)')} as units_sold
from ({_COSTS.format(sums=_per("0 as k", rows))})
"""


q("profit_overall", ["shop_items", "shop_products", "shop_orders"], _profit_total("true"))
q("profit_overall_month", ["shop_items", "shop_products", "shop_orders"], _profit_total(_in_month(P.MONTH)))

q("profit_by_product", ["shop_items", "shop_products", "shop_orders"], f"""
select id, name, sku, image, {M('cost_price')} as cost_price, {I('units')} as qty, {M('value')} as revenue,
       {M('cost')} as cost, {M('value - cost')} as profit
from ({_COSTS.format(sums=_per("0 as k"))})
qualify row_number() over (order by value - cost desc, id) <= 15
order by value - cost desc, id
""")

q("profit_by_month", ["shop_items", "shop_products", "shop_orders"], f"""
select strftime(m, '%Y-%m') as month, {M('sum(value)')} as revenue, {M('sum(cost)')} as cost,
       {M('sum(value - cost)')} as profit
from ({_COSTS.format(sums=_per("date_trunc('month', created_at) as m"))})
group by m
qualify row_number() over (order by m desc) <= 12
order by m desc
""")

q("status_counts", ["shop_orders"], f"""
select distinct status, count(*) over same as cnt, {M('sum(total_amount) over same')} as total
from shop_orders window same as (partition by status)
""")

q("sales_daily", ["shop_orders"], f"""
select {D('d')} as day, {_money(_LIVE)} as total, count(*) as orders, {_orders("status = 'cancelled'")} as cancelled
from (select *, cast(created_at as date) as d from shop_orders where {_in_month(P.MONTH)})
group by d order by d
""")

q("day_orders", ["shop_orders"], f"""
select id, order_number, customer_name, customer_phone, {M('total_amount')} as total_amount,
       payment_method, status, {TS('created_at')} as created_at
from shop_orders
where created_at >= timestamp '{P.DAY}' and created_at < timestamp '{P.DAY}' + interval 1 day
order by shop_orders.created_at desc, id
""")

# pre-orders: one row per live order with pre-order lines, then periods of those
_PRE = f"""(select h.id as order_id, h.created_at as placed, h.customer_phone, t.units, t.value, t.lines
   from {_LIVE_ORDERS} h join (select order_id, sum(quantity) as units, sum(quantity * price) as value,
                                      count(*) as lines from shop_items where is_preorder = 1 group by order_id) t
     on t.order_id = h.id)"""
_PERIOD_SUMS = f"count(*) as order_count, {I('sum(units)')} as total_units, {M('sum(value)')} as total_value"

q("preorder_by_day", ["shop_items", "shop_orders"], f"""
select {D('d')} as period_key, strftime(d, '%d/%m/%Y') as period_label, {_PERIOD_SUMS}
from (select *, cast(placed as date) as d from {_PRE} where {_in_month(P.MONTH).replace('created_at', 'placed')})
group by d order by d
""")

# V8: in the week label, a week of the year before counts as 0 and one of the next as 53
q("preorder_by_week", ["shop_items", "shop_orders"], f"""
select {I('k')} as period_key,
       'ອາທິດ ' || (case sign(k // 100 - year(w)) when -1 then 0 when 1 then 53 else k % 100 end) || ' /' || year(w)
         as period_label,
       {D('w')} as week_start, order_count, total_units, total_value
from (select isoyear(placed) * 100 + weekofyear(placed) as k, min(cast(placed as date)) as w, {_PERIOD_SUMS}
      from {_PRE} where year(placed) = {P.YEAR} group by k)
order by k
""")

q("preorder_by_year", ["shop_items", "shop_orders"], f"""
select y as period_key, y || ' ປີ' as period_label, {_PERIOD_SUMS}
from (select *, year(placed) as y from {_PRE}) group by y order by y
""")

q("preorder_by_month", ["shop_items", "shop_orders"], f"""
select strftime(m, '%Y-%m') as period_key,
       {LAO_MONTHS_SQL}[month(m)] || ' ' || year(m) as period_label, {_PERIOD_SUMS}
from (select *, date_trunc('month', placed) as m from {_PRE} where year(placed) = {P.YEAR}) group by m order by m
""")

q("preorder_years", ["shop_items", "shop_orders"], f"select year(placed) as y from {_PRE} group by y order by y desc")

q("preorder_summary", ["shop_items", "shop_orders"], f"""
select {I('coalesce(sum(lines), 0)')} as total_lines, {I('coalesce(sum(units), 0)')} as total_units,
       {M('coalesce(sum(value), 0)')} as total_value,
       (select count(*) from (select distinct product_id from shop_items i semi join {_LIVE_ORDERS} h
          on i.order_id = h.id where i.is_preorder = 1 and product_id is not null)) as unique_products,
       count(distinct customer_phone) as unique_customers
from {_PRE}
""")

q("preorder_lines", ["shop_items", "shop_products", "shop_orders"], f"""
select i.id, i.quantity, {M('i.price')} as price, i.product_id,
       ifnull(p.name_lo, p.name) as product_name, p.image as product_image, p.sku,
       i.order_id, h.order_number, h.customer_name, h.customer_phone,
       h.status, h.payment_method, {TS('h.created_at')} as created_at
from {_LIVE_ORDERS} h, (from shop_items where is_preorder = 1) i, shop_products p
where i.order_id = h.id and i.product_id = p.id
order by h.created_at desc, i.id
""")

q("preorder_by_product", ["shop_items", "shop_products", "shop_orders"], f"""
select ifnull(p.name_lo, p.name) as product_name, p.image as product_image, p.sku,
       {I('t.units')} as total_units, t.n as order_count
from shop_products p join (
  select product_id, sum(units) as units, count(*) as n
  from (select product_id, order_id, sum(quantity) as units from shop_items where is_preorder = 1 group by all)
  where order_id in (select id from {_LIVE_ORDERS})
  group by product_id) t on t.product_id = p.id
order by t.units desc, p.id
""")



# ------------------------------------------------------------------ catalogue
q("category_by_id", ["shop_products", "shop_categories", "chg_categories"], f"""
select {I('r.id')} as id, c.name, c.description, c.name is not null as found
from (select distinct id from (
        select category_id as id from shop_products where category_id is not null
        union all select id from chg_categories where id is not null)) r
left join shop_categories c on c.id = r.id
""")

q("category_product_counts", ["shop_categories", "shop_products"], f"""
select {I('c.id')} as id, c.name, c.description, {I('count(p.id)')} as product_count
from shop_categories c left join shop_products p on p.category_id = c.id and p.status = 'active'
group by c.id, c.name, c.description
order by c.name, c.id
""")

q("deletable_categories", ["shop_categories", "shop_products"], f"""
select {I('c.id')} as id, c.name, c.description from shop_categories c
where not exists (select 1 from shop_products p where p.category_id = c.id)
""")

q("category_name_duplicates", ["shop_categories"], f"""
select lower(rtrim(name)) as name_key, {I('count(*)')} as n, {I('min(id)')} as min_id, {I('max(id)')} as max_id
from shop_categories group by 1 having count(*) > 1
""")

q("category_name_conflicts", ["shop_categories"], f"""
select * from (
  select {I('c.id')} as id, c.name,
         {I("(select count(*) from shop_categories d where lower(rtrim(d.name)) = lower(rtrim(c.name)) and d.id <> c.id)")} as n_others
  from shop_categories c) t
where n_others > 0
""")

q("category_list_numbered", ["shop_categories"], f"""
select {I('id')} as id, name, description, {I('row_number() over (order by name, id)')} as row_no
from shop_categories
""")

COLORS_LIST = """(case when {c} is null or {c} in ('', '0') then []::varchar[]
       when json_valid({c}) and json_type({c}) = 'ARRAY' then from_json({c}, '["VARCHAR"]')
       when json_valid({c}) and json_type({c}) = 'OBJECT' then json_extract_string({c}, '$.*')
       else list_filter(list_transform(string_split({c}, ','), lambda x: trim(x)), lambda x: x not in ('', '0')) end)"""
SIZES_LIST = """(case when {c} is null or {c} in ('', '0') then []::varchar[]
       when json_valid({c}) and json_type({c}) = 'ARRAY' then from_json({c}, '["VARCHAR"]')
       else null end)"""


def colors_text(c):
    return "array_to_string(" + COLORS_LIST.format(c=c) + ", '|')"


def sizes_text(c):
    return "array_to_string(" + SIZES_LIST.format(c=c) + ", '|')"


def _listing(rows):
    """The catalogue's products under a condition, in its order (V9)."""
    return f"""
select * replace ({D('created_at')} as created_at) from (
  select id, {I('category_id')} as category_id, name, description, {M('price')} as price,
         {M('cost_price')} as cost_price, {I('stock')} as stock, image, sku, {colors_text('colors')} as colors,
         {sizes_text('sizes')} as sizes, status, {I('pre_order')} as pre_order, {I('sort_order')} as sort_order,
         created_at, image as image_url, name as name_lo,
         cast(null as double) as old_price, false as is_new
  from shop_products where {rows})
left join (select id as category_id, name as category_name, name as category_name_lo from shop_categories)
  using (category_id)
order by sort_order nulls last, created_at desc, id
"""


q("product_listing", ["shop_products", "shop_categories"], _listing("status = 'active'"))
q("product_search", ["shop_products", "shop_categories"], _listing(
    f"status = 'active' and concat_ws(chr(10), name, description) ilike '%{P.SEARCH}%'"))
q("product_search_bulk", ["shop_products"], """
select * from (with w as (select name, unnest(string_split(name, ' ')) as word from shop_products),
asked as (select word as search from w union select left(word, 2) from w union select upper(name) from w
          union select left(name, 2) || '%' || right(name, 3) from w union select left(name, 1) || '_' from w union select '')
select search, id, name from asked, shop_products
where status = 'active' and (name ilike '%' || search || '%' or description ilike '%' || search || '%'))
""")
q("product_listing_category", ["shop_products", "shop_categories"], _listing(f"category_id = {P.CATEGORY}"))
q("product_listing_total", ["shop_products"],
  f"select {I('count(*)')} as total from shop_products p where p.status = 'active'")

q("product_gallery", ["shop_products", "shop_product_images"], """
select p.id as product_id,
       array_to_string(list_concat(
         case when p.image is null or p.image in ('', '0') then []::varchar[] else [p.image] end,
         coalesce((select list(i.image_path order by i.sort_order, i.id) from shop_product_images i
                   where i.product_id = p.id and i.image_path is not null and i.image_path not in ('', '0')
                     and (p.image is null or i.image_path <> p.image)), []::varchar[])), '|') as gallery
from shop_products p
""")

q("product_single", ["shop_products", "shop_categories", "shop_product_images"], f"""
select l.*, g.gallery as images from ({_listing("true")}) l join ({Q['product_gallery'][1]}) g on g.product_id = l.id
""")
q("check_stock", ["req_order_items", "shop_products"], f"""
select distinct cast(r.request_id as varchar) || '-' || cast((n - 1) // 100 as varchar) as request_id,
       p.id, p.name, {I('p.stock')} as stock
from (select *, row_number() over (partition by request_id order by cast(product_id as varchar)) as n from req_order_items) r
join shop_products p on p.id = r.product_id
where r.product_id <> 0
""")

q("product_colors", ["shop_products"], f"select id, {colors_text('colors')} as colors from shop_products")
q("product_sizes", ["shop_products"], f"select id, {sizes_text('sizes')} as sizes from shop_products")

_HEX_CASE = ("case color when 'ແດງ' then '#e74c3c' when 'ຟ້າ' then '#3498db' when 'ຂຽວ' then '#27ae60' "
             "when 'ເຫລືອງ' then '#f1c40f' when 'ດຳ' then '#1a1a1a' when 'ຂາວ' then '#f0f0f0' "
             "when 'ບົວ' then '#ff69b4' when 'ສົ້ມ' then '#e67e22' when 'ມ່ວງ' then '#9b59b6' "
             "when 'ນ້ຳຕານ' then '#8B4513' when 'ຊາ' then '#c9a96e' when 'ເທົາ' then '#95a5a6' end")
q("colors_hex", ["shop_products"], f"""
select id, {I('pos')} as pos, color, coalesce({_HEX_CASE}, nullif(color, ''), '#ccc') as hex
from (select id, generate_subscripts(arr, 1) - 1 as pos, unnest(arr) as color
      from (select id, {COLORS_LIST.format(c='colors')} as arr from shop_products))
""")

# ------------------------------------------------------------------ order reads
q("orders_by_member", ["shop_orders", "shop_members"], f"""
select {ORDER_COLS} from shop_orders where member_id in (select id from shop_members)
""")

q("orders_by_phone", ["shop_orders", "shop_members"], f"""
select {order_cols('o.')},
       m.phone as request_phone
from shop_orders o join shop_members m
  on right(regexp_replace(trim(m.phone), '[^0-9]', '', 'g'), 8)
   = right(replace(replace(replace(o.customer_phone, ' ', ''), '-', ''), '+856', ''), 8)
""")

q("orders_bucketed", ["shop_orders"], """
select id, status,
       case when status in ('pending', 'confirmed', 'shipped') then 'pending'
            when status = 'delivered' then 'done' else 'other' end as bucket
from shop_orders
""")

q("orders_by_status", ["shop_orders"], f"""
select {ORDER_COLS} from shop_orders where status = '{P.STATUS}' order by created_at desc, id
""")

q("order_detail", ["shop_items", "shop_products"], f"""
select oi.id, oi.order_id, oi.product_id, oi.quantity, {M('oi.price')} as price,
       {I('oi.is_preorder')} as is_preorder, p.name as product_name, p.image as product_image,
       {M('oi.price * oi.quantity')} as line_total
from shop_items oi left join shop_products p on p.id = oi.product_id
""")

q("orders_with_preorder_count", ["shop_orders", "shop_items"], f"""
select {ORDER_COLS},
       {I('(select count(*) from shop_items oi where oi.order_id = o.id and oi.is_preorder = 1)')} as has_preorder
from shop_orders o order by o.created_at desc, o.id
""")

q("phones_normalised", ["shop_orders"], """
select id, customer_phone,
       regexp_replace(trim(customer_phone), '[^0-9]', '', 'g') as digits,
       regexp_replace(trim(customer_phone), '\\s+', '', 'g') as no_blanks,
       right(replace(replace(replace(customer_phone, ' ', ''), '-', ''), '+856', ''), 8) as phone8
from shop_orders
""")


def money_sql(x):
    return ("'₭' || regexp_replace(format('{:,.3f}', round(coalesce(cast(" + x +
            " as double), 0), 3)), '\\.?0+$', '')")


q("money_text", ["shop_orders"], f"""
select id, {money_sql('total_amount')} as total_text, {money_sql('shipping_fee')} as fee_text from shop_orders
""")

q("order_status_labels", ["shop_orders"], """
select id, status,
       coalesce(case status when 'pending' then 'ລໍຖ້າ' when 'confirmed' then 'ຢືນຢັນ'
                  when 'shipped' then 'ຈັດສົ່ງ' when 'completed' then 'ສຳເລັດ'
                  when 'cancelled' then 'ຍົກເລີກ' end, status) as admin_label,
       coalesce(case status when 'pending' then 'ລໍຖ້າ' when 'confirmed' then 'ຢືນຢັນ'
                  when 'shipped' then 'ກຳລັງສົ່ງ' when 'delivered' then 'ສົ່ງແລ້ວ'
                  when 'cancelled' then 'ຍົກເລີກ' end, status) as customer_label
from shop_orders
""")

q("display_dates", ["shop_orders"], """
select id, coalesce(strftime(created_at, '%d/%m/%Y %H:%M:%S'), '—') as created_text from shop_orders
""")

q("order_numbers", ["shop_orders"], """
select id, 'BUN-' || strftime(created_at, '%Y%m%d') || '-' || format('{:07X}', id) as order_number
from shop_orders
""")



# ------------------------------------------------------------------ members and codes
NOBLANK = "regexp_replace(trim({c}), '\\s+', '', 'g')"
DIGITS = "regexp_replace(trim({c}), '[^0-9]', '', 'g')"
OTP_LATEST = f"""(select phone, otp, requested_at + interval 5 minute as expires_at
   from (select {NOBLANK.format(c='phone')} as phone, otp, requested_at,
                row_number() over (partition by {NOBLANK.format(c='phone')} order by seq desc) as rn
         from otp_requests) x
   where rn = 1 and phone <> '')"""
OTP_CHECKED = f"""(select a.seq, a.phone, a.otp, a.attempted_at,
          (a.phone <> '' and length(trim(a.otp)) = 6 and coalesce(ol.expires_at > a.attempted_at, false)) as valid
   from (select seq, {NOBLANK.format(c='phone')} as phone, otp, attempted_at from otp_attempts) a
   left join {OTP_LATEST} ol on ol.phone = a.phone and ol.otp = a.otp)"""

q("latest_otp_per_phone", ["otp_requests"],
  f"select phone, otp, {TS('expires_at')} as expires_at from {OTP_LATEST} t")
q("otp_attempts_checked", ["otp_requests", "otp_attempts"],
  f"select seq, phone, otp, {TS('attempted_at')} as attempted_at, valid from {OTP_CHECKED} t")
q("otps_remaining", ["otp_requests", "otp_attempts"], f"""
select phone, otp, {TS('expires_at')} as expires_at from {OTP_LATEST} t
where phone not in (select phone from {OTP_CHECKED} c where valid)
""")
q("otps_rearmed", ["otp_requests", "otp_attempts"], f"""
select o.phone, o.otp,
       {TS("case when v.at is not null then v.at + interval 10 minute else o.expires_at end")} as expires_at
from {OTP_LATEST} o
left join (select phone, max(attempted_at) as at from {OTP_CHECKED} c where valid group by phone) v
  on v.phone = o.phone
""")
# in the order of events: per attempt the newest request of its phone, then whoever
# matched that request's code first
OTP_AS_OF = f"""(
  with r as (select {NOBLANK.format(c='phone')} as p, trim(otp) as code, requested_at, seq as code_seq from otp_requests),
  a as (select seq, {NOBLANK.format(c='phone')} as phone, otp, attempted_at from otp_attempt_log),
  n as (select a.*, r.code_seq, r.code, r.requested_at,
               row_number() over (partition by a.seq order by r.requested_at desc, r.code_seq desc) as back
        from a left join r on r.p = a.phone and r.p <> '' and r.requested_at <= a.attempted_at),
  m as (select *, coalesce(length(trim(otp)) = 6 and trim(otp) = code and attempted_at < requested_at + interval 5 minute, false) as ok
        from n where back = 1)
  select seq, phone, otp, attempted_at, code_seq,
         ok and not exists (select 1 from m e where e.ok and e.code_seq = m.code_seq
                            and (e.attempted_at < m.attempted_at or (e.attempted_at = m.attempted_at and e.seq < m.seq))) as valid
  from m)"""
q("otp_attempts_as_of", ["otp_requests", "otp_attempt_log"],
  f"select seq, phone, otp, {TS('attempted_at')} as attempted_at, code_seq, valid from {OTP_AS_OF} t")
q("otps_after_log", ["otp_requests", "otp_attempt_log"], f"""
select phone, otp, {TS('requested_at + interval 5 minute')} as expires_at
from (select {NOBLANK.format(c='phone')} as phone, otp, requested_at, seq from otp_requests) r
where phone <> '' and not exists (
    select 1 from (select {NOBLANK.format(c='phone')} as p, requested_at as t, seq as s from otp_requests) l
    where l.p = r.phone and (l.t > r.requested_at or (l.t = r.requested_at and l.s > r.seq)))
  and seq not in (select code_seq from {OTP_AS_OF} t where valid)
""")
q("otp_tokens_checked", ["otp_requests", "otp_attempt_log", "token_attempts"], f"""
select * from (
  with arm as (
    select {DIGITS.format(c='phone')} as p, requested_at as t, 0 as kind, seq as s, requested_at + interval 5 minute as until, null as token
    from otp_requests
    union all
    select {DIGITS.format(c='phone')}, attempted_at, 1, seq, attempted_at + interval 10 minute, 'T' || seq from {OTP_AS_OF} o where valid),
  a as (select seq, {DIGITS.format(c='phone')} as phone, trim(token) as token, attempted_at from token_attempts),
  e as (select a.*, (select arg_max(until, (t, kind, s)) from arm where p = a.phone and t <= a.attempted_at) as until,
               (select arg_max(s, (t, s)) from arm where p = a.phone and t <= a.attempted_at and kind = 1) as issue_seq
        from a),
  m as (select e.*, coalesce(phone <> '' and e.token = 'T' || issue_seq and until > attempted_at, false) as ok from e)
  select seq, phone, token, {TS('attempted_at')} as attempted_at, issue_seq,
         ok and not exists (select 1 from m x where x.ok and x.issue_seq = m.issue_seq
                            and (x.attempted_at < m.attempted_at or (x.attempted_at = m.attempted_at and x.seq < m.seq))) as valid
  from m) t
""")
q("known_phone_requests", ["otp_requests", "shop_members"], f"""
select seq, phone from (select seq, {DIGITS.format(c='phone')} as phone from otp_requests) r
where length(phone) >= 8 and phone in (select phone from shop_members)
""")
q("new_phone_requests", ["otp_requests", "shop_members"], f"""
select seq, phone from (select seq, {DIGITS.format(c='phone')} as phone from otp_requests) r
where length(phone) >= 8 and phone not in (select phone from shop_members)
""")
_MEMBER_CH = f"""(select {NOBLANK.format(c='phone')} as phone, arg_max(shipping_company, seq) as sc,
          arg_max(member_number, seq) as mn, min(seq) as first_seq
   from chg_members group by 1)"""
# what stood before a request: the request before, else the stored row
_MEMBER_TOUCH = f"""(select phone, arg_max(changed_at, seq) as at from (
    select c.*, lag(sc) over w as psc, lag(mn) over w as pmn, row_number() over w as n, m.id as known,
           m.shipping_company as bsc, m.member_number as bmn
    from (select {NOBLANK.format(c='phone')} as phone, shipping_company as sc, member_number as mn, changed_at, seq from chg_members) c
    left join shop_members m on m.phone = c.phone window w as (partition by c.phone order by seq)) x
  where case when n > 1 then sc is distinct from psc or mn is distinct from pmn
             when known is not null then sc is distinct from bsc or mn is distinct from bmn else true end
  group by phone)"""
q("members_upserted", ["shop_members", "chg_members"], f"""
select m.id, m.phone, m.name,
       case when c.phone is not null then c.sc else m.shipping_company end as shipping_company,
       case when c.phone is not null then c.mn else m.member_number end as member_number, {TS('t.at')} as updated_at
from shop_members m left join {_MEMBER_CH} c on c.phone = m.phone left join {_MEMBER_TOUCH} t on t.phone = m.phone
union all
select {I('(select max(id) from shop_members) + row_number() over (order by first_seq, c.phone)')},
       c.phone, cast(null as varchar), sc, mn, {TS('t.at')}
from {_MEMBER_CH} c left join {_MEMBER_TOUCH} t on t.phone = c.phone where c.phone not in (select phone from shop_members)
""")
q("member_display_name", ["shop_members"], """
select id, case when name is null or name in ('', '0') then phone else name end as display_name from shop_members
""")
q("member_initials", ["shop_members"], """
select id, coalesce(upper(left(nullif(trim(name), ''), 1)), right(nullif(phone, ''), 2), '?') as initial
from shop_members
""")

# ------------------------------------------------------------------ change batches
q("orders_with_shipping_defaults", ["shop_orders"], f"""
select id, cast(0 as double) as items_total, {M('shipping_fee')} as shipping_fee, shipping_company,
       cast(null as varchar) as member_number, payment_method, member_id,
       cast(null as varchar) as customer_address, cast(null as varchar) as note,
       cast(null as varchar) as payment_slip
from shop_orders
""")

ITEM_SUMS = "(select order_id, sum(price * quantity) as s from {items} group by order_id)"


def totals_sql(items, orders_filter="1=1"):
    return f"""
select o.id, {I('trunc(coalesce(x.s, 0))')} as items_total,
       {I('trunc(coalesce(x.s, 0)) + trunc(coalesce(o.shipping_fee, 0))')} as total_amount
from shop_orders o left join {ITEM_SUMS.format(items=items)} x on x.order_id = o.id
where {orders_filter}
"""


q("order_totals_recomputed", ["shop_orders", "shop_items"], totals_sql("shop_items"))
q("order_total_mismatch", ["shop_orders", "shop_items"], f"""
select o.id, {M('o.total_amount')} as total_amount, {M('coalesce(x.s, 0)')} as lines_total,
       {M('o.shipping_fee')} as shipping_fee,
       {M('o.total_amount - (coalesce(x.s, 0) + coalesce(o.shipping_fee, 0))')} as diff
from shop_orders o left join {ITEM_SUMS.format(items='shop_items')} x on x.order_id = o.id
where o.total_amount <> coalesce(x.s, 0) + coalesce(o.shipping_fee, 0)
""")

PLACED = """(select request_id, name, phone, member_id,
          (select max(id) from shop_orders) + row_number() over (order by request_id) as id,
          cast(trunc(items_total) as bigint) as it,
          cast(coalesce(trunc(shipping_fee), 0) as bigint) as fee
   from req_orders)"""
_AS_OF_DAY = P.AS_OF.strftime("%Y%m%d")
_AS_OF_TS = P.AS_OF.strftime("%Y-%m-%d %H:%M:%S")
q("orders_placed", ["req_orders", "shop_orders"], f"""
select request_id, id, 'BUN-{_AS_OF_DAY}-' || format('{{:07X}}', id) as order_number,
       trim(coalesce(name, '')) as customer_name,
       regexp_replace(trim(coalesce(phone, '')), '[^0-9]', '', 'g') as customer_phone,
       '' as customer_address, it + fee as total_amount, it as items_total, fee as shipping_fee,
       '' as shipping_company, '' as member_number, 'transfer' as payment_method,
       '' as payment_slip, '' as note,
       case when member_id <> 0 then {I('member_id')} end as member_id,
       'pending' as status, '{_AS_OF_TS}' as created_at
from {PLACED} p
""")
q("orders_after_placing", ["req_orders", "shop_orders"], f"""
select id, customer_phone, status, {M('total_amount')} as total_amount, {TS('created_at')} as created_at from shop_orders
union all
select id, regexp_replace(trim(coalesce(phone, '')), '[^0-9]', '', 'g'), 'pending', {M('it + fee')}, '{_AS_OF_TS}' from {PLACED} p
""")
PLACED_LINES = f"""(select p.id as order_id, i.product_id, i.quantity, i.price,
          case when coalesce(cast(i.is_preorder as varchar), '') in ('', '0') then 0 else 1 end as is_preorder
   from req_order_items i join {PLACED} p on p.request_id = i.request_id)"""
q("items_after_placing", ["req_orders", "req_order_items", "shop_orders", "shop_items"], f"""
select id, order_id, product_id, quantity, {M('price')} as price, {I('is_preorder')} as is_preorder from shop_items
union all
select {I('(select max(id) from shop_items) + row_number() over (order by order_id, product_id, quantity, price, is_preorder)')},
       order_id, product_id, quantity, {M('price')}, {I('is_preorder')} from {PLACED_LINES} l
""")
q("order_lines_placed", ["req_orders", "req_order_items", "shop_orders"], f"""
select order_id, product_id, quantity, {M('price')} as price, {I('is_preorder')} as is_preorder
from {PLACED_LINES} l
""")


def stock_sql(moves):
    return f"""
select p.id, {I('p.stock + coalesce(m.d, 0)')} as stock
from shop_products p left join (select product_id, sum(d) as d from {moves} mv group by product_id) m
  on m.product_id = p.id
"""


MOVES_PLACED = f"(select product_id, -quantity as d from {PLACED_LINES} l where is_preorder = 0)"
q("stock_after_orders", ["req_orders", "req_order_items", "shop_orders", "shop_products"],
  stock_sql(MOVES_PLACED))

CANCEL_OK = """(select c.id from (select id, min(seq) as s from chg_cancel group by id) c
   join shop_orders o on o.id = c.id and o.status = 'pending' where c.id <> 0)"""
MOVES_CANCEL = f"(select product_id, quantity as d from shop_items where order_id in (select id from {CANCEL_OK} a))"
q("orders_after_cancel", ["chg_cancel", "shop_orders"], f"""
select o.id, case when o.id in (select id from {CANCEL_OK} a) then 'cancelled' else o.status end as status
from shop_orders o
""")
q("stock_after_cancel", ["chg_cancel", "shop_orders", "shop_items", "shop_products"],
  stock_sql(MOVES_CANCEL))
q("cancel_rejected", ["chg_cancel", "shop_orders"], """
select c.seq, c.id,
       case when c.id = 0 then 'missing id' when o.id is null then 'not found' else 'not pending' end as reason
from chg_cancel c left join shop_orders o on o.id = c.id
where not (coalesce(o.status = 'pending', false)
           and c.seq = (select min(seq) from chg_cancel d where d.id = c.id))
""")
q("orders_readdressed", ["shop_orders", "chg_address"], """
select o.id, case when a.id is not null then trim(coalesce(a.address, '')) end as customer_address
from shop_orders o left join (select id, arg_max(address, seq) as address from chg_address where id <> 0 group by id) a
  on a.id = o.id
""")

EDITS_OK = "(select * from chg_item_qty where item_id <> 0 and quantity >= 1 and order_id <> 0)"
ITEMS_EDITED = f"""(select i.id, i.order_id, i.product_id, coalesce(e.q, i.quantity) as quantity, i.price
   from shop_items i left join (select item_id, arg_max(quantity, seq) as q from {EDITS_OK} v group by item_id) e
     on e.item_id = i.id)"""
q("items_after_edit", ["shop_items", "chg_item_qty"],
  f"select id, order_id, quantity from {ITEMS_EDITED} t")
q("totals_after_edit", ["shop_orders", "shop_items", "chg_item_qty"],
  totals_sql(ITEMS_EDITED, f"o.id in (select order_id from {EDITS_OK} v)"))
q("order_edits_rejected", ["shop_items", "chg_item_qty"], """
select * from (
  select item_id, order_id, quantity, seq,
         case when item_id = 0 then 'missing item id' when quantity < 1 then 'quantity below 1'
              when order_id = 0 then 'missing order id' end as reason
  from chg_item_qty) t
where reason is not null
""")

DELETES_OK = "(select * from chg_item_delete where item_id <> 0 and order_id <> 0)"
ITEMS_LEFT = f"(select * from shop_items where id not in (select item_id from {DELETES_OK} v))"
MOVES_DELETE = f"""(select product_id, quantity as d from shop_items
   where is_preorder = 0 and id in (select item_id from {DELETES_OK} v))"""
q("items_after_delete", ["shop_items", "chg_item_delete"],
  f"select id, order_id, product_id, quantity from {ITEMS_LEFT} t")
q("stock_after_item_delete", ["shop_items", "chg_item_delete", "shop_products"], stock_sql(MOVES_DELETE))
q("totals_after_delete", ["shop_orders", "shop_items", "chg_item_delete"],
  totals_sql(ITEMS_LEFT, f"o.id in (select order_id from {DELETES_OK} v)"))
q("orders_status_set", ["shop_orders", "chg_status"], """
select o.id, case when c.id is not null then c.status else o.status end as status
from shop_orders o left join (select id, arg_max(status, seq) as status from chg_status group by id) c on c.id = o.id
""")
q("stock_ledger", ["req_orders", "req_order_items", "shop_orders", "shop_items", "chg_cancel",
                   "chg_item_delete"], f"""
select product_id, {I('sum(placed)')} as placed, {I('sum(cancelled)')} as cancelled,
       {I('sum(deleted)')} as deleted, {I('sum(placed + cancelled + deleted)')} as net
from (select product_id, d as placed, 0 as cancelled, 0 as deleted from {MOVES_PLACED} a
      union all select product_id, 0, d, 0 from {MOVES_CANCEL} b
      union all select product_id, 0, 0, d from {MOVES_DELETE} c) t
group by product_id
""")
q("product_images_replaced", ["shop_product_images", "chg_product_images"], f"""
select product_id, {I('sort_order')} as sort_order, image_path from shop_product_images
where product_id not in (select product_id from chg_product_images)
union all
select product_id, {I('pos')}, image_path from chg_product_images
where image_path is not null and image_path not in ('', '0')
""")
q("products_updated", ["shop_products", "chg_product_update"], f"""
select p.id,
       {I("case when c.id is not null then c.category_id else p.category_id end")} as category_id,
       case when c.id is not null then c.name else p.name end as name,
       {M("case when c.id is not null then c.price else p.price end")} as price,
       {M("case when c.id is not null then coalesce(c.cost_price, 0) else p.cost_price end")} as cost_price,
       {I("case when c.id is not null then c.stock else p.stock end")} as stock,
       case when c.id is not null then '[]' else p.colors end as colors,
       case when c.id is not null then '[]' else p.sizes end as sizes,
       case when c.id is not null then c.status else p.status end as status,
       {I("case when c.id is not null then coalesce(c.pre_order, 0) else p.pre_order end")} as pre_order
from shop_products p
left join (select * from chg_product_update u
           where seq = (select max(seq) from chg_product_update v where v.id = u.id)) c on c.id = p.id
""")
_NEW_IDS = "(select *, (select max(id) from shop_products) + row_number() over (order by seq) as new_id from new_products)"
q("products_inserted", ["new_products", "shop_products"], f"""
select {I('new_id')} as id, {I('category_id')} as category_id, name, description, {M('price')} as price,
       {M('ifnull(cost_price, 0)')} as cost_price, {I('stock')} as stock, image, sku, weight, dimensions,
       ifnull(cast(to_json(colors) as varchar), '[]') as colors, ifnull(cast(to_json(sizes) as varchar), '[]') as sizes,
       {I('0')} as pre_order
from {_NEW_IDS}
""")
q("product_images_inserted", ["new_products", "shop_products"], f"""
select {I('new_id')} as product_id, {I('k - 1')} as sort_order, extra_images[k] as image_path
from (select new_id, extra_images, unnest(range(1, len(extra_images) + 1)) as k from {_NEW_IDS})
where extra_images[k] not in ('', '0')
""")
q("products_after_delete", ["shop_products", "chg_product_delete"],
  "select id, name from shop_products where id not in (select id from chg_product_delete)")
q("product_images_after_delete", ["shop_product_images", "shop_products", "chg_product_delete"], f"""
select id, product_id, {I('sort_order')} as sort_order, image_path from shop_product_images
where product_id not in (select id from chg_product_delete)
""")
q("stock_set", ["shop_products", "chg_stock"], f"""
select p.id, {I('case when c.id is not null then c.stock else p.stock end')} as stock
from shop_products p left join (select id, arg_max(stock, seq) as stock from chg_stock group by id) c on c.id = p.id
""")
q("products_reordered", ["shop_products", "chg_sort"], f"""
select p.id, {I('case when c.id is not null then c.sort_order else p.sort_order end')} as sort_order
from shop_products p left join (select id, arg_max(sort_order, seq) as sort_order from chg_sort group by id) c
  on c.id = p.id
""")
_CATEGORY_JUDGED = """(select t.*, case when reason is null and op in ('insert', 'update') and exists (
           select 1 from judged f where f.reason is null and f.op in ('insert', 'update') and f.seq < t.seq
                                    and lower(trim(f.name)) = lower(rtrim(t.name))) then 'duplicate name'
         else reason end as verdict from judged t)"""
_CATEGORY_FIRST = """
with judged as (select ch.*, case op
    when 'insert' then case when ifnull(name, '') in ('', '0') then 'name required'
                            when taken > 0 then 'duplicate name' end
    when 'update' then case when ifnull(id, 0) = 0 or ifnull(name, '') in ('', '0') then 'missing data'
                            when taken_by_others > 0 then 'duplicate name' end
    when 'delete' then case when ifnull(id, 0) = 0 then 'missing id' when used > 0 then 'has products' end
    else 'unknown op' end as reason
  from (select c.*,
          (select count(*) from shop_categories k where lower(rtrim(k.name)) = lower(rtrim(c.name))) as taken,
          (select count(*) from shop_categories k where lower(rtrim(k.name)) = lower(rtrim(c.name)) and k.id != c.id)
            as taken_by_others,
          (select count(*) from shop_products p where p.category_id = c.id) as used
        from chg_categories c) ch)
"""
q("category_changes_applied", ["chg_categories", "shop_categories", "shop_products"], f"""
from ({_CATEGORY_FIRST}
select {I('seq')} as seq, op, {I('id')} as id, if(op = 'delete', name, trim(name)) as name,
       if(verdict is null, 'applied', 'rejected') as status, verdict as reason
from {_CATEGORY_JUDGED})
""")
q("categories_after_changes", ["chg_categories", "shop_categories", "shop_products"], f"""
from ({_CATEGORY_FIRST},
done as (select op, id, seq, trim(name) as name, trim(ifnull(description, '')) as description
         from {_CATEGORY_JUDGED} where verdict is null),
renamed as (select id, arg_max(name, seq) as name, arg_max(description, seq) as description
            from done where op = 'update' group by id)
select {I('c.id')} as id, if(r.id is null, c.name, r.name) as name,
       if(r.id is null, c.description, r.description) as description
from shop_categories c left join renamed r on r.id = c.id
where c.id not in (select id from done where op = 'delete')
union all
select {I('(select max(id) from shop_categories) + row_number() over (order by seq)')}, name, description
from done where op = 'insert')
""")

# the plain fold: requests one by one, the table in a map
_CATEGORY_FOLD = f"""(with recursive r as (
    select *, row_number() over (order by seq) as i,
           (select count(*) from shop_products p where p.category_id = l.id) as used from category_log l),
  fold as (
    select 0::bigint as i, map_from_entries(list({{'k': id::bigint, 'v': {{'n': name, 'd': description}}}})) as m, (max(id) + 1)::bigint as nxt,
           0::bigint as seq, '' as op, null::bigint as id, null::varchar as name, null::varchar as reason
    from shop_categories
    union all
    select i, case when reason is not null then m
                   when op = 'insert' then map_concat(m, map([nxt], [{{'n': trim(name), 'd': trim(ifnull(description, ''))}}]))
                   when op = 'update' and m[id].n is not null then map_concat(m, map([id], [{{'n': trim(name), 'd': trim(ifnull(description, ''))}}]))
                   when op = 'delete' then map_from_entries(list_filter(map_entries(m), lambda x: x.key <> id))
                   else m end,
           nxt + case when op = 'insert' and reason is null then 1 else 0 end, seq, op, id, if(op = 'delete', name, trim(name)), reason
    from (
      select r.i, f.m, f.nxt, r.seq, r.op, r.id::bigint as id, r.name, r.description,
        case when r.op = 'insert' and ifnull(r.name, '') in ('', '0') then 'name required'
             when r.op = 'update' and (ifnull(r.id, 0) = 0 or ifnull(r.name, '') in ('', '0')) then 'missing data'
             when r.op = 'delete' and ifnull(r.id, 0) = 0 then 'missing id'
             when r.op = 'delete' and r.used > 0 then 'has products'
             when r.op in ('insert', 'update') and len(list_filter(map_entries(f.m), lambda x: lower(rtrim(x.value.n)) = lower(rtrim(r.name))
                  and (r.op = 'insert' or x.key <> r.id))) > 0 then 'duplicate name' end as reason
      from fold f join r on r.i = f.i + 1) s)
  select * from fold)"""
q("category_log_judged", ["category_log", "shop_categories", "shop_products"], f"""
select seq, op, id, name, if(reason is null, 'applied', 'rejected') as status, reason from {_CATEGORY_FOLD} f where i > 0
""")
q("categories_replayed", ["category_log", "shop_categories", "shop_products"], f"""
select x.key as id, x.value.n as name, x.value.d as description
from (select * from {_CATEGORY_FOLD} f order by i desc limit 1) l, unnest(map_entries(l.m)) t(x)
""")

# ------------------------------------------------------------------ one log of order changes
# The plain fold: an order's events one by one; its lines are a map.
_LINE_T = "map(bigint, struct(q bigint, price decimal(15,2), product bigint, pre bigint))"
_MOVES_T = "struct(product bigint, d bigint)[]"
ORDER_FOLD = f"""(with recursive e as (
    select *, row_number() over (partition by coalesce(nullif(order_id, 0), seq // 1000000) order by seq) as i,
           coalesce(nullif(order_id, 0), seq // 1000000) as own, coalesce(quantity, 1) as n
    from order_log),
  fold as (
    select o.id, o.status, 0::bigint as i, null::bigint as items, false as touched,
           coalesce(l.m, map {{}}::{_LINE_T}) as m, []::{_MOVES_T} as moves, 0::bigint as seq, '' as op, null::varchar as reason
    from shop_orders o left join (
      select order_id, map_from_entries(list({{'k': id, 'v': {{'q': quantity, 'price': price, 'product': product_id, 'pre': is_preorder}}}}))::{_LINE_T} as m
      from shop_items group by order_id) l on l.order_id = o.id
    union all
    select s.id,
      case when s.reason is not null or s.op not in ('cancel', 'status') then s.status when s.op = 'cancel' then 'cancelled' else s.new_status end,
      s.i, case when s.reason is null and s.op in ('edit', 'delete')
                then cast(trunc(coalesce(list_sum([x.value.q * x.value.price for x in map_entries(s.m2)]), 0)) as bigint) else s.items end,
      s.touched or (s.reason is null and s.op in ('edit', 'delete')), s.m2,
      case when s.reason is not null then s.moves
           when s.op = 'cancel' then list_concat(s.moves, [{{'product': x.value.product, 'd': x.value.q}} for x in map_entries(s.m)])
           when s.op = 'delete' and s.m[s.item_id].pre = 0 then list_append(s.moves, {{'product': s.m[s.item_id].product, 'd': s.m[s.item_id].q}})
           else s.moves end,
      s.seq, s.op, s.reason
    from (
      select g.*, case when reason is not null then g.m
                       when op = 'edit' and g.m[item_id].q is not null then map_concat(g.m, map([item_id],
                         [{{'q': n, 'price': g.m[item_id].price, 'product': g.m[item_id].product, 'pre': g.m[item_id].pre}}]))::{_LINE_T}
                       when op = 'delete' then map_from_entries(list_filter(map_entries(g.m), lambda x: x.key <> item_id))::{_LINE_T}
                       else g.m end as m2
      from (
        select f.id, f.status, e.i, f.items, f.touched, f.m, f.moves, e.seq, e.op, e.item_id, e.n, e.status as new_status,
          case when e.op in ('edit', 'delete') and (coalesce(e.item_id, 0) = 0 or coalesce(e.order_id, 0) = 0) then 'missing data'
               when e.op = 'edit' and e.n < 1 then 'missing data'
               when e.op = 'delete' and f.m[e.item_id].q is null then 'not found'
               when e.op = 'cancel' and e.order_id = 0 then 'missing id'
               when e.op = 'cancel' and coalesce(f.status, '') <> 'pending' then 'not pending' end as reason
        from fold f join e on e.own = f.id and e.i = f.i + 1) g) s)
  select * from fold)"""
_FOLDED = f"(select * from {ORDER_FOLD} a qualify row_number() over (partition by id order by i desc) = 1)"
_LOG = ["order_log", "shop_orders", "shop_items"]
q("order_log_replayed", _LOG, f"""
select f.id, f.status, f.items as items_total,
       {M('case when touched then f.items + cast(trunc(coalesce(o.shipping_fee, 0)) as bigint) else o.total_amount end')} as total_amount
from {_FOLDED} f join shop_orders o using (id)
""")
q("order_log_lines", _LOG, f"""
select x.key as id, f.id as order_id, {I('x.value.q')} as quantity from {_FOLDED} f, unnest(map_entries(f.m)) t(x)
""")
q("order_log_stock", [*_LOG, "shop_products"], f"""
select p.id, {I('p.stock + coalesce(d.n, 0)')} as stock from shop_products p left join (
  select x.product as id, sum(x.d) as n from {_FOLDED} f, unnest(f.moves) t(x) group by x.product) d using (id)
""")
q("order_log_rejected", _LOG, f"""
select seq, op, reason from {ORDER_FOLD} a where reason is not null
union all select seq, op, 'not found' from order_log where op = 'cancel' and order_id not in (select id from shop_orders)
""")

# ------------------------------------------------------------------ carts
# Window restatement of the fold (different from the aggregate plan in Spark).
_LINE = "partition by cart_id, product_id, color"
_RUN = "order by seq rows between unbounded preceding and current row"
CART_REPLAY = f"""(
  with w as (
    select cart_id, seq, product_id, coalesce(color, '') as color, action, qty, price,
           count(case when action = 'clear' then 1 end) over (partition by cart_id {_RUN}) as clr_run,
           count(case when action = 'clear' then 1 end) over (partition by cart_id) as clr_tot,
           count(case when action = 'remove' or (action = 'set' and qty < 1) then 1 end)
             over (partition by cart_id, product_id, coalesce(color, '') {_RUN}) as kill_run,
           count(case when action = 'remove' or (action = 'set' and qty < 1) then 1 end)
             over (partition by cart_id, product_id, coalesce(color, '')) as kill_tot
    from cart_events),
  s as (select * from w where clr_run = clr_tot and kill_run = kill_tot
                          and (action = 'add' or (action = 'set' and qty >= 1))),
  a as (select *, count(case when action = 'add' then 1 end) over ({_LINE} {_RUN}) as add_run from s),
  b as (select * from a where not (action = 'set' and add_run = 0)),
  c as (select *, count(case when action = 'set' then 1 end) over ({_LINE} {_RUN}) as set_run,
                  count(case when action = 'set' then 1 end) over ({_LINE}) as set_tot from b),
  price as (select cart_id, product_id, color, arg_min(price, seq) as price from b where action = 'add'
            group by 1, 2, 3),
  qty as (select cart_id, product_id, color, sum(qty) as qty from c where set_run = set_tot group by 1, 2, 3)
  select q.cart_id, q.product_id, q.color, q.qty, p.price
  from qty q join price p using (cart_id, product_id, color))"""
q("cart_replay", ["cart_events"],
  f"select cart_id, product_id, color, {I('qty')} as qty, {M('price')} as price from {CART_REPLAY} r")
# the plain fold: events of a cart one by one, its lines in a map
q("cart_running", ["cart_events"], f"""
select * from (with recursive e as (
    select cart_id, seq, action, product_id, coalesce(color, '') as color, qty, cast(price as decimal(20,2)) as price,
           cast(product_id as varchar) || '|' || coalesce(color, '') as line,
           row_number() over (partition by cart_id order by seq) as i
    from cart_events),
  fold as (
    select cart_id, 0::bigint as seq, '' as action, null::bigint as product_id, null::varchar as color, ''::varchar as line,
           0::bigint as i, map {{}}::map(varchar, struct(q bigint, p decimal(20,2))) as m from e where i = 1
    union all
    select e.cart_id, e.seq, e.action, e.product_id, e.color, e.line, e.i,
      case when e.action = 'clear' then map {{}}::map(varchar, struct(q bigint, p decimal(20,2)))
           when e.action = 'add' then map_concat(m, map([e.line],
             [{{'q': coalesce(m[e.line].q, 0) + e.qty, 'p': coalesce(m[e.line].p, e.price)}}]))
           when e.action = 'set' and e.qty >= 1 then
             case when m[e.line].q is null then m else map_concat(m, map([e.line], [{{'q': e.qty, 'p': m[e.line].p}}])) end
           else map_from_entries(list_filter(map_entries(m), lambda x: x.key <> e.line)) end
    from fold join e on e.cart_id = fold.cart_id and e.i = fold.i + 1),
  pieces as (select *, [{{'n': case when x.value.q <> 0 then x.value.q else 1 end, 'p': x.value.p}} for x in map_entries(m)] as l from fold where i > 0)
  select cart_id, seq, action, case when action <> 'clear' then product_id end as product_id,
         case when action <> 'clear' then color end as color,
         case when action <> 'clear' then m[line].q end as qty, case when action <> 'clear' then {M('m[line].p')} end as price,
         {I("coalesce(list_sum([x.n for x in l]), 0)")} as count, {M("coalesce(list_sum([x.n * x.p for x in l]), 0)")} as total
  from pieces) t
""")
q("cart_totals", ["cart_events"], f"""
select cart_id, {I('sum(case when qty is null or qty = 0 then 1 else qty end)')} as count,
       {M('sum(price * case when qty is null or qty = 0 then 1 else qty end)')} as total from {CART_REPLAY} r group by cart_id
""")
q("cart_key_slug", ["cart_events"], """
select cart_id, product_id, color,
       regexp_replace(cast(product_id as varchar) || '_' || color, '[^a-zA-Z0-9]', '-', 'g') as slug
from """ + CART_REPLAY + " r")
q("cart_lines_normalised", ["cart_events", "shop_products"], f"""
select r.cart_id, r.product_id, r.color, cast(r.product_id as varchar) || '_' || r.color as key,
       {I('case when coalesce(r.qty, 0) <> 0 then r.qty else 1 end')} as quantity,
       case when p.name_lo is null or p.name_lo = '' then p.name else p.name_lo end as name_lo,
       case when p.image is null or p.image = '' then '' else p.image end as image_url,
       {M('r.price')} as price,
       {M('r.price * case when coalesce(r.qty, 0) <> 0 then r.qty else 1 end')} as line_total
from {CART_REPLAY} r left join shop_products p on p.id = r.product_id
""")
q("cart_merged", ["cart_events", "shop_products"], f"""
select e.cart_id, e.product_id, coalesce(e.color, '') as color, {I('sum(e.qty)')} as qty,
       {M('arg_min(e.price, e.seq)')} as price, {I('max(coalesce(p.pre_order, 0))')} as is_preorder,
       {I('count(*)')} as adds
from cart_events e left join shop_products p on p.id = e.product_id
where e.action = 'add'
group by 1, 2, 3
""")
q("carrier_map", ["carrier_events"], """
select user_id, carrier, trim(member_number) as member_number from (
  select user_id, carrier, member_number,
         row_number() over (partition by user_id, carrier order by seq desc) as back
  from carrier_events) t
where back = 1 and trim(coalesce(member_number, '')) <> ''
""")

# ------------------------------------------------------------------ sources / scalar helpers
q("order_requests_parsed", ["req_orders", "req_order_items"], f"""
select r.request_id, r.name, r.phone, i.product_id, i.quantity as qty, {M('i.price')} as price,
       {I('i.is_preorder')} as is_preorder
from req_orders r join req_order_items i on i.request_id = r.request_id
""")
q("orders_mixed_versions", ["shop_orders"], f"""
select id, status, cast(0 as double) as items_total,
       {M("if(year(created_at) < 1996, 0, shipping_fee)")} as shipping_fee,
       if(year(created_at) < 1996, null, shipping_company) as shipping_company,
       if(year(created_at) < 1996, 'transfer', payment_method) as payment_method, {TS('created_at')} as created_at
from shop_orders
""")
q("orders_as_json", ["shop_orders"], f"""
select id, order_number, customer_phone, {M('total_amount')} as total_amount, payment_method, status, member_id,
       {TS('created_at')} as created_at
from shop_orders
""")
q("escaped_text", [], """
select doc_id, replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'),
                       '"', '&quot;') as escaped
from documents
""")
q("fit_ratio", ["image_sizes"], f"""
select id, least(1.0, 1920.0 / w, 700.0 / h) as ratio,
       {I('floor(w * least(1.0, 1920.0 / w, 700.0 / h) + 0.5)')} as w2,
       {I('floor(h * least(1.0, 1920.0 / w, 700.0 / h) + 0.5)')} as h2
from image_sizes
""")


def oracle_sql() -> dict[str, str]:
    return {k: oracle_with(v, body) for k, (v, body) in Q.items()}
