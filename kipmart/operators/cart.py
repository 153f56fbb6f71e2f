"""Carts rebuilt from event tables.

A cart event is ``(cart_id, seq, product_id, color, action, qty, price)`` with
``action`` one of ``add``, ``set``, ``remove``, ``clear``; a cart line is keyed
by ``(cart_id, product_id, color)``. The shop front's rules:

* ``add`` creates the line with its price and quantity, or adds to it;
* ``set`` replaces the quantity of an existing line (no-op when missing);
  ``set`` below 1 removes the line;
* ``remove`` drops the line, ``clear`` drops the whole cart.

The replay is a fold, but it is fully determined by a few per-key extremes,
so it is computed with grouped aggregates and key joins instead of a window
over each cart: the line's state after the last "kill" (clear of its cart,
remove, set < 1) is the first add after it (creation and price), the last set
after that add, and the adds after that set. Aggregates are partial (map-side),
and in the joins of events with one aggregate row per key hot keys are spread
(:func:`kipmart.plans.spread.spread_join`), so a cart holding a third of all
events is dealt over several tasks. The events are read six times: clears, kills,
live events, adds after a set, and once each to count hot carts and hot lines; no
pass sorts them. ``cart_running`` gives the state after every event instead.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.scan import Maps, local_scan, running_last, sorted_parts, with_carry
from kipmart.plans.spread import spread_join

LINE = ["cart_id", "product_id", "color"]


def cart_replay(events: DataFrame) -> DataFrame:
    """Final cart lines: cart_id, product_id, color, qty, price.

    Three steps, each an aggregate joined back by key:

    1. per cart the last ``clear``; per line the last kill (``remove``,
       ``set`` < 1);
    2. events after the line's cutoff ``K`` = max(last clear, last kill):
       first add (creation, price), last set ``S`` and its quantity;
    3. adds after ``S`` (only lines whose last set follows the first add).
    """
    ev = events.select("cart_id", "seq", "product_id",
                       F.coalesce(F.col("color"), F.lit("")).alias("color"),
                       "action", "qty", "price")
    act, seq = F.col("action"), F.col("seq")
    is_kill = (act == "remove") | ((act == "set") & (F.col("qty") < 1))
    clears = ev.filter(act == "clear").groupBy("cart_id").agg(F.max("seq").alias("clear_seq"))
    kills = ev.filter(is_kill).groupBy(*LINE).agg(F.max("seq").alias("kill_seq"))
    cutoff = F.greatest(F.coalesce(F.col("clear_seq"), F.lit(-1)),
                        F.coalesce(F.col("kill_seq"), F.lit(-1)))
    live = ev.filter((act == "add") | ((act == "set") & (F.col("qty") >= 1)))
    live = spread_join(spread_join(live, clears, ["cart_id"], counted=ev), kills, LINE, counted=ev)
    live = live.withColumn("cut", cutoff).filter(seq > F.col("cut"))
    is_add, is_set = act == "add", act == "set"
    stats = (live.groupBy(*LINE)
             .agg(F.max("cut").alias("cut"),
                  F.min(F.when(is_add, seq)).alias("first_add"),
                  F.min_by(F.when(is_add, F.col("price")), F.when(is_add, seq)).alias("price"),
                  F.max(F.when(is_set, seq)).alias("set_seq"),
                  F.max_by(F.when(is_set, F.col("qty")), F.when(is_set, seq)).alias("set_qty"),
                  F.sum(F.when(is_add, F.col("qty"))).alias("add_qty"))
             .filter(F.col("first_add").isNotNull()))
    # one row per line, read twice below: written once
    stats = write_temp_table(stats, "kipmart-cart")
    # a set before the first add hit a missing line (no-op); the last set after it rules
    valid_set = F.col("set_seq") > F.col("first_add")
    reset = stats.filter(valid_set).select(*LINE, "cut", "set_seq")
    tail = (spread_join(ev.filter(is_add), reset, LINE, "inner", counted=ev)
            .filter((seq > F.col("cut")) & (seq > F.col("set_seq")))
            .groupBy(*LINE).agg(F.sum("qty").alias("tail_qty")))
    out = stats.join(tail, LINE, "left")
    qty = (F.when(valid_set, F.col("set_qty") + F.coalesce(F.col("tail_qty"), F.lit(0)))
           .otherwise(F.col("add_qty")))
    return out.select(*LINE, qty.alias("qty"), "price")


# An event as a map of a line's state: what it makes of no line (``n_``: there is a
# line after it, quantity, price) and of a line of quantity x and price y (``l_``:
# there is one, keep * x + add, price given or y). Prices are in hundredths.
MAP = ["n_there", "n_qty", "n_price", "l_there", "l_keep", "l_add", "l_priced", "l_price"]
ADD, SET, DROP = 1, 2, 3


def _line_maps(action: np.ndarray, qty: np.ndarray, cents: np.ndarray) -> Maps:
    add, set_, none = action == ADD, action == SET, np.zeros_like(qty)
    return (add * 1, np.where(add, qty, 0), np.where(add, cents, 0), (action != DROP) * 1,
            (add | (action == 0)) * 1, np.where(add | set_, qty, 0), none, none)


def _then(f: Maps, g: Maps) -> Maps:
    """``f`` first, then ``g``."""
    n_there, n_qty, n_price, l_there, l_keep, l_add, l_priced, l_price = f
    G_there, G_qty, G_price, M_there, M_keep, M_add, M_priced, M_price = g
    n, here = n_there == 1, l_there == 1
    return (np.where(n, M_there, G_there), np.where(n, M_keep * n_qty + M_add, G_qty),
            np.where(n, np.where(M_priced == 1, M_price, n_price), G_price),
            np.where(here, M_there, G_there), np.where(here, M_keep * l_keep, 0),
            np.where(here, M_keep * l_add + M_add, G_qty),
            np.where(here, np.maximum(l_priced, M_priced), 1),
            np.where(here, np.where(M_priced == 1, M_price, l_price), G_price))


def cart_running(events: DataFrame) -> DataFrame:
    """K3 / W3 after every event: the event's line (null for ``clear``) as it is
    then: there or not, quantity and price, and the cart's piece count and total.

    1. An event's epoch is its cart's last ``clear`` before it, so a line begins
       anew in every epoch.
    2. Every event is a map of its line's state (add, set, drop); maps are
       composed along (cart, epoch, line) in ``seq`` order inside range-sorted
       parts, and over their borders through one map per part.
    3. The cart's count and total are running sums, along (cart, epoch), of what
       each event changed: its line's pieces and value after it less those before.

    All three run over range-sorted parts (:mod:`kipmart.plans.scan`), so a cart
    with a third of all events lies over several tasks. ``seq`` is unique within a
    cart. Unknown actions change nothing."""
    act = F.col("action")
    ev = events.select("cart_id", "seq", "product_id", F.coalesce(F.col("color"), F.lit("")).alias("color"), "action",
                       F.col("qty").cast("bigint").alias("qty"), "price")
    kind = (F.when(act == "add", ADD).when((act == "set") & (F.col("qty") >= 1), SET)
            .when((act == "remove") | (act == "set"), DROP).otherwise(0))
    epochs = running_last(sorted_parts(ev, ["cart_id"], [F.col("seq")]), ["cart_id"],
                          F.when(act == "clear", F.col("seq")), "epoch").drop("__pid", "__pos")
    lines = (epochs.filter(act != "clear").withColumn("epoch", F.coalesce("epoch", F.lit(-1)))
             .withColumn("__kind", kind).withColumn("__cents", (F.col("price") * 100).cast("bigint")))
    keys = ["cart_id", "epoch", "product_id", "color"]
    done = with_carry(local_scan(lines, keys, [F.col("seq")], ["__kind", "qty", "__cents"], MAP, _line_maps, _then,
                                 before=True), MAP, _then)
    # a line starts as none; over a border as the parts before left it
    reached = _after("__c_", F.lit(False), F.lit(None), F.lit(None), F.col("__c_n_there").isNotNull())
    old = _after("__b_", *reached, F.col("__b") == 1)
    new = _after("", *reached, F.lit(True))
    state = done.select(*keys, "seq", "action", *[c.alias(f"{w}_{n}") for w, x in (("old", old), ("new", new))
                                                  for n, c in zip(("there", "qty", "cents"), x)])
    pieces = {w: F.when(F.col(f"{w}_there"), F.when(F.col(f"{w}_qty") != 0, F.col(f"{w}_qty")).otherwise(1)).otherwise(0)
              .cast("bigint") for w in ("old", "new")}
    value = {w: pieces[w] * F.coalesce(f"{w}_cents", F.lit(0)) for w in ("old", "new")}
    moves = state.select("cart_id", "epoch", "seq", "action", "product_id", "color",
                         F.when(F.col("new_there"), F.col("new_qty")).alias("qty"),
                         F.when(F.col("new_there"), F.col("new_cents")).alias("cents"),
                         (pieces["new"] - pieces["old"]).alias("d_count"), (value["new"] - value["old"]).alias("d_total"))
    names = ["s_count", "s_total"]
    sums = with_carry(local_scan(moves, ["cart_id", "epoch"], [F.col("seq")], ["d_count", "d_total"], names,
                                 lambda *d: d, _plus), names, _plus)
    count, total = (F.col(n) + F.coalesce(f"__c_{n}", F.lit(0)) for n in names)

    def money(cents):
        return (cents / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")

    none = {c: F.lit(None).cast(t).alias(c) for c, t in (("product_id", "bigint"), ("color", "string"), ("qty", "bigint"),
                                                         ("price", "decimal(20,2)"))}
    cleared = ev.filter(act == "clear").select("cart_id", "seq", "action", *none.values(), F.lit(0).cast("bigint").alias("count"),
                                               F.lit(0).cast("decimal(20,2)").alias("total"))
    return sums.select("cart_id", "seq", "action", F.col("product_id").cast("bigint").alias("product_id"), "color", "qty",
                       money(F.col("cents").cast("decimal(20,0)")).alias("price"), count.alias("count"),
                       money(total.cast("decimal(20,0)")).alias("total")).unionByName(cleared)


def _plus(f: Maps, g: Maps) -> Maps:
    return tuple(x + y for x, y in zip(f, g))


def _after(prefix: str, there, qty, cents, known):
    """(there, quantity, price) that the map of these columns makes of a state;
    the state itself where the map is not ``known``."""
    c = {n: F.col(prefix + n) for n in MAP}
    is_ = F.when(there, c["l_there"]).otherwise(c["n_there"]) == 1
    q = F.when(there, c["l_keep"] * qty + c["l_add"]).otherwise(c["n_qty"])
    p = F.when(there & (c["l_priced"] == 0), cents).when(there, c["l_price"]).otherwise(c["n_price"])
    return (F.when(known, is_).otherwise(there), F.when(known, q).otherwise(qty).cast("bigint"),
            F.when(known, p).otherwise(cents).cast("bigint"))


def cart_totals(lines: DataFrame) -> DataFrame:
    """A5: badge count ``Σ qty`` and total ``Σ price × qty`` per cart; a line
    without a quantity, or with 0, counts as one piece."""
    q = _pieces()
    return lines.groupBy("cart_id").agg(F.sum(q).alias("count"), F.sum(F.col("price") * q).alias("total"))


def _pieces():
    return F.when(F.coalesce(F.col("qty"), F.lit(0)) != 0, F.col("qty")).otherwise(F.lit(1))


def cart_key(product_id, color):
    return F.concat(F.col(product_id).cast("string"), F.lit("_"), F.coalesce(F.col(color), F.lit("")))


def cart_key_slug(lines: DataFrame) -> DataFrame:
    """The DOM-safe form of each line key."""
    return lines.select(*LINE, X.slug(cart_key("product_id", "color")).alias("slug"))


def cart_lines_normalised(lines: DataFrame, products: DataFrame) -> DataFrame:
    """K1: stored line → display line: key ``id_color``, quantity (qty, else
    quantity, else 1), Lao name falling back to the name, image URL falling
    back to the image or ''. Product attributes come from the catalogue."""
    p = products.select(F.col("id").alias("product_id"), "name", "name_lo", "image")
    j = lines.join(p, "product_id", "left")
    q = _pieces()
    return j.select(*LINE,
                    cart_key("product_id", "color").alias("key"),
                    q.alias("quantity"),
                    X.js_or("name_lo", "name").alias("name_lo"),
                    X.js_or(F.col("image"), F.lit("")).alias("image_url"),
                    "price",
                    (F.col("price") * q).alias("line_total"))


def cart_merged(events: DataFrame, products: DataFrame) -> DataFrame:
    """K2: add events merged by line: quantities add, the first price stays,
    ``is_preorder`` latches once any add was for a pre-order product."""
    p = products.select(F.col("id").alias("product_id"), F.col("pre_order"))
    # one row per line first, so the product join never meets single events
    lines = (events.filter(F.col("action") == "add")
             .withColumn("color", F.coalesce(F.col("color"), F.lit("")))
             .groupBy(*LINE).agg(F.sum("qty").alias("qty"), F.min_by("price", "seq").alias("price"),
                                 F.count(F.lit(1)).alias("adds")))
    return lines.join(p, "product_id", "left").select(
        *LINE, "qty", "price", F.coalesce(F.col("pre_order"), F.lit(0)).alias("is_preorder"), "adds")


def carrier_map(events: DataFrame) -> DataFrame:
    """K5: per user and carrier the latest member number, trimmed; an empty
    number deletes the entry. Returned exploded (user_id, carrier, member_number)."""
    latest = (events.groupBy("user_id", "carrier")
              .agg(F.max_by("member_number", "seq").alias("member_number")))
    return (latest.withColumn("member_number", F.trim(F.coalesce(F.col("member_number"), F.lit(""))))
            .filter(F.col("member_number") != ""))


def carrier_map_as_map(events: DataFrame) -> DataFrame:
    """K5 as one ``map<carrier, number>`` per user (a user has a handful of
    carriers, so the per-user collection is small by construction)."""
    return (carrier_map(events).groupBy("user_id")
            .agg(F.map_from_entries(F.collect_list(F.struct("carrier", "member_number")))
                 .alias("carriers")))
