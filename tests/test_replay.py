"""Running scans and replayed logs against plain folds, with hot keys over many parts."""

import datetime as dt
import random
from collections import Counter
from decimal import Decimal as D

import numpy as np
import pytest
from pyspark.sql import functions as F

from kipmart.operators import cart as K
from kipmart.operators import categorylog as G
from kipmart.operators import members as M
from kipmart.operators import orderlog as L
from kipmart.plans import scan

T0 = dt.datetime(2024, 1, 1)


def at(minutes):
    return T0 + dt.timedelta(seconds=round(60 * minutes))


@pytest.fixture
def many_parts(spark):
    """No merging of small partitions, so a key with most rows lies over several."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_hot_key_lies_over_several_parts_and_last_is_carried(spark, many_parts):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), k, k if rng.random() < 0.02 else None) for k in range(3000)]
    rows += [(None, 5000, 1), (None, 5001, None)]
    parts = scan.sorted_parts(spark.createDataFrame(rows, "k string, seq long, v long"), ["k"], [F.col("seq")])
    assert parts.filter("k = 'hot'").select("__pid").distinct().count() > 3
    got = {(r.k, r.seq): r.last for r in scan.running_last(parts, ["k"], F.col("v"), "last").collect()}
    last = {}
    for k, seq, v in sorted(rows, key=lambda r: r[1]):
        last[k] = v if v is not None else last.get(k)
        assert got[k, seq] == last[k]


def test_asof_join(spark, many_parts):
    rng = random.Random(2)
    left = [(rng.choice(["a", "b", "hot", "hot", None]), rng.randint(0, 300), k) for k in range(800)] + [("a", None, 900)]
    right = [(rng.choice(["a", "hot", "hot", "z", None]), rng.randint(0, 300), 1000 + k, f"v{k}") for k in range(200)]
    out = scan.asof_join(spark.createDataFrame(left, "k string, t int, seq long"),
                         spark.createDataFrame(right, "k string, t int, seq long, v string"), ["k"], ["t", "seq"], "r")
    assert out.columns == ["k", "t", "seq", "r"]
    got = {r.seq: r.r.v if r.r else None for r in out.collect()}
    for k, t, seq in left:
        older = [(x[1], x[2], x[3]) for x in right if k is not None and x[0] == k and t is not None and x[1] <= t]
        assert got[seq] == (max(older)[2] if older else None)
    assert len(got) == len(left)


def test_segmented_prefixes():
    rng = np.random.default_rng(0)
    v, fresh = rng.integers(0, 9, 500), rng.random(500) < 0.05
    fresh[0] = True
    (got,) = scan.segmented((v,), fresh, lambda f, g: (f[0] * 10 % 997 + g[0],))
    acc = None
    for x, new, y in zip(v, fresh, got):
        acc = x if new else acc * 10 % 997 + x
        if new:
            assert y == x
    (total,) = scan.segmented((v,), fresh, lambda f, g: (f[0] + g[0],))
    assert total.tolist() == [int(v[max(i for i in range(k + 1) if fresh[i]):k + 1].sum()) for k in range(500)]


def test_attempts_as_of_by_hand(spark):
    req = [("020 1", "111111", at(0), 1), ("0201", "222222", at(3), 2), ("", "333333", at(0), 3), ("0202", "444444", at(0), 4)]
    att = [(10, "0201", "111111", at(1)),      # the first code, in time
           (11, "0201", "111111", at(2)),      # used up
           (12, "0201", "111111", at(4)),      # replaced by the second code
           (13, "0201", " 222222", at(7.9)),   # the second, blanks trimmed
           (14, "0202", "444444", at(5)),      # expires at that moment
           (15, "0202", "44444", at(1)),       # five characters
           (16, "0203", "111111", at(1)),      # unknown phone
           (17, "0201", "222222", at(3)),      # the moment of the request itself, before 13
           (18, None, "111111", at(1)), (19, "", "333333", at(1))]
    r = spark.createDataFrame(req, "phone string, otp string, requested_at timestamp_ntz, seq long")
    a = spark.createDataFrame(att, "seq long, phone string, otp string, attempted_at timestamp_ntz")
    checked = M.otp_attempts_as_of(r, a)
    got = {x.seq: (x.code_seq, x.valid) for x in checked.collect()}
    assert got == {10: (1, True), 11: (1, False), 12: (2, False), 13: (2, False), 14: (4, False), 15: (4, False),
                   16: (None, False), 17: (2, True), 18: (None, False), 19: (None, False)}
    assert [tuple(x) for x in M.otps_after_log(r, checked).collect()] == [("0202", "444444", at(5))]


def test_tokens_by_hand(spark):
    req = spark.createDataFrame([("020-1", "1", at(0), 1), ("0201", "2", at(12), 2), ("0202", "3", at(0), 3), ("0203", "3", at(0), 4)],
                                "phone string, otp string, requested_at timestamp_ntz, seq long")
    checked = spark.createDataFrame([(10, "0201", at(1), True), (11, "0202", at(1), True), (12, "0203", at(1), False)],
                                    "seq long, phone string, attempted_at timestamp_ntz, valid boolean")
    issued = M.otp_tokens_issued(checked)
    assert sorted((r.phone, r.token) for r in issued.collect()) == [("0201", "T10"), ("0202", "T11")]
    att = spark.createDataFrame([
        (20, "020 1", " T10 ", at(10.9)),  # re-armed for ten minutes
        (21, "0201", "T10", at(11)),       # used, and expired
        (22, "0201", "T10", at(13)),       # armed again by the second request, but used
        (23, "0202", "T10", at(2)),        # another phone's token
        (24, "0202", "T11", at(11)),       # expires at that moment
        (25, "0203", "T12", at(2)), (26, "", "", at(2)), (27, None, None, at(2))],
        "seq long, phone string, token string, attempted_at timestamp_ntz")
    got = {r.seq: (r.issue_seq, r.valid) for r in M.otp_tokens_checked(req, issued, att).collect()}
    assert got == {20: (10, True), 21: (10, False), 22: (10, False), 23: (11, False), 24: (11, False), 25: (None, False),
                   26: (None, False), 27: (None, False)}


def test_attempts_as_of_like_a_fold(spark, many_parts):
    rng = random.Random(3)
    phones = ["0201"] * 7 + ["0202", "0203"]
    req = [(rng.choice(phones), f"{rng.randint(0, 2):06d}", at(rng.randint(0, 400) / 4), k) for k in range(300)]
    att = [(1000 + k, rng.choice(phones), f"{rng.randint(0, 2):06d}", at(rng.randint(0, 400) / 4)) for k in range(500)]
    log = sorted([(t, 0, seq, p, o) for p, o, t, seq in req] + [(t, 1, seq, p, o) for seq, p, o, t in att])
    state, want = {}, {}
    for t, kind, seq, p, o in log:
        if kind == 0:
            state[p] = (o, t + dt.timedelta(minutes=5))
        else:
            want[seq] = p in state and state[p][0] == o and state[p][1] > t
            if want[seq]:
                del state[p]
    checked = M.otp_attempts_as_of(spark.createDataFrame(req, "phone string, otp string, requested_at timestamp_ntz, seq long"),
                                   spark.createDataFrame(att, "seq long, phone string, otp string, attempted_at timestamp_ntz"))
    assert {r.seq: r.valid for r in checked.collect()} == want
    left = M.otps_after_log(spark.createDataFrame(req, "phone string, otp string, requested_at timestamp_ntz, seq long"), checked)
    assert {r.phone: (r.otp, r.expires_at) for r in left.collect()} == state


EVENTS = "cart_id long, seq long, product_id long, color string, action string, qty int, price decimal(15,2)"


def fold_carts(events):
    carts, out = {}, {}
    for cart, seq, product, color, action, qty, price in sorted(events, key=lambda e: (e[0], e[1])):
        lines, key = carts.setdefault(cart, {}), (product, color or "")
        if action == "clear":
            lines.clear()
        elif action == "add":
            q, p = lines.get(key, (0, price))
            lines[key] = (q + qty, p)
        elif action == "set" and qty >= 1:
            if key in lines:
                lines[key] = (qty, lines[key][1])
        elif action in ("set", "remove"):
            lines.pop(key, None)
        here = lines.get(key, (None, None)) if action != "clear" else (None, None)
        pieces = [(q or 1, p) for q, p in lines.values()]
        out[cart, seq] = (*here, sum(n for n, _ in pieces), sum((n * p for n, p in pieces), D(0)))
    return out


def running(spark, events):
    return {(r.cart_id, r.seq): (r.qty, r.price, r["count"], r.total)
            for r in K.cart_running(spark.createDataFrame(events, EVENTS)).collect()}


def test_running_cart_by_hand(spark):
    ev = [(1, 1, 7, "", "add", 2, D("10.00")), (1, 2, 7, None, "add", 1, D("99.00")), (1, 3, 8, "x", "set", 5, None),
          (1, 4, 8, "x", "add", 1, D("0.50")), (1, 5, 7, "", "set", 4, None), (1, 6, 8, "x", "set", 0, None),
          (1, 7, None, None, "clear", None, None), (1, 8, 7, "", "set", 9, None), (1, 9, 7, "", "add", 0, D("3.00"))]
    got = running(spark, ev)
    assert got[1, 2] == (3, D("10.00"), 3, D("30.00"))
    assert got[1, 3] == (None, None, 3, D("30.00"))      # a set of a missing line
    assert got[1, 4] == (1, D("0.50"), 4, D("30.50"))
    assert got[1, 5] == (4, D("10.00"), 5, D("40.50"))
    assert got[1, 6] == (None, None, 4, D("40.00"))      # set below one removes
    assert got[1, 7] == (None, None, 0, D(0))
    assert got[1, 8] == (None, None, 0, D(0))            # cleared lines are missing
    assert got[1, 9] == (0, D("3.00"), 1, D("3.00"))     # no quantity counts as one piece


def test_running_cart_like_a_fold(spark, many_parts):
    rng = random.Random(4)
    actions = ["add"] * 5 + ["set"] * 4 + ["remove", "other"] + ["clear"] * 0
    ev = [(1 if rng.random() < 0.6 else rng.randint(2, 9), k, rng.choice([1, 1, 1, 2, 3]), rng.choice(["", None, "r"]),
           "clear" if rng.random() < 0.01 else rng.choice(actions), rng.randint(0, 4), D(rng.randint(1, 999)) / 100)
          for k in range(4000)]
    assert running(spark, ev) == fold_carts(ev)
    assert running(spark, []) == {}
    # the last state of every line is what the replay of whole carts gives
    df = spark.createDataFrame(ev, EVENTS)
    final = K.cart_totals(K.cart_replay(df)).collect()
    last = {}
    for (cart, seq), v in sorted(fold_carts(ev).items()):
        last[cart] = v[2:]
    assert {r.cart_id: (r["count"], r.total) for r in final} == {c: v for c, v in last.items() if v[0]}


class Tables:
    def __init__(self, spark, orders, items, products):
        orders = [(i, s, None if f is None else D(f), t, x) for i, s, f, t, x in orders]
        self.orders = spark.createDataFrame(orders, "id long, status string, shipping_fee decimal(15,0), total_amount decimal(15,2), since long")
        self.items = spark.createDataFrame(items, "id long, order_id long, product_id long, quantity long, price decimal(15,2), is_preorder int, since long")
        self.products = spark.createDataFrame(products, "id long, stock int")


LOG = "seq long, op string, order_id long, item_id long, quantity long, status string"


def fold_log(orders, items, products, log):
    o = {r[0]: {"status": r[1], "fee": int(r[2] or 0), "items": None, "total": r[3], "since": r[4]} for r in orders}
    it = {r[0]: dict(zip(("order", "product", "q", "price", "pre", "since"), r[1:])) for r in items}
    stock, bad = dict(products), []
    gone = set()

    def line(i, seq):
        return i in it and i not in gone and (it[i]["since"] is None or it[i]["since"] < seq)

    def order(i, seq):
        return i in o and (o[i]["since"] is None or o[i]["since"] < seq)

    def total(i, seq):
        if order(i, seq):
            s = int(sum((x["q"] * x["price"] for k, x in it.items() if x["order"] == i and line(k, seq)), D(0)))
            o[i]["items"], o[i]["total"] = s, D(s + o[i]["fee"])
    for seq, op, oid, iid, qty, status in sorted(log, key=lambda e: e[0]):
        oid, iid, qty = oid or 0, iid or 0, 1 if qty is None else qty
        if op == "cancel":
            why = "missing id" if not oid else "not found" if not order(oid, seq) else \
                "not pending" if o[oid]["status"] != "pending" else None
            if why:
                bad.append((seq, op, why))
                continue
            o[oid]["status"] = "cancelled"
            for k, x in it.items():
                if x["order"] == oid and line(k, seq) and x["product"] in stock:
                    stock[x["product"]] += x["q"]
        elif op == "status":
            if order(oid, seq):
                o[oid]["status"] = status
        elif op == "edit":
            if not iid or not oid or qty < 1:
                bad.append((seq, op, "missing data"))
                continue
            if line(iid, seq):
                it[iid]["q"] = qty
            total(oid, seq)
        elif op == "delete":
            if not iid or not oid:
                bad.append((seq, op, "missing data"))
            elif not line(iid, seq):
                bad.append((seq, op, "not found"))
            else:
                if not it[iid]["pre"] and it[iid]["product"] in stock:
                    stock[it[iid]["product"]] += it[iid]["q"]
                gone.add(iid)
                total(oid, seq)
        else:
            bad.append((seq, op, "unknown op"))
    return ({k: (v["status"], v["items"], v["total"]) for k, v in o.items()},
            {k: v["q"] for k, v in it.items() if k not in gone}, stock, sorted(bad, key=str))


def replay(spark, orders, items, products, log):
    got = L.replay_order_log(Tables(spark, orders, items, products), spark.createDataFrame(log, LOG))
    return ({r.id: (r.status, r.items_total, r.total_amount) for r in got["orders"].collect()},
            {r.id: r.quantity for r in got["items"].collect()}, {r.id: r.stock for r in got["products"].collect()},
            sorted(map(tuple, got["rejected"].collect()), key=str))


def test_order_log_by_hand(spark):
    orders = [(1, "pending", 25, D("100.00"), None), (2, None, None, D("7.50"), None), (3, "pending", 5, D(0), 50)]
    items = [(11, 1, 91, 2, D("10.50"), 0, None), (12, 1, 92, 3, D("1.00"), 1, None), (31, 3, 91, 1, D(4), 0, 50)]
    log = [(10, "edit", 1, 11, 5, None),        # 52.50 + 3 -> 55
           (20, "cancel", 1, None, None, None),  # puts back 5 and 3 (the pre-order line too)
           (30, "cancel", 1, None, None, None),  # no longer pending
           (40, "status", 1, None, None, "pending"),
           (41, "delete", 1, 12, None, None),    # a pre-order line: no stock back, total 52 + 25
           (42, "cancel", 1, None, None, None),  # pending again: puts back 5
           (45, "cancel", 3, None, None, None),  # not placed yet
           (60, "edit", 3, 31, None, None),      # quantity defaults to 1
           (61, "cancel", 2, None, None, None), (62, "refund", 2, None, None, None)]
    got = replay(spark, orders, items, [(91, 0), (92, 0)], log)
    assert got == ({1: ("cancelled", 52, D("77.00")), 2: (None, None, D("7.50")), 3: ("pending", 4, D("9.00"))},
                   {11: 5, 31: 1}, {91: 10, 92: 3},
                   [(30, "cancel", "not pending"), (45, "cancel", "not found"), (61, "cancel", "not pending"), (62, "refund", "unknown op")])
    assert got == fold_log(orders, items, [(91, 0), (92, 0)], log)


@pytest.mark.parametrize("seed", [1, 2])
def test_order_log_like_a_fold(spark, many_parts, seed):
    rng = random.Random(seed)
    some = lambda: 1 if rng.random() < 0.6 else rng.randint(2, 12)
    orders = [(k, rng.choice(["pending", "pending", "shipped", None]), rng.choice([None, 0, 25]), D(rng.randint(0, 999)),
               rng.choice([None, None, 300])) for k in range(1, 11)]
    items = [(100 + k, some(), rng.randint(1, 6), rng.randint(1, 5), D(rng.randint(1, 999)) / 100, rng.choice([0, 1, None]),
              rng.choice([None, None, 300])) for k in range(60)]
    products = [(k, rng.randint(0, 9)) for k in range(1, 6)]
    log = []
    for seq in range(900):
        op = rng.choice(["cancel", "status", "edit", "edit", "delete", "status", "other" if rng.random() < 0.1 else "edit"])
        log.append((seq, op, rng.choice([some(), some(), 0, None]) if rng.random() < 0.1 else some(),
                    rng.choice([None, 0]) if rng.random() < 0.05 else 100 + rng.randint(0, 65),
                    rng.choice([None, 0, 1, 2, 7]), rng.choice(["pending", "pending", "shipped", None])))
    want = fold_log(orders, items, products, log)
    assert replay(spark, orders, items, products, log) == want
    assert Counter(r[2] for r in want[3]).keys() >= {"not pending", "not found", "missing data"}


class Shop:
    def __init__(self, spark, categories, used=()):
        self.categories = spark.createDataFrame(categories, "id int, name string, description string")
        self.products = spark.createDataFrame([(k, c) for k, c in enumerate(used)], "id long, category_id int")


CATEGORY_LOG = "seq long, op string, id int, name string, description string"


def trimmed(s):
    return s.strip(" \t\n\r\0\x0b") if s is not None else None


def fold_categories(categories, used, log):
    table, free, out = {i: (n, d) for i, n, d in categories}, max([0, *[c[0] for c in categories]]) + 1, []
    key = lambda n: n.rstrip(" ").lower() if n is not None else None
    for seq, op, i, name, text in sorted(log, key=lambda r: r[0]):
        taken = [k for k, v in table.items() if name is not None and key(v[0]) == key(name) and (op == "insert" or k != i)]
        why = None
        if op in ("insert", "update") and name in (None, "", "0"):
            why = "name required" if op == "insert" else "missing data"
        elif op == "update" and not i:
            why = "missing data"
        elif op in ("insert", "update") and taken:
            why = "duplicate name"
        elif op == "delete":
            why = "missing id" if not i else "has products" if i in used else None
        elif op not in ("insert", "update"):
            why = "unknown op"
        if not why and op == "insert":
            table[free], free = (trimmed(name), trimmed(text or "")), free + 1
        elif not why and op == "update" and i in table:
            table[i] = (trimmed(name), trimmed(text or ""))
        elif not why and op == "delete":
            table.pop(i, None)
        out.append((seq, why))
    return sorted(out), table


def replay_categories(spark, categories, used, log):
    got = G.replay_category_log(Shop(spark, categories, used), spark.createDataFrame(log, CATEGORY_LOG))
    return (sorted((r.seq, r.reason) for r in got["requests"].collect()),
            {r.id: (r.name, r.description) for r in got["categories"].collect()}, got["rounds"])


def test_category_chain_by_hand(spark):
    table = [(1, "A", ""), (2, "B", ""), (3, "C", None), (4, "c ", "twice in the table")]
    log = [(1, "update", 1, "B", None),        # B is taken
           (2, "update", 2, " Bee ", "x "),    # frees B
           (3, "update", 1, "b  ", None),      # now free
           (4, "insert", None, "a", "new"),    # and A is, so 5
           (5, "update", 5, "A", None),        # its own name in capitals
           (6, "delete", 4, None, None), (7, "update", 3, "C", None),   # the other holder is gone
           (8, "delete", 3, None, None),       # has products
           (9, "delete", 5, None, None), (10, "update", 5, "Late", None),  # gone: applied to nothing
           (11, "insert", None, "late", None), (12, "insert", None, "LATE ", None),
           (13, "update", 6, "B", None), (14, "delete", 0, None, None), (15, "insert", None, "0", None), (16, "x", 1, "n", None)]
    reasons, after, rounds = replay_categories(spark, table, [3], log)
    assert dict(reasons) == {**dict.fromkeys(range(1, 17)), 1: "duplicate name", 8: "has products", 12: "duplicate name",
                             13: "duplicate name", 14: "missing id", 15: "name required", 16: "unknown op"}
    assert after == {1: ("b", ""), 2: ("Bee", "x"), 3: ("C", ""), 6: ("late", "")}
    assert 2 <= rounds <= 8 and (reasons, after) == fold_categories(table, [3], log)


@pytest.mark.parametrize("seed", [1, 2])
def test_categories_like_a_fold(spark, many_parts, seed):
    rng = random.Random(seed)
    names = ["hot"] * 4 + ["Hot ", " hot", "b", "C", "c", "dd", "", "0", None]
    table = [(k, rng.choice(["hot", "b", "c", "e", None]), "d") for k in range(1, 7)]
    log = [(seq, rng.choice(["insert", "update", "update", "delete"]), rng.choice([None, 0, *range(1, 12)]), rng.choice(names),
            rng.choice([None, " t "])) for seq in range(120)]
    assert replay_categories(spark, table, [2, 2, 5], log)[:2] == fold_categories(table, [2, 5], log)
    assert replay_categories(spark, table, [], log[:0])[:2] == ([], {i: (n, d) for i, n, d in table})


def test_updated_at_moves_on_change(spark):
    members = spark.createDataFrame([(1, "0201", "n", "a", "1", at(0)), (2, "0202", None, "a", None, at(1)), (3, "0203", None, None, None, None)],
                                    "id long, phone string, name string, shipping_company string, member_number string, updated_at timestamp_ntz")
    changes = spark.createDataFrame([
        ("0201", "a", "1", 1, at(10)),   # nothing new
        ("0202", "a", None, 2, at(11)), ("0202", "b", None, 3, at(12)), ("0202", "b", None, 4, at(13)),
        ("02 04", "x", "9", 5, at(14)), ("0204", "x", "9", 6, at(15)),  # inserted, then the same again
        ("0205", "x", None, 7, at(16)), ("0205", "y", None, 8, at(17)), ("", "z", "z", 9, at(18))],
        "phone string, shipping_company string, member_number string, seq long, changed_at timestamp_ntz")
    got = {r.phone: (r.id, r.shipping_company, r.updated_at) for r in M.members_upserted(members, changes).collect()}
    assert got == {"0201": (1, "a", at(0)), "0202": (2, "b", at(12)), "0203": (3, None, None),
                   "0204": (4, "x", at(14)), "0205": (5, "y", at(17))}
