"""F6 in bulk against a plain scan for each pattern, and hand cases."""

from __future__ import annotations

import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from kipmart.operators import search as H

PRODUCTS = [(1, "Red Shirt", "soft cotton", "active"), (2, "redwood table", None, "active"), (3, None, "A RED hat", "active"),
            (4, "100% wool_x", "warm", "active"), (5, "Red shirt", "soft", "inactive"), (6, None, None, "active"),
            (7, "ເສື້ອຂາວ", "ຂາວ", "active"), (8, "", "", "active"), (9, "ab", "c", "active"), (10, "a\\b", None, "active")]


def _found(spark, texts, products=PRODUCTS):
    T = SimpleNamespace(products=spark.createDataFrame(products, "id int, name string, description string, status string"))
    out = {}
    for r in H.product_search_bulk(T, spark.createDataFrame([(t,) for t in texts], "search string")).collect():
        out.setdefault(r.search, []).append(r.id)
    return {k: sorted(v) for k, v in out.items()}


def test_hand_cases(spark):
    got = _found(spark, ["red", "RED", "red shirt", "rd", "r_d s", "red%le", "", "%", "_", "ຂາວ", "b", "zzz", None,
                         r"100\%", r"\%", r"wool\_", "abc", "red", r"\r\ed"])
    assert got == {"red": [1, 2, 3], "RED": [1, 2, 3], "red shirt": [1], "r_d s": [1], "red%le": [2],
                   "": [1, 2, 3, 4, 7, 8, 9, 10], "%": [1, 2, 3, 4, 7, 8, 9, 10], "_": [1, 2, 3, 4, 7, 9, 10], "ຂາວ": [7],
                   "b": [2, 9, 10], r"100\%": [4], r"\%": [4], r"wool\_": [4], r"\r\ed": [1, 2, 3]}


def test_empty_tables(spark):
    assert _found(spark, []) == {}
    assert _found(spark, ["a"], products=[]) == {}


def test_equal_to_a_scan_for_each_pattern(spark):
    import random
    rng = random.Random(4)
    text = lambda n, letters: "".join(rng.choice(letters) for _ in range(rng.randint(0, n)))
    # one description on a third of the products: a gram of theirs is hot
    products = [(i, text(8, "abcAB "), "ab caa" if i % 3 == 0 else text(5, "abc"), "active") for i in range(300)]
    texts = sorted({text(5, "abcA%_") for _ in range(150)})
    want = {}
    for t in texts:
        pat = re.compile("".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in f"%{t}%"), re.I | re.S)
        hit = [i for i, a, b, _ in products if pat.fullmatch(a) or pat.fullmatch(b)]
        want |= {t: hit} if hit else {}
    assert _found(spark, texts, products) == want


def test_grams(spark):
    row = spark.range(1).select(*(H.pattern_grams(H.like_pattern(F.lit(t))).alias(str(i)) for i, t in enumerate(
        ["Abcd", "ab%c", "a_b", "%_", r"ab\%cde"]))).first()
    assert [sorted(g) for g in row] == [["abc", "bcd"], ["ab"], ["a", "b"], [""], ["cde"]]
