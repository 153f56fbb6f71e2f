import random
import re

import duckdb
import numpy as np
import pytest
from helpers import ODD, SF, docs_of

from kipmart.llm import op5_decontamination as op5
from kipmart.llm import op8_jaccard_join as op8
from kipmart.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute_hits(text, items, window=10):
    w, hit, found = WORD.findall(lower(text)), set(), set()
    for i, t in items:
        v = WORD.findall(lower(t))
        n = min(window, len(v))
        grams = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
        for k in range(len(w) - n + 1):
            if tuple(w[k:k + n]) in grams:
                hit |= set(range(k, k + n))
                found.add(i)
    return len(w), hit, found


@pytest.mark.parametrize("block_words", [200_000, 15])
def test_hits_like_brute_force(spark, block_words):
    rng = random.Random(1)
    words = ["a", "B", "ç", "d1", "ee"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", ", ", "\n"]) for _ in range(n))
    items = [(k, text(rng.choice([0, 1, 3, 5, 9]))) for k in range(6)] + [(7, None), (8, "Zz zz ZZ"), (9, "zz zz zz")]
    docs = [(k, text(rng.randint(0, 40)) + rng.choice(["", "zz zz zz"])) for k in range(40)] + [(50, None), (51, "")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: r for r in op5.find_hits(docs_of(spark, docs), frame, window=4, block_words=block_words).collect()}
    assert len(got) == len(docs)
    for k, t in docs:
        n, hit, found = brute_hits(t, items, 4)
        assert (got[k].n_words, got[k].n_hit, set(got[k]["items"])) == (n, len(hit), found), (k, t)
        assert {i for r in got[k].runs for i in range(r["first"], r["last"])} == hit
        for r in got[k].runs:
            piece = t.encode()[r.start:r.end].decode()
            assert WORD.findall(lower(piece)) == WORD.findall(lower(t))[r["first"]:r["last"]]
    clean = op5.decontaminate(docs_of(spark, docs), frame, window=4, coverage=0.6, block_words=block_words).collect()
    kept = {r.doc_id: r.text for r in clean}
    for k, t in docs:
        n, hit, _ = brute_hits(t, items, 4)
        if not hit:
            assert kept[k] == t
        elif block_words > 15:
            assert (k in kept) == (len(hit) <= 0.6 * n)
        if k in kept:
            assert not brute_hits(kept[k], items, 4)[1] or block_words == 15


def test_many_blocks_decide_like_one(spark):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("abcdef") for _ in range(n))
    items = [(k, text(rng.choice([3, 5, 9, 40]))) for k in range(8)] + [(20, "p q r s"), (21, "t u v w")]
    docs = [(k % 7 if k % 5 else None, text(rng.randint(0, 40)) + rng.choice(["", " x p q r s y t u v w z"])) for k in range(60)]
    # 40 % by each of two blocks; a cut of one item's span that joins the words of another
    docs += [(100, "p q r s o t u v w o"), (101, "o o o o o o o t u p q r s v w"), (100, None), (None, None), (None, "p q r s")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame([(i, t, len(t or ""), "x") for i, t in docs], "doc_id long, text string, n_chars int, row string")
    order = lambda rows: sorted(map(str, rows))
    one, many = (order(op5.find_hits(rows, frame, window=4, block_words=b).collect()) for b in (200_000, 15))
    assert one == many and len(many) == len(docs)
    one, many = (op5.decontaminate(rows, frame, window=4, coverage=0.6, block_words=b) for b in (200_000, 15))
    assert many.schema == one.schema and order(many.collect()) == order(one.collect())
    kept = [(r.doc_id, r.text) for r in many.collect()]
    assert 100 not in {i for i, t in kept if t} and sum(t is None for _, t in kept) == 2
    assert all(not brute_hits(t, items, 4)[1] for _, t in kept) and all(r.n_chars == len(r.text or "") for r in many.collect())


def test_hits_of_odd_and_no_rows(spark):
    items = spark.createDataFrame([(1, "one two three"), (None, "déjà vu")], "item_id long, text string")
    got = op5.find_hits(docs_of(spark, ODD), items).collect()
    assert len(got) == len(ODD)
    by = {r.id: r for r in got}
    assert by[7].n_hit == 9000 and by[7]["items"] == [1] and by[5].n_hit == 2 and by[5]["items"] == []
    assert op5.find_hits(docs_of(spark, []), items).count() == 0
    assert op5.find_hits(docs_of(spark, ODD), items.limit(0)).where("n_hit > 0").count() == 0


def shingle_set(text, k):
    w = lower(text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, min(1, len(w))))}


def brute_classes(docs, k, percent):
    sets = [shingle_set(t, k) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    low = {}
    for a, (i, _) in enumerate(docs):
        low[find(a)] = min(low.get(find(a), i), i)
    return {i: (len(sets[a]), low[find(a)]) for a, (i, _) in enumerate(docs)}


def family_docs(seed, n):
    rng = random.Random(seed)
    out = []
    for _ in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randint(0, 30)) for _ in range(rng.choice([5, 8, 30, 60]))]
        for _ in range(n):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(["x", "y", "z"])
            if rng.random() < 0.3:
                w = w[:rng.randint(1, len(w))]
            out.append((len(out), rng.choice([" ", "\n", "\t"]).join(w).upper() if rng.random() < 0.2 else " ".join(w)))
    return out


@pytest.mark.parametrize("block,leaf,reach", [(4096, 64, 16), (8, 2, 1)])
def test_classes_like_brute_force(spark, monkeypatch, block, leaf, reach):
    monkeypatch.setattr(op8, "LEAF", leaf)
    monkeypatch.setattr(op8, "REACH", reach)
    docs = [*family_docs(block, 14), (900, None), (901, ""), (902, " \n"), (903, "x y"), (904, "X  y")]
    got = {r.id: (r.n, r.klass) for r in op8.jaccard_classes(docs_of(spark, docs), block=block).collect()}
    assert got == brute_classes(docs, 4, 85)


@pytest.mark.parametrize("earlier", [0, 1, 32])
def test_pairs_are_named_once_whatever_they_share(spark, monkeypatch, earlier):
    """Like but unlinked documents share hundreds of buckets: a pair comes out of
    one of them, not of each."""
    rng = random.Random(4)
    base, docs = [f"w{rng.randint(0, 10**6)}" for _ in range(2000)], []
    for i in range(8):
        w = list(base)
        for j in rng.sample(range(len(w)), 22 if i < 2 else 30):
            w[j] = f"x{i} {j}"
        docs.append((i, " ".join(w)))
    docs += [(i + 20, t) for i, t in family_docs(9, 6)]
    named, stored = [], op8.common.stored

    def counted(df, name, **options):
        out = stored(df, name, **options)
        if name == "named":
            named.extend((r.a, r.b) for r in out.where("a is not null").collect())
        return out

    monkeypatch.setattr(op8.common, "stored", counted)
    monkeypatch.setattr(op8, "EARLIER", earlier)
    got = {r.id: (r.n, r.klass) for r in op8.jaccard_classes(docs_of(spark, docs)).collect()}
    assert got == brute_classes(docs, 4, 85)
    assert len({x for p in named for x in p}) >= 6
    if earlier == 32:
        assert len(named) == len(set(named))


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_first_shared_shingle_is_in_the_own_prefix_of_the_smaller(percent):
    for n in range(1, 60):
        for m in range(n, 60):
            least = int(op8.least_shared(np.int64(n), np.int64(m), percent))
            assert least == min(c for c in range(n + m + 1) if 100 * c >= percent * (n + m - c))
            if least <= n:  # such a pair can link: with n - least shingles before the first shared one
                assert n - least < op8.own_length(np.int64(n), percent) and m - least < op8.prefix_length(np.int64(m), percent)


def test_one_of_each_class_stays(spark):
    docs = family_docs(3, 5) + [(800, None)]
    want = {k for _, k in brute_classes(docs, 5, 80).values()}
    kept = op8.one_of_each(docs_of(spark, docs), k=5, percent=80)
    assert kept.columns == docs_of(spark, []).columns and {r.doc_id for r in kept.collect()} == want
    assert op8.jaccard_classes(docs_of(spark, [])).count() == 0


def test_tree_bounds_lose_nothing():
    rng = np.random.RandomState(0)
    points = rng.poisson(3, (300, op8.GROUPS))
    points[100:200] = np.maximum(points[:100] + rng.randint(-1, 2, (100, op8.GROUPS)), 0)
    tree = op8.RTree(points, 8)
    for q in points[:50]:
        at, _ = tree.search(q, 85)
        bound = np.minimum(points, q).sum(1)
        assert sorted(at) == np.flatnonzero(185 * bound >= 85 * (q.sum() + points.sum(1))).tolist()


@pytest.mark.parametrize("name", ["op5_decontamination", "op8_jaccard_join"])
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name]).df()
    got = QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert got.sort_values("doc_id").values.tolist() == want.sort_values("doc_id").values.tolist()
