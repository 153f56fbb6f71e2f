"""Operators 11, 12 and 13 against plain Python and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from helpers import ODD, SF, docs_of
from pyspark.sql import functions as F

from kipmart.llm import op11_importance_resampling as op11
from kipmart.llm import op12_source_divergence as op12
from kipmart.llm import op13_secret_scan as op13
from kipmart.llm.queries import ORACLE_SQL, QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
NEW = ["op11_importance_resampling", "op12_source_divergence", "op13_secret_scan"]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def null_last(v):
    return (v is None, v or 0)


@pytest.mark.parametrize("name", NEW)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    cur = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in cur.description]
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(map(str, r))
    want = sorted(cur.fetchall(), key=key)
    assert sorted(map(tuple, got.select(names).collect()), key=key) == want and want


def test_secret_scan_is_native(spark):
    plan = QUERIES["op13_secret_scan"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Python|Pandas|Arrow|Exchange", plan)


@pytest.mark.parametrize("name", [*NEW, "op1_token_output", "op5_decontamination", "op6_token_counts"])
def test_plans_have_no_cross_join_or_row_udf(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan)
    # windows: by group of sources, or over one row for each part
    for line in plan.splitlines():
        if "windowspecdefinition" in line:
            assert re.search(r"windowspecdefinition\((lang#\d+, source#|part#|__pid#)", line), line


# ---- operator 11

def test_range_crc32():
    rng = random.Random(3)
    data = bytes(rng.randrange(256) for _ in range(3000))
    ranges = [(a, a + rng.choice([0, 1, 2, 7, 47, 48, 49, 400])) for a in (rng.randrange(2500) for _ in range(300))]
    a, z = np.array(ranges).T
    got = op11.range_crc32(np.frombuffer(data, np.uint8), a, z)
    assert got.tolist() == [zlib.crc32(data[i:j]) for i, j in ranges]
    assert not len(op11.range_crc32(np.zeros(0, np.uint8), a[:0], z[:0]))


def draw_by_hand(docs, target, runs, percent, least, buckets, seed=2024):
    def feats(t):
        w = WORD.findall(lower(t))
        return [zlib.crc32(" ".join(w[i:i + r]).encode()) % buckets for r in range(1, runs + 1)
                for i in range(len(w) - r + 1)], len(w)
    s, t = Counter(), Counter()
    for _, x in docs:
        s.update(feats(x)[0])
    for _, x in target:
        t.update(feats(x)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets))))
    rows = []
    for i, x in docs:
        f, n = feats(x)
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], null_last(r[0])))
    k = percent * len(able) // 100
    # equal keys may be drawn in any order: compare (id, score, rank)
    return sorted(rows, key=str), [(r[0], r[3], n + 1) for n, r in enumerate(able[:k])]


@pytest.mark.parametrize("runs,percent,finish", [(1, 30, 1), (2, 50, 3), (3, 100, 1), (1, 3, 4096)])
def test_draw_like_by_hand(spark, runs, percent, finish):
    rng = random.Random(runs)
    text = lambda n: "".join(rng.choice(["aa", "B", "ç", "d1", "Ee", "日本"]) + rng.choice([" ", ", ", "_", "\n"]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 12))) for k in range(150)] + ODD + [(20, "same text of five words")] * 9 \
        + [(None, "another null id here now"), (10 ** 12, "x " * 9000)]
    target = [(k, text(9)) for k in range(5)] + [(9, None)]
    rows, drawn = draw_by_hand(docs, target, runs, percent, 4, 97)
    scored = op11.score(docs_of(spark, docs).repartition(5), spark.createDataFrame(target, "item_id long, text string"), runs, 97)
    got = op11.ranked(scored, percent, 4, finish).collect()
    assert sorted(((r.doc_id, r.n_features, r.weight, r.score, r.n_words >= 4) for r in got), key=str) == rows
    mine = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(r.doc_id, r.score, r["rank"]) for r in mine] == drawn


@pytest.mark.parametrize("n,finish", [(1, 1), (2, 1), (7, 1), (300, 1), (300, 50)])
def test_cutoff_is_exact(spark, n, finish):
    rng = random.Random(n)
    rows = [(rng.randint(-3, 3), rng.choice([None, 1, 2, 10 ** 15]), k) for k in range(n)]
    keys = spark.createDataFrame(rows, "score long, doc_id long, row long").repartition(4)
    order = sorted((-s, int(i is None), i or 0, r) for s, i, r in rows)
    for k in {1, n // 3 + 1, n}:
        assert op11.cutoff(keys, k, finish) == order[k - 1]


def test_draw_of_nothing(spark):
    target = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    none = docs_of(spark, [])
    assert op11.ranked(op11.score(none, target)).collect() == []
    few = docs_of(spark, [(1, "a b c"), (2, None)])
    assert [r["rank"] for r in op11.ranked(op11.score(few, target.limit(0))).collect()] == [None, None]
    docs = docs_of(spark, [(k, f"a b c d {k}") for k in range(20)] + [(3, "other"), (None, None)])
    out = op11.resample(docs, target, percent=50, least_words=5)
    assert out.columns == docs.columns and out.select("doc_id").distinct().count() == 10


# ---- operator 12

def audit_by_hand(docs, least, top):
    df, cells, groups = Counter(), Counter(), set()
    for lang, source, text in docs:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = TERM.findall(lower(text))
        df.update((lang, t) for t in set(w))
        cells.update((lang, source, t) for t in w)
    kept = defaultdict(list)
    for (lang, t), n in df.items():
        if n >= least:
            kept[lang].append(t)
    p, q = {}, {}
    for lang in {g[0] for g in groups}:
        own = [s for x, s in groups if x == lang]
        v = len(kept[lang])
        tot = {s: sum(cells[lang, s, t] for t in kept[lang]) for s in own}
        for t in kept[lang]:
            q[lang, t] = 1 + 10 ** 9 * (sum(cells[lang, s, t] for s in own) + 5) // (sum(tot.values()) + 5 * v)
            for s in own:
                p[lang, s, t] = 1 + 10 ** 9 * (cells[lang, s, t] + 5) // (tot[s] + 5 * v)
    out = []
    for lang, s in groups:
        pairs = [(b, sum(abs(p[lang, s, t] - p[lang, b, t]) for t in kept[lang])) for x, b in groups if x == lang and b != s]
        terms = [(t, p[lang, s, t] - q[lang, t]) for t in kept[lang] if cells[lang, s, t] and p[lang, s, t] > q[lang, t]]
        for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
            rows.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(rows[:most])]
    return sorted(out)


def random_docs(rng, n):
    vocabulary = ["the", "Of", "é", "naïve", "日本", "zz", "q"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None]),
             " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    rows += [("en", "quiet", None), ("en", "quiet", "12 34"), ("xx", "only", "one one"), ("yy", "s1", ""), ("yy", "s2", "..."),
             ("en", "a", "the " * 20_000)] + [("de", "hot", "the same copy of zz")] * 60
    return rows


@pytest.mark.parametrize("held,fan_in,top", [(1 << 20, 1024, 50), (40, 2, 3), (1, 1, 1)])
def test_audit_like_by_hand(spark, held, fan_in, top):
    rows = random_docs(random.Random(8), 300 if held > 1 else 60)
    docs = spark.createDataFrame([(*r, "x", "y", 3) for r in rows],
                                 "lang string, source string, text string, term string, df string, part long").repartition(7)
    got = op12.audit(docs, 5, top, held=held, fan_in=fan_in)
    assert sorted(map(tuple, got.collect())) == audit_by_hand(rows, 5, top)


def test_audit_of_many_sources_and_of_nothing(spark):
    rows = [("en", f"s{k % 150}", f"common t{chr(97 + k % 7)} " + "rare " * (k % 3)) for k in range(450)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").repartition(3)
    want = audit_by_hand(rows, 30, 50)
    for held in (1 << 20, 2000):
        assert sorted(map(tuple, op12.audit(docs, held=held).collect())) == want
    assert op12.audit(docs.limit(0)).collect() == []


def test_share_is_exact():
    rng = random.Random(4)
    n = [rng.randrange(1, 9 * 10 ** 15) for _ in range(300)] + [1, 7, 9 * 10 ** 15]
    c = [rng.randrange(0, x + 1) for x in n[:-3]] + [1, 0, 9 * 10 ** 15]
    assert op12.share(np.array(c), np.array(n)).tolist() == [1 + 10 ** 9 * a // b for a, b in zip(c, n)]


# ---- operator 13

def entropy(s):
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def spans_by_hand(text):
    text, out = text or "", []
    names = "password|passwd|secret|token|api_?key"
    for m in re.finditer(rf"""((?ai:{names}))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 32]
    for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text):
        s = m.group()
        if any(re.search(r, s) for r in op13.ALLOWED):
            continue
        kind, limit = (3, 3.0) if re.fullmatch("[0-9a-f]+|[0-9A-F]+", s) else (4, 3.8)
        s = s.lower() if kind == 3 else s
        inside = set()
        for k in range(len(s) - 19):
            if entropy(s[k:k + 20]) >= limit - 1e-7:
                inside |= set(range(k, k + 20))
        # windows that touch are one span as well, so runs of characters are the spans
        runs, last = [], None
        for x in sorted(inside):
            if last is None or x > last + 1:
                runs.append([x, x])
            runs[-1][1] = last = x
        out += [(m.start() + a, kind, m.start() + z + 1) for a, z in runs]
    return sorted(out)


def test_secrets_like_by_hand(spark):
    rng = random.Random(6)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
    some = lambda of, n: "".join(rng.choice(of) for _ in range(n))
    parts = [lambda: rng.choice(["token", "Password", "API_KEY", "apikey", "sEcret", "passwd"]) + rng.choice([":", "=", " = ", '"="', "': '"])
             + some(sign + ".", rng.choice([3, 7, 8, 30])),
             lambda: "AKIA" + some("ABC0123Z", rng.choice([3, 11, 12, 16])), lambda: some("0123456789abcdef", rng.choice([31, 32, 300])),
             lambda: some(sign, rng.choice([19, 20, 21, 60, 400])), lambda: "ab" * 12 + some(sign, 25) + "xy" * 20,
             lambda: some("0123456789ABCDEF", 40), lambda: "secret:token=abc:password=abcdefghij", lambda: "AKIAAKIA-ſecret: toKen: abcdefghij",
             lambda: "日本語é\U0001F600", lambda: "123e4567-e89b-12d3-a456-426614174000", lambda: "EXAMPLE" + some(sign, 30), lambda: "0" * 50]
    rows = [(k, some([" ", "\n", ",", ""], 1).join(rng.choice(parts)() for _ in range(rng.randint(0, 10)))) for k in range(150)]
    rows += [*ODD, (200, " ".join(rng.choice(parts)() for _ in range(1500))), (200, "token=abcdefgh"), (None, "k" * 90_000)]
    got = op13.scan(docs_of(spark, rows).withColumn("start", F.lit("clash"))).collect()
    key = lambda r: (str(r[0]), r[1] or "", r[2])
    assert sorted(((r.doc_id, r.text, [tuple(s) for s in r.secrets]) for r in got), key=key) == \
        sorted(((i, t, spans_by_hand(t)) for i, t in rows), key=key)
    assert op13.scan(docs_of(spark, [])).collect() == []


def test_secret_digest(spark, tmp_path):
    text = "é token = 'abcdefgh1' AKIAABCDEFGHIJKL"
    path = str(tmp_path)
    spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op13_secret_scan"](spark, path).collect()}
    want = "assign:2:20,access:22:38"
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex) == (1, 1, 0) and got[1].spans == want
    assert got[1].base_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_allow_list_and_limits_are_parameters(spark):
    docs = docs_of(spark, [(1, "the-path/of-many_words/and-some-more"), (2, "q8ZkT1vXw3RbN7pLhY2mC5sDfG9jKe0")])
    some = {r.doc_id: len(r.secrets) for r in op13.scan(docs, allowed=()).collect()}
    assert some[2] == 1
    none = op13.scan(docs, limits={"hex": 4.0, "base64": 4.4}).collect()
    assert all(not r.secrets for r in none)
