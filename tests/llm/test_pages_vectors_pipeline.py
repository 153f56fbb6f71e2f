import random
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helpers import SF
from kipmart.llm import common
from kipmart.llm import op5_decontamination as op5
from kipmart.llm import op7_html_extraction as op7
from kipmart.llm import op8_jaccard_join as op8
from kipmart.llm import op10_neighbour_graph as op10

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body><header>Site</header>
<nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>One <b>two</b>
   three.<p>Four<br>five<script>if (a<b) x()</script><form><input>Sign up</form>
<ul><li>six<li>seven</ul><div id="comments"><p>First!</p></div><table><tr><td>8<td>9</table></article>
<aside>Related</aside><footer>&copy; us</footer></body></html>"""


def test_article_text():
    assert op7.main_text(op7.parse(PAGE)) == "Title & more\nOne two three.\nFour\nfive\nsix\nseven\n8\n9"


@pytest.mark.parametrize("html,text", [
    ("", ""), ("plain text", "plain text"), ("<p>a</p>tail", "a\ntail"), ("<p>1 < 2 &lt; 3", "1 < 2 < 3"),
    ("<p>x<!-- open", "x"), ("<p>x<script>never closed", "x"), ("<div><p>a<div>b</div>c</div>", "a\nb\nc"),
    ("<b>bold <p>para</b> rest", "bold\npara rest"), ("</p></div>x", "x"), ("<p title='a>b'>y", "y"),
    ("&#233;&nbsp;&eacute; z", "é é z"), ("<a href=x>l</a><a>m</a>", "lm"), ("<div " * 50, ""),
    ("<div>" * 3000 + "deep", "deep")])
def test_odd_markup(html, text):
    assert op7.main_text(op7.parse(html)) == text


@pytest.mark.parametrize("html,text", [
    ("<p style='overflow:hidden'>a</p>", "a"), ("<p><a href='/hidden-valley'>b</a> c</p>", "b c"),
    ("<p title=\"the hidden truth\">d</p>", "d"), ("<a href=\"/p?id=search\">e</a>", "e"),
    ("<div data-id='menu-3' data-class=ad>f</div>", "f"), ("<p href=/x?hidden=1 lang=en>g</p>", "g"),
    ("<article><h2 id='related-work'>h</h2><div class=discussion>i</div><section id='search-results'>j</section>"
     "<p>k <span class='ad'>l</span></p></article>", "h\ni\nj\nk l"),
    ("<article><p>m</p><div class='related-posts'>n</div><div id=Comments-2>o</div><div class='x share-buttons'>p</div>"
     "<p hidden>q</p><p aria-hidden=TRUE>r</p><div role=search>s</div></article>", "m"),
    ("<article class='post category-social'>t</article><article class='comment'>u</article><main hidden>v</main>", "t"),
    ("<div class=a class=menu>w</div><div title='>' CLASS=\"side menu\">x</div>", "w")])
def test_attributes_are_read_by_name(html, text):
    assert op7.main_text(op7.parse(html)) == text


def test_template_goes_where_no_article_is_marked(spark):
    rows = [(i, f"http://h.org/{i}", f"<body><div><p>Shop &amp; co</p></div><div><p>Text {i}</p><p>Same</p></div></body>")
            for i in range(8)]
    rows += [(100, "http://other.org/", "<body><p>Same</p><p>Shop &amp; co</p></body>"), (101, None, None),
             (102, "x", ""), (102, "x", "")]
    rows += [(200 + i, "http://h.org/a", "<body><article><p>Same</p><p>Own</p></article></body>") for i in range(6)]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, html string, host string")
    got = {r.id: r.text for r in op7.extract(pages).collect()}
    assert all(got[i] == f"Text {i}" for i in range(8))
    assert got[100] == "Same\nShop & co" and got[101] == "" == got[102] and got[200] == "Same\nOwn"
    assert op7.extract(pages).count() == len(rows) and op7.extract(pages.limit(0)).count() == 0


def test_template_goes_inside_articles_and_leaves_text_beside(spark):
    note = "<div class='b'><p>Read our other pages too</p></div>"
    rows = []
    for i in range(12):
        quote = "<p>Quoted by all</p>"
        own = [f"<p>Own text {i} {k}, long enough to be the larger part</p>" for k in range(4)]
        own.insert(i % 5, quote)
        rows.append((i, f"http://a.org/{i}", f"<div>Motto</div><article><h2>Intro</h2>{''.join(own)}{note}</article>"))
        rows.append((100 + i, f"http://b.org/{i}", f"<div>Motto</div><article>Teaser {i}</article><div><p>Body {i}</p>"
                                                   "</div><div><a href='/'>Next one</a></div>"))
        rows.append((200 + i, f"http://c.org/{i}", f"<article><p>Copied for the most part</p><p>No {i}</p></article>"))
    rows += [(300 + i, f"http://d.org/{i}", "<article><p>Copy</p><p>All</p></article>") for i in range(12)]
    rows.append((400, "http://e.org/", "<article>Teaser</article><p>The body of the page stands beside it</p>"))
    got = {r.id: r.text for r in op7.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        want = [f"Own text {i} {k}, long enough to be the larger part" for k in range(4)]
        want.insert(i % 5, "Quoted by all")
        assert got[i].split("\n") == ["Intro", *want]
        assert got[100 + i] == f"Teaser {i}\nBody {i}"
        assert got[200 + i] == f"Copied for the most part\nNo {i}" and got[300 + i] == "Copy\nAll"
    assert got[400] == "Teaser\nThe body of the page stands beside it"


TEXT = "A long enough text of the page itself that says what the page is about."


@pytest.mark.parametrize("html,text", [
    # names with a word of a side part hold the article, or most of the text
    (f'<div class="layout has-sidebar"><article><p>{TEXT}</p></article><div class="sidebar">links</div></div>', TEXT),
    (f'<div id="content" class="no-sidebar"><p>{TEXT}</p></div><footer>foot</footer>', TEXT),
    (f'<div class="post related-science"><p>{TEXT}</p></div>', TEXT),
    (f'<div class="search-results"><p>{TEXT}</p><div class="ads">buy</div></div>', TEXT),
    (f'<form action="/x"><div><p>{TEXT}</p></div><input value="v"><button>Go</button></form>', TEXT),
    (f'<div id="sidebar-wrapper"><article><p>{TEXT}</p></article></div><nav>menu</nav>', TEXT),
    # side parts stay out however much they hold
    (f'<article><p>{TEXT}</p></article><div class="comments"><p>{TEXT * 3}</p></div>', TEXT),
    (f'<article><p>{TEXT}</p><div class="comment-list"><p>{TEXT * 3}</p></div></article>', TEXT),
    (f'<p>{TEXT}</p><aside><article><p>{TEXT * 3}</p></article></aside>', TEXT),
    (f'<p>{TEXT}</p><div hidden><p>{TEXT * 3}</p></div>', TEXT),
    (f'<p>{TEXT}</p><form class="search"><label>Find</label></form>', TEXT)])
def test_names_of_wrappers(html, text):
    assert op7.main_text(op7.parse(html)) == text


def site(rng, hosts=4, pages=60):
    """Pages with menus, teasers and footers under neutral names, quoted passages and few-page hosts."""
    word = lambda n: " ".join(rng.choice(["on", "the", "red", "fox", "sea", "old", "ink"]) + str(rng.randint(0, 99)) for _ in range(n))
    quote, rows = word(20), []
    for h in range(hosts):
        menu, foot = word(5), word(8)
        for k in range(pages if h else 3):
            body = "".join(f"<p>{word(15)}</p>" for _ in range(rng.randint(1, 4))) + (f"<p>{quote}</p>" if k % 4 == 0 else "")
            inner = f"<article><h1>{word(4)}</h1>{body}</article>" if h % 2 else f"<div class=x>{body}</div>"
            rows.append((len(rows), f"http://h{h}.org/{k}", f"<div class=top><ul><li>{menu}</li></ul></div>{inner}"
                         f"<div class=low>{foot}</div><nav>{menu}</nav>"))
    return rows + [(9000, None, "<p>x</p>"), (9001, "", None), (9002, "http://h1.org/z", rows[-1][2])]


def test_templates_like_a_plain_counter(spark):
    rows = site(random.Random(3))
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    seen, pages = {}, {}
    for _, url, html in rows:
        page, host = op7.layout(op7.parse(html or "")), op7.host_of(url)
        own = tuple(op7.main_text(op7.parse(html or "")).split("\n"))
        with_article = any(n.tag in op7.MAIN for n, _, _ in page.spans)
        for inside in {False, with_article}:
            pages.setdefault((host, inside), set()).add(own)
        for found, inside, _, _ in op7.candidates(page):
            for x in found:
                seen.setdefault((host, inside, x), set()).add(own)
    want = {}
    for (host, inside, x), texts in seen.items():
        n = len(pages[host, inside])
        if len(texts) >= 5 and len(texts) >= (0.5 * n if inside else min(0.05 * n, 50)):
            want.setdefault(host, set()).add(x)
    got = {r.host: set(r.hashes) for r in op7.templates(op7.subtree_hashes(frame)).collect()}
    assert got == want and set(got) == {"h1.org", "h2.org", "h3.org"}
    # the template decides: what has no telling name goes on hosts with enough pages
    text = {r.id: r.text for r in op7.extract(frame).collect()}
    named = {i: op7.main_text(op7.parse(h or "")) for i, _, h in rows}
    changed = [i for i, u, _ in rows if text[i] != named[i]]
    assert changed and all(op7.host_of(u) == "h2.org" for i, u, _ in rows if i in changed and i != 9002)
    assert all("<" not in t for t in text.values())
    joined = {r.id: (r.url, r.text) for r in op7.extract(frame, most_shared=0).collect()}
    assert joined == {i: (u, text[i]) for i, u, _ in rows}


def test_a_template_does_not_grow_with_the_host(spark):
    hashes = [("h", False, None, k) for k in range(3000)] + [("h", False, 7, k) for k in range(60)] + [("h", False, 8, k) for k in range(40)]
    found = op7.templates(spark.createDataFrame(hashes, "host string, inside boolean, hash long, text long")).collect()
    assert [(r.host, r.hashes) for r in found] == [("h", [7])]


def test_pages_are_the_documents_they_show(spark):
    pages = {r.id: r.text for r in op7.extract(common.read(spark, SF, "pages")).collect()}
    texts = {" ".join(r.text.split()) for r in common.read(spark, SF, "documents").collect()}
    assert all(" ".join(t.split("\n", 1)[1].split()) in texts for t in pages.values())


def brute_nearest(rows, k, queries):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for q in queries:
        sim = x @ x[ids == q][0]
        out[q] = [i for _, i in sorted((-round(s, 12), i) for s, i in zip(sim, ids) if i != q)][:k]
    return out


def test_recall_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in common.read(spark, "/root/testdata/sf0.1", "embeddings").collect()]
    got = {}
    for r in op10.op10_neighbour_graph(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    want = brute_nearest(rows, 5, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want) and all([a for a, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 3.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]),
            (6, [1.0, None]), (7, [float("inf"), 1.0]), (8, [1.0]), (50, [5.0, 0.0]), (100, [0.0, 0.0]), (None, [1.0, 1.0])]
    frame = spark.createDataFrame([(*r, 1, 2.0) for r in rows], "vec_id long, embedding array<double>, id int, sim double")
    got = op10.nearest(frame, F.col("query_id") % 50 == 0, k=2).collect()
    assert sorted((r.query_id, r["rank"], r.id) for r in got) == [(0, 1, 1), (0, 2, 50), (50, 1, 0), (50, 2, 1)]
    assert all(r.score == 1.0 for r in got)
    assert op10.nearest(frame.limit(0), F.lit(True)).count() == 0
    assert op10.nearest(frame.where("vec_id = 0"), F.lit(True)).count() == 0


def test_copies_and_repeated_ids(spark):
    """A third of the rows share a vector (their ids the largest and smallest mixed), ids repeat."""
    rng = np.random.RandomState(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)] + [(i, [1.0] * 8) for i in range(1000, 400, -3)]
    rows += [(7, [1.0] * 8), (7, [1.0] * 8), (100, rng.normal(size=8).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in op10.nearest(frame, F.col("query_id") % 50 == 0, block=200, leaf=32).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    for q in sorted({i for i, _ in rows if i % 50 == 0}):
        want = []
        for at in [j for j, (i, _) in enumerate(rows) if i == q]:
            sim = x @ x[at]
            best = sorted((-round(s, 9), i) for j, (s, (i, _)) in enumerate(zip(sim, rows)) if j != at)[:5]
            want += [(n, i, -s) for n, (s, i) in enumerate(best, 1)]
        assert sorted((a, b, round(c, 9)) for a, b, c in got.pop(q)) == sorted(want)
    assert not got


def test_exhaustive_search_is_brute_force_in_blocks(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.RandomState(6).normal(size=(300, 6)))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points = op10._prepared(frame.toDF("id", "v"))
    found = op10.all_nodes(points, points.withColumnRenamed("id", "query_id").where("query_id % 7 = 0"), 4, part_rows=40, query_rows=9)
    near = {}
    for r in found.collect():
        near.setdefault(r.query_id, []).append((-r.sim, r.id))
    want = brute_nearest(rows, 4, [i for i, _ in rows if i % 7 == 0])
    assert {q: [i for _, i in sorted(v)[:4]] for q, v in near.items()} == want
    got = op10.nearest(frame, F.col("query_id") % 7 == 0, k=4, exhaustive=True).collect()
    assert {q: [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == q] for q in want} == want


def test_pool_grows_until_the_sample_is_found(spark):
    """Unlike vectors, hardly linked: a small pool misses many, the sample makes it grow."""
    x = np.random.RandomState(7).normal(size=(3000, 48))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    want = brute_nearest(rows, 5, [i for i, _ in rows if i % 50 == 0])

    def recall(**settings):
        got = op10.nearest(frame, F.col("query_id") % 50 == 0, degree=12, pool=16, block=500, leaf=64, **settings).collect()
        return np.mean([len({r.id for r in got if r.query_id == q} & set(w)) / 5 for q, w in want.items()])

    assert recall(recall=0.0) < 0.9 <= recall(recall=0.95)


def test_vectors_are_shuffled_with_their_node_or_query_only(spark):
    """Not with each of their neighbours in each round of the descent and of the search."""
    x = np.random.RandomState(8).normal(size=(3000, 64))
    path = common.temp_path(spark, "test")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(path)
    sc = spark.sparkContext
    store = sc._jsc.sc().statusStore()

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): s.shuffleWriteBytes() for s in (stages.apply(i) for i in range(stages.size()))}

    before = shuffled()
    assert op10.nearest(spark.read.parquet(path), F.col("query_id") % 50 == 0, block=500, leaf=64).count() == 300
    assert sum(n for s, n in shuffled().items() if s not in before) < 10 * x.size * 4


def test_recall_over_many_cells_of_clusters(spark):
    rng = np.random.RandomState(9)
    x = rng.normal(size=(60, 24))[rng.randint(0, 60, 4000)] + 0.3 * rng.normal(size=(4000, 24))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in op10.nearest(frame, F.col("query_id") % 50 == 0, pool=64, block=200, leaf=50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    want = brute_nearest(rows, 5, [i for i, _ in rows if i % 50 == 0])
    assert set(got) == set(want) and all(set(g) == {1, 2, 3, 4, 5} for g in got.values())
    assert np.mean([len(set(got[q].values()) & set(w)) / 5 for q, w in want.items()]) >= 0.9


def test_parts_stay_small_when_no_centre_divides_them(spark):
    """Nodes of one direction are nearest to the same centre."""
    rows = [(i, [float(i + 1)] * 4) for i in range(1500)] + [(i, [1.0, 0.0, float(i), 0.0]) for i in range(1500, 1600)]
    frame = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    cells = op10.cells_of(frame, len(rows), 100)
    parts = op10.build(frame, cells, 8, 32).select("part", "n", F.length("ids").alias("bytes")).collect()
    assert sum(r.n for r in parts) == len(rows) and all(r.bytes == 8 * r.n for r in parts)
    assert len({r.part for r in parts}) == len(parts) and max(r.n for r in parts) <= 300
    got = op10.nearest(frame.toDF("vec_id", "embedding"), F.col("query_id") == 1500, k=3, block=100, leaf=32).collect()
    assert sorted((r["rank"], r.id) for r in got) == [(1, 1501), (2, 1502), (3, 1503)]


def test_best_edges_of_each_node():
    rng = np.random.RandomState(10)
    src, dst = rng.randint(0, 40, 3000), rng.randint(0, 40, 3000)
    sim = np.round(rng.rand(40, 40), 1).astype("f4")[src, dst] * 2 - 1
    fresh = rng.rand(3000) < 0.5
    got = op10._best(40, 7, src, dst, sim, fresh)
    for i in range(40):
        edges = {}
        for d, s, f in zip(dst[src == i], sim[src == i], fresh[src == i]):
            edges[d] = (-s, d, f and edges.get(d, (0, 0, True))[2])
        want = sorted(edges.values())[:7]
        assert [(d, f) for _, d, f in want] == list(zip(got.to[i], got.fresh[i]))
        assert np.allclose([-s for s, _, _ in want], got.sim[i], atol=1e-6)


def test_pipeline(spark):
    docs = common.read(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_duplicates", "decontamination", "packing"]
    before, ids = docs, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = common.stored(stage(spark, before, SF), name)
        assert after.columns == docs.columns
        left = {r.doc_id for r in after.select("doc_id").collect()}
        assert left <= ids and (left < ids or name not in ("quality", "near_duplicates"))
        ids, before = left, after
    assert op8.jaccard_classes(before, 5, 80).where("id <> klass").count() <= 2  # cutting may make two alike
    assert op5.find_hits(before, common.read(spark, SF, "benchmark")).where("n_hit > 0").count() == 0
    packed = corpus_pipeline.run(spark, SF).toPandas()
    assert set(packed.doc_id) == ids and packed.groupby("sequence_id").length.sum().max() <= 2048
