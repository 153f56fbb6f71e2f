"""HTML extraction (operator 7): main text by removal of site templates.

1. *Trees.* Each page is read into a tree of elements, tolerant of missing end
   tags (:data:`CLOSES`, :data:`VOID`). Only what a browser shows no text of
   (scripts, styles, controls) is left out at once.
2. *Templates.* Every block element, menus and footers too, is hashed by its tag
   and its text, inside an ``article`` (or ``main``) by its place too; Spark counts
   on how many pages of a host, of different main texts, each hash stands. Subtrees
   that recur on ``least_pages`` and a share ``least_share`` of them, or on
   ``many_pages`` however large the host (inside articles on ``least_share_inside``),
   are the host's template and are deleted on every page. Inside an article a
   passage that is quoted here and there stays, as its place or its share tells it
   from the template; so do recurring headings, cells and terms, and articles that
   recur for the most part (series, near copies).
3. *Names.* Of what the template left, parts that differ from page to page
   (adverts, comments), and all side parts of hosts with few pages, are told by
   their names. Menus, asides, footers and hidden elements go. A class or id that
   names a side part as a whole goes unless it holds an article and most of the
   page's text; one that only has such a word in it, and a form, unless it holds an
   article or most of the text. Inside an article a class or id must name the
   part as a whole, and headings and inline elements stay whatever theirs are.
4. *Text.* Character references are decoded, white space inside a block becomes
   one space, blocks are joined in page order by a line feed. Beside articles,
   blocks that are mostly links are left out, and where the host has no known
   template, all that is shorter than the articles is.

The hashes of a page are few (block elements) and carry no text, so counting
shuffles little; the recurring hashes come back to the pages by a join on host
and hash, then on the page row.
A host of a third of all pages has no group of its own: counts are summed by
(host, hash), and joins are split by Spark where they are skewed.

Defined cases: null or empty html gives an empty text; a null url belongs to the
host ''; repeated rows come out each; text outside any element is a block;
unclosed comments, scripts and tags run to the end; bare ``<`` is text; other
columns are not read.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import compress

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common

#: Element names of the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i",
          "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong",
          "sub", "sup", "time", "tt", "u", "var", "wbr", "img"}
#: Elements whose start ends an open paragraph.
BREAKS_P = {"address", "article", "aside", "blockquote", "center", "details", "dialog", "dir", "div", "dl", "fieldset",
            "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr",
            "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "ul"}
#: Elements that an element of the same kind ends, up to the nearest container.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
          "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"})}
#: Without text of the page's own.
LEAVE_OUT = {"audio", "button", "canvas", "datalist", "embed", "head", "iframe", "input", "link", "map", "meta",
             "noscript", "object", "script", "select", "style", "svg", "template", "textarea", "title", "video"}
#: Never part of the article.
SIDE_TAGS = {"aside", "dialog", "footer", "menu", "nav", "search"}
#: Words of a class, id or role that name a part which is not the article.
SIDE_PARTS = {"ad", "ads", "adsense", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb",
              "breadcrumbs", "comment", "comments", "commentlist", "complementary", "contentinfo", "cookie", "cookies",
              "consent", "copyright", "disclaimer", "discussion", "disqus", "footer", "form", "gdpr", "masthead", "menu",
              "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager",
              "pagination", "popup", "promo", "promotion", "related", "replies", "respond", "search", "share", "sharing",
              "sidebar", "skip", "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget",
              "widgets"}
#: Of these, words that also name parts of an article's own text, so inside one
#: they name a side part only together with another word of either list.
AMBIGUOUS = {"alert", "copyright", "disclaimer", "discussion", "form", "notice", "notices", "related", "replies",
             "respond", "search", "skip"}
#: Words that stand with such a word in the name of a side part.
FURNITURE = {"area", "bar", "block", "box", "button", "buttons", "container", "icon", "icons", "inner", "links", "list",
             "outer", "post", "posts", "section", "signup", "slot", "unit", "wrap", "wrapper"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
MAIN = {"article", "main"}
#: Recur in one place of an article (section titles, cells, terms) without being a template's.
LABELS = HEADINGS | {"caption", "dd", "dt", "figcaption", "li", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
LEAST_PAGES, LEAST_SHARE, LEAST_SHARE_INSIDE, MANY_PAGES = 5, 0.05, 0.5, 50
#: So many template hashes of all hosts are sent to all executors; more are joined.
MOST_SHARED = 1_000_000
#: What an element's names say: nothing; a word of a side part; a side part as a whole;
#: a side part whatever it holds.
PLAIN, WORD, WHOLE, ALWAYS = range(4)

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
#: One attribute; read from left to right, so nothing inside a value is taken for a name.
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_NAME = re.compile(r"[a-z]+")
_SPACE = re.compile(r"[ \t\n\r\f\v\xa0  -     　\x1c-\x1f\x85]+")
_HOST = re.compile(r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", re.I)


@dataclass
class Element:
    tag: str
    parent: "Element | None" = None
    side: int = PLAIN
    children: list = field(default_factory=list)


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def _attributes(text: str) -> dict[str, str]:
    """Values by name in lower case; of a repeated name the first counts."""
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), (a or b or c).lower())
    return out


def _names_side_part(token: str) -> bool:
    """Whether a class or id says as a whole that it is a side part."""
    words = _NAME.findall(token)
    side = SIDE_PARTS.intersection(words)
    return bool(side) and all(w in SIDE_PARTS or w in FURNITURE for w in words) and (len(words) > 1 or not side <= AMBIGUOUS)


def _side(tag: str, attributes: str, in_main: bool) -> int:
    if tag in SIDE_TAGS or tag == "header" and not in_main:
        return ALWAYS
    by_tag = WORD if tag == "form" and not in_main else ALWAYS if tag == "form" else PLAIN
    if tag in ("body", "html") or not attributes or attributes.isspace():
        return by_tag
    values = _attributes(attributes)
    if "hidden" in values or values.get("aria-hidden") == "true" or not SIDE_PARTS.isdisjoint(values.get("role", "").split()):
        return ALWAYS
    names = [values[n] for n in ("class", "id") if n in values]
    whole = any(_names_side_part(token) for value in names for token in value.split())
    if in_main or tag in MAIN:
        # text of the article: a heading, a word or a link is no part by its name
        return ALWAYS if whole and tag not in HEADINGS and tag not in INLINE and tag != "main" else by_tag
    if whole:
        return WHOLE
    return max(by_tag, WORD if any(not SIDE_PARTS.isdisjoint(_NAME.findall(value)) for value in names) else PLAIN)


def parse(page: str) -> Element:
    """The tree of a page."""
    root = at = Element("")
    main_depth, pos, end = 0, 0, len(page)
    while pos < end:
        m = _TOKEN.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][:2] not in ("<!", "<?"):
                at.children.append(m[0])
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node is not None and node.tag != tag:
                # an inline end tag does not end blocks
                node = None if tag in INLINE and node.tag not in INLINE else node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            elif tag == "br":
                at.children.append(Element("br", at))
            continue
        if tag in BREAKS_P:
            node = at
            while node.tag in INLINE:
                node = node.parent
            if node.tag == "p":
                at = node.parent
            elif tag in MAIN and node is not at:
                at = node
        elif tag in CLOSES:
            ends, stops = CLOSES[tag]
            node = at
            while node.parent is not None and node.tag not in stops:
                if node.tag in ends:
                    at = node.parent
                node = node.parent
        new = Element(tag, at)
        new.side = _side(tag, m[3], _inside_main(at))
        at.children.append(new)
        if tag in RAW:
            stop = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
            new.children.append(page[pos:stop.start() if stop else end])
            pos = stop.end() if stop else end
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = new
    return root


def _inside_main(node: Element | None) -> bool:
    while node is not None:
        if node.tag in MAIN:
            return True
        node = node.parent
    return False


@dataclass
class Layout:
    """The blocks of a page in page order."""
    texts: list[str] = field(default_factory=list)
    linked: list[bool] = field(default_factory=list)  # mostly the text of links
    spans: list[tuple[Element, int, int]] = field(default_factory=list)  # block elements with text, first and one past


def layout(root: Element) -> Layout:
    out = Layout()
    line: list[str] = []
    in_link: list[int] = []

    def flush():
        text = _SPACE.sub(" ", _html.unescape("".join(line))).strip(" ")
        if text:
            out.texts.append(text)
            out.linked.append(2 * sum(in_link) > len("".join(line).strip()))
        line.clear()
        in_link.clear()

    links = 0
    stack: list[tuple[Element, int, int]] = [(root, 0, 0)]
    while stack:  # no recursion: pages may nest deeply
        node, i, first = stack.pop()
        if i == len(node.children):
            if node.tag == "a":
                links -= 1
            if node.tag not in INLINE:
                flush()
                if len(out.texts) > first and node.parent is not None:
                    out.spans.append((node, first, len(out.texts)))
            continue
        stack.append((node, i + 1, first))
        child = node.children[i]
        if isinstance(child, str):
            line.append(child)
            if links:
                in_link.append(len(child.strip()))
        elif child.tag == "br" or child.tag == "hr":
            flush()
        elif child.tag not in LEAVE_OUT and not (child.side and child.tag in INLINE):
            if child.tag not in INLINE:
                flush()
            links += child.tag == "a"
            stack.append((child, 0, len(out.texts)))
    flush()
    return out


def _hash(*parts) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(map(str, parts))) - (1 << 63)


def _places(page: Layout) -> tuple[set[int], set[int]]:
    """The elements (by identity) that are in an article or are one, and those
    outside that hold one."""
    inside, around = set(), set()
    for node, _, _ in reversed(page.spans):  # an element stands after what it holds
        if node.tag in MAIN or _inside_main(node.parent):
            inside.add(id(node))
            at = node.parent
            while node.tag in MAIN and at is not None and id(at) not in around:
                around.add(id(at))
                at = at.parent
    return inside, around - inside


def candidates(page: Layout) -> list[tuple[tuple[int, ...], bool, int, int]]:
    """(hashes, inside an article, first block, one past the last) of the block
    subtrees that may be a template's. Outside articles a subtree is known by its
    tag and text. Inside, where passages are quoted, it is known by its place as
    well, counted from the start and from the end of what holds it."""
    inside, around = _places(page)
    siblings: dict[int, list[int]] = {}
    for node, first, _ in page.spans:
        siblings.setdefault(id(node.parent), []).append(first)
    out = []
    for node, first, last in page.spans:
        if node.tag in ("html", "body") or id(node) in around:
            continue
        text = page.texts[first:last]
        if id(node) not in inside:
            out.append(((_hash(node.tag, *text),), False, first, last))
        elif node.tag not in LABELS:
            path, at = [], node
            while at is not None and (at is node or _inside_main(at)):
                path.append(at.tag)
                at = at.parent
            own = siblings[id(node.parent)]
            n = bisect_left(own, first)
            out.append((tuple(_hash(end, k, "/".join(path), *text) for end, k in (("<", n), (">", len(own) - n))),
                        True, first, last))
    return out


def _in_article(page: Layout, but: bytearray) -> bytearray:
    """The blocks of articles, ``but`` for those."""
    mark = bytearray(len(page.texts))
    for node, first, last in page.spans:
        if node.tag in MAIN:
            mark[first:last] = b"\1" * (last - first)
    return bytearray(a & ~b for a, b in zip(mark, but))


def _of_template(page: Layout, template: frozenset[int], article: bytearray) -> bytearray:
    """The blocks that the host's template has."""
    gone, own = bytearray(len(page.texts)), bytearray(len(page.texts))
    if template:
        for hashes, inside, first, last in candidates(page):
            if not template.isdisjoint(hashes):
                (own if inside else gone)[first:last] = b"\1" * (last - first)
        size = [len(t) for t in page.texts]
        # an article that recurs for the most part is a series or a copy, not a template
        if 2 * sum(compress(size, own)) <= sum(compress(size, article)):
            gone = bytearray(a | b for a, b in zip(gone, own))
    return gone


def _by_name(page: Layout, gone: bytearray) -> bytearray:
    """The blocks of parts that are none of the article by their names, outer
    parts first; ``gone`` blocks count for nothing."""
    mark = bytearray(len(page.texts))
    sides = [span for span in page.spans if span[0].side]
    if not sides:
        return mark
    size = [0 if g else len(t) for t, g in zip(page.texts, gone)]
    total = sum(size)
    holds = sorted(first for node, first, _ in page.spans if node.tag in MAIN)
    for node, first, last in reversed(sides):  # an element stands after what it holds
        if mark[first]:
            continue
        k = bisect_left(holds, first)
        article = k < len(holds) and holds[k] < last
        most = 2 * sum(size[first:last]) > total
        if node.side == ALWAYS or not (article and most if node.side == WHOLE else article or most):
            mark[first:last] = b"\1" * (last - first)
    return mark


def main_text(root: Element, template: frozenset[int] = frozenset()) -> str:
    """The page's text without the subtrees that the host's template has, and
    without what is a side part by its name."""
    return "\n".join(_main_blocks(layout(root), template))


def _main_blocks(page: Layout, template: frozenset[int]) -> list[str]:
    gone = bytearray(len(page.texts))
    named = _by_name(page, gone)
    if template:
        gone = _of_template(page, template, _in_article(page, named))
        if any(gone):
            named = _by_name(page, gone)
    article = _in_article(page, named)
    left = [i for i in range(len(page.texts)) if not gone[i] and not named[i]]
    if any(article):
        beside = [i for i in left if not article[i] and not page.linked[i]]
        held = [i for i in left if article[i]]
        # what the known template left is the page's own; without one only text
        # that outweighs the articles, which are teasers then
        length = lambda at: sum(len(page.texts[i]) for i in at)
        left = sorted(held + beside) if template or length(beside) > length(held) else held
    return [page.texts[i] for i in left]


def subtree_hashes(pages: DataFrame) -> DataFrame:
    """(host, inside, hash, text) of the candidates of (url, html) pages, once a
    page; ``text`` is the hash of its main text as far as names tell it. Rows with
    a null hash stand for the page, and for its articles."""
    schema = pa.schema([("host", pa.string()), ("inside", pa.bool_()), ("hash", pa.int64()), ("text", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "html"):
            hosts, insides, hashes, texts = [], [], [], []
            for url, html in zip(b.column(0).to_pylist(), common.texts(b.column(1))):
                page = layout(parse(html))
                article = any(node.tag in MAIN for node, _, _ in page.spans)
                own = {(inside, h) for found, inside, _, _ in candidates(page) for h in found} | {(False, None)}
                if article:
                    own.add((True, None))
                hosts += [host_of(url)] * len(own)
                insides += [inside for inside, _ in own]
                hashes += [h for _, h in own]
                texts += [_hash(*_main_blocks(page, frozenset()))] * len(own)
            yield common.out_batch(schema, host=hosts, inside=insides, hash=hashes, text=texts)

    return pages.select("url", "html").mapInArrow(run, "host string, inside boolean, hash long, text long")


def templates(hashes: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE,
              least_share_inside: float = LEAST_SHARE_INSIDE, many_pages: int = MANY_PAGES) -> DataFrame:
    """(host, hashes) of the subtrees that recur on many pages of a host. Pages of
    one text count once, as copies say nothing about what surrounds the text."""
    counts = hashes.distinct().groupBy("host", "inside", "hash").agg(F.count("*").alias("n"))
    # few rows, read twice: the pages are parsed once for them
    counts = common.stored(counts.where(F.col("hash").isNull() | (F.col("n") >= least_pages)), "counts")
    n_pages = counts.where("hash is null").select("host", "inside", F.col("n").alias("pages"))
    enough = F.when(F.col("inside"), least_share_inside * F.col("pages")) \
        .otherwise(F.least(least_share * F.col("pages"), F.lit(float(many_pages))))
    often = counts.where(F.col("hash").isNotNull() & (F.col("n") >= least_pages)).join(n_pages, ["host", "inside"]) \
        .where(F.col("n") >= enough)
    return often.groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html",
            least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, most_shared: int = MOST_SHARED) -> DataFrame:
    """(id, url, text) of every page."""
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), F.col(html).alias("html"))
    found = common.stored(templates(subtree_hashes(rows), least_pages, least_share), "templates")
    # a host's list is short, the hosts' lists together may not be: sent to all
    # executors only if they are few, else joined
    n = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    if n <= most_shared:
        shared = pages.sparkSession.sparkContext.broadcast(
            {r["host"]: frozenset(r["hashes"]) for r in found.toLocalIterator()})

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches, "html"):
                yield common.out_batch(schema, id=b.column(0), url=b.column(1), text=[
                    main_text(parse(p), shared.value.get(host_of(u), frozenset()))
                    for u, p in zip(b.column(1).to_pylist(), common.texts(b.column(2)))])

        return rows.mapInArrow(run, "id long, url string, text string")

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "html"):
            yield common.out_batch(schema, id=b.column(0), url=b.column(1), text=[
                main_text(parse(p), frozenset(t or ()))
                for p, t in zip(common.texts(b.column(2)), b.column(3).to_pylist())])

    host = F.lower(F.coalesce(F.regexp_extract(F.col("url"), _HOST.pattern.replace("^(?:[a-z]", "^(?i)(?:[a-z]"), 1), F.lit("")))
    return rows.withColumn("host", host).join(found, "host", "left").select("id", "url", "html", "hashes") \
        .mapInArrow(run_joined, "id long, url string, text string")


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    text = extract(common.read(spark, sf_dir, "pages"))
    return text.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))
