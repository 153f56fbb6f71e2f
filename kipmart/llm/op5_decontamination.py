"""Benchmark decontamination (operator 5): a suffix automaton of the test items.

Words are runs of ASCII letters, digits and bytes beyond ASCII, with A-Z in
lower case. The items' words go into one generalised suffix automaton (each
item starts at its root, so no match runs over two items). A document's words
are streamed through it; the length of the longest match ending at each word
tells whether one of the item windows (``window`` consecutive words, or a whole
shorter item) ends there. Words that no item holds break every match, so only
runs of known words as long as the shortest window are streamed at all.

The automaton is broadcast in blocks of items of at most ``block_words`` words
(longer items in pieces that overlap by a window less one word), packed on Spark
and stored, so what is sent, and what the driver holds at a time, has a fixed
size bound. If there are several blocks the document rows are numbered and
stored first, the documents pass once for each block, and the hits of all blocks
are put together per row by word position before anything is decided on them.

``find_hits`` gives every document's hit words as runs (first and one past the
last word, and their byte offsets) and the items found; ``decontaminate`` cuts
them out of the texts and drops documents that are mostly hit.

Defined cases: null and empty texts have no words and no hits; items without a
word (or null) match nothing; an empty benchmark or document table gives no
hits or no rows; repeated items are all reported; an item id that is null is
not reported, but its words count; repeated documents are judged each; other
columns are not read (``decontaminate`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kipmart.llm import common, textvec

WINDOW = 10
#: Words of items in one broadcast automaton (at most twice as many states).
BLOCK_WORDS = 200_000
#: Lower-cases A-Z and turns every byte that is in no word into a space.
_WORDS = bytes(textvec.LOWER[i] if textvec.WORD[i] else 32 for i in range(256))
RUN = "first long, last long, start long, end long"
SCHEMA = f"row long, id long, n_words long, n_hit long, runs array<struct<{RUN}>>, items array<long>"
_RUN = pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")])
OUT = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()),
                 ("runs", pa.list_(_RUN)), ("items", pa.list_(pa.int64()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


class SuffixAutomaton:
    """Generalised suffix automaton of word lists, with, for each state, the
    items whose windows end there."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words in items]
        for words in coded:
            at = 0
            for w in words:
                at = self._add(at, w)
        #: items by state: of windows as long as ``window`` in ``full``, of
        #: whole shorter items in ``short``, with the item's length
        self.full: dict[int, set[int]] = {}
        self.short: dict[int, dict[int, set[int]]] = {}
        self.least = min([min(len(words), window) for words in coded if words], default=window)
        for k, words in enumerate(coded):
            at = size = 0
            for w in words:
                at = self.next[at][w]
                size += 1
                if size > window:
                    size = window
                    while self.length[self.link[at]] >= window:
                        at = self.link[at]
                if size == window:
                    self.full.setdefault(at, set()).add(k)
            if 0 < len(words) < window:
                self.short.setdefault(at, {}).setdefault(len(words), set()).add(k)

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        return len(self.length) - 1

    def _copy(self, p: int, w: int, q: int) -> int:
        """Split the state ``q`` so that one state has the strings up to p's length + 1."""
        c = self._new(self.length[p] + 1)
        self.next[c], self.link[c] = dict(self.next[q]), self.link[q]
        self.link[q] = c
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def _add(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, w, q)
        new, p = self._new(self.length[last] + 1), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, w, q)
        return new

    def stream(self, codes: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit stretches (first, one past the last) of these words, in order
        of their ends, and the items found."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        at = size = 0
        hits, found = [], set()
        for i, w in enumerate(codes):
            to = nxt[at].get(w)
            while to is None and at:
                at = link[at]
                size = length[at]
                to = nxt[at].get(w)
            if to is None:
                size = 0
                continue
            at, size = to, size + 1
            s = at  # the state of the longest match, then of its suffixes
            best = 0
            if size >= window:
                while length[link[s]] >= window:
                    s = link[s]
                if s in self.full:
                    best = window
                    found |= self.full[s]
            if self.short:
                s, most = at, size
                while s > 0:
                    for n, ks in self.short.get(s, {}).items():
                        if n <= most:
                            best = max(best, n)
                            found |= ks
                    s = link[s]
                    most = length[s]
            if best:
                hits.append((i + 1 - best, i + 1))
        return hits, found


def _merge(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(hits):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def _known_runs(codes: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Stretches of at least ``least`` words that items hold."""
    known = np.concatenate([[False], codes >= 0, [False]])
    edge = np.flatnonzero(known[1:] != known[:-1])
    a, z = edge[::2], edge[1::2]
    long = z - a >= least
    return list(zip(a[long].tolist(), z[long].tolist()))


def match(text: bytes, automaton: SuffixAutomaton) -> tuple[list[tuple[int, int]], set[int], int]:
    """(hit stretches in words, items found, number of words)."""
    words = words_of(text)
    get = automaton.vocabulary.get
    codes = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    hits, found = [], set()
    for a, z in _known_runs(codes, automaton.least):
        h, f = automaton.stream(codes[a:z].tolist())
        hits += [(a + x, a + y) for x, y in h]
        found |= f
    return _merge(hits), found, len(words)


def _runs(text: bytes, stretches: list[tuple[int, int]]) -> list[dict]:
    if not stretches:
        return []
    buffer = np.frombuffer(text, np.uint8)
    w = textvec.words(buffer, np.array([0, len(buffer)]))
    return [{"first": a, "last": z, "start": int(w.start[a]), "end": int(w.end[z - 1])} for a, z in stretches]


#: Blocks that one task packs.
BLOCKS_A_TASK = 8
_ITEM = pa.schema([("block", pa.int64()), ("item", pa.int64()), ("words", pa.binary()), ("n", pa.int64())])
ITEM = "block long, item long, words binary, n long"


def _stored_blocks(items: DataFrame, item_id: str, text: str, window: int, block_words: int) -> tuple[DataFrame, list[int]]:
    """(block, item, words, n) rows of at most ``block_words`` words a block, and
    the blocks."""
    most = max(block_words, 2 * window)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "t"):
            own, words = [], []
            for i, t in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1))):
                w = words_of(t)
                starts = [0] if len(w) <= most else range(0, len(w) - window + 1, most - window + 1)
                for at in starts if w else ():
                    own.append(i)
                    words.append(w[at:at + most])
            yield common.out_batch(_ITEM, block=[0] * len(own), item=own, words=[b" ".join(w) for w in words],
                                   n=[len(w) for w in words])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            blocks = []
            for n in b.column(3).to_pylist():
                if size and size + n > most:
                    block, size = block + 1, 0
                size += n
                blocks.append(block)
            yield common.out_batch(_ITEM, block=blocks, item=b.column(1), words=b.column(2), n=b.column(3))

    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t"))
    cut = common.stored(rows.mapInArrow(pieces, ITEM), "items")
    total = cut.agg(F.sum("n")).first()[0] or 0
    packed = common.stored(cut.coalesce(max(1, -(-total // (BLOCKS_A_TASK * most)))).mapInArrow(pack, ITEM), "blocks")
    return packed, sorted(r["block"] for r in packed.select("block").distinct().collect())


def _block(packed: DataFrame, block: int) -> list[tuple[int | None, list[bytes]]]:
    return [(r["item"], bytes(r["words"]).split()) for r in packed.where(F.col("block") == block).collect()]


def _find_block(docs: DataFrame, shared, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, ids = SuffixAutomaton(shared.value, window), [i for i, _ in shared.value]
        for b in common.blocks(batches, "text"):
            n_words, n_hit, runs, items = [], [], [], []
            for text in common.text_bytes(b.column(2)):
                hits, found, n = match(text, automaton)
                n_words.append(n)
                n_hit.append(sum(z - a for a, z in hits))
                runs.append(_runs(text, hits))
                items.append(sorted({ids[k] for k in found if ids[k] is not None}))
            yield common.out_batch(OUT, row=b.column(0), id=b.column(1), n_words=n_words, n_hit=n_hit,
                                   runs=pa.array(runs, pa.list_(_RUN)), items=pa.array(items, pa.list_(pa.int64())))

    return docs.mapInArrow(run, SCHEMA)


def _find_all(docs: DataFrame, packed: DataFrame, blocks: list[int], window: int) -> DataFrame:
    """The hits of all blocks, a row for each row of (row, id, text), whose ``row``
    is unique and stored. One block at a time is read, sent and given up again."""
    every = None
    for k in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(_block(packed, k))
        found = _find_block(docs, shared, window)
        # a block without a hit adds nothing to a document but its first part
        found = common.stored(found if every is None else found.where("n_hit > 0"), "hits")
        shared.destroy()
        every = found if every is None else every.unionAll(found)
    merge = F.udf(lambda runs: _merge_runs(runs), T.ArrayType(T._parse_datatype_string(f"struct<{RUN}>")))
    grouped = every.groupBy("row").agg(
        F.max("id").alias("id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = grouped.withColumn("runs", F.when(F.size("runs") > 1, merge("runs")).otherwise(F.col("runs")))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["last"] - r["first"])
    return merged.select("row", "id", "n_words", n_hit.alias("n_hit"), "runs", "items")


def find_hits(docs: DataFrame, items: DataFrame, window: int = WINDOW, id: str = "doc_id", text: str = "text",
              item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, n_words, n_hit, runs, items) of every document row."""
    rows = docs.select(F.lit(0).cast("long").alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    packed, blocks = _stored_blocks(items, item_id, item_text, window, block_words)
    if len(blocks) > 1:
        rows = common.stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")
        return _find_all(rows, packed, blocks, window).drop("row")
    shared = docs.sparkSession.sparkContext.broadcast(_block(packed, blocks[0]) if blocks else [])
    return _find_block(rows, shared, window).drop("row")


def _merge_runs(runs: list) -> list:
    out: list[list[int]] = []
    for r in sorted([r["first"], r["last"], r["start"], r["end"]] for r in runs):
        if out and r[0] <= out[-1][1]:
            if r[1] > out[-1][1]:
                out[-1][1], out[-1][3] = r[1], r[3]
        else:
            out.append(r)
    return [tuple(r) for r in out]


def _cut_runs(text: bytes, runs: list[dict]) -> bytes:
    at, keep = 0, []
    for r in runs:
        keep.append(text[at:r["start"]])
        at = r["end"]
    return b"".join([*keep, text[at:]])


def cut_text(text: bytes, automaton: SuffixAutomaton, coverage: float) -> bytes | None:
    """The text without its hit spans; None if more than the share ``coverage`` of
    its words is hit. Cutting goes on until nothing is hit: what stood before
    and after a span may together be a window."""
    first = True
    while True:
        hits, _, n = match(text, automaton)
        if first and sum(z - a for a, z in hits) > coverage * n:
            return None
        if not hits:
            return text
        first, text = False, _cut_runs(text, _runs(text, hits))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = 0.5,
                  text: str = "text", item_text: str = "text", n_chars: str = "n_chars",
                  block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents, all columns, without their hit spans, and without the
    documents of which more than the share ``coverage`` of the words is hit. A changed
    text gets its new length in the column ``n_chars``, if there is one. The result
    is the same however many blocks the items need."""
    at, columns = docs.columns.index(text), docs.columns
    ids = items.select(F.lit(None).cast("long").alias("item_id"), F.col(item_text).alias("text"))
    packed, blocks = _stored_blocks(ids, "item_id", "text", window, block_words)
    if len(blocks) > 1:
        return _cut_all(docs, packed, blocks, window, coverage, text, n_chars)
    if blocks:
        length_at = columns.index(n_chars) if n_chars in columns else None
        docs = _cut_block(docs, _block(packed, blocks[0]), window, coverage, at, length_at)
    return docs


def _cut_all(docs: DataFrame, packed: DataFrame, blocks: list[int], window: int, coverage: float, text: str,
             n_chars: str) -> DataFrame:
    """Coverage and cuts by the hits of all blocks together; changed texts are
    searched again until nothing is hit in them."""
    # the columns in one struct, so that none of them meets a name of this module
    whole = common.stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "rows")
    texts = whole.select("row", F.lit(None).cast("long").alias("id"), F.col("doc").getField(text).alias("text"))
    schema = pa.schema([("row", pa.int64()), ("text", pa.string())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text"):
            yield common.out_batch(schema, row=b.column(0), text=[
                _cut_runs(t, runs).decode() for t, runs in zip(common.text_bytes(b.column(1)), b.column(2).to_pylist())])

    gone, rounds = None, []
    while True:
        hits = common.stored(_find_all(texts, packed, blocks, window).where("n_hit > 0")
                             .select("row", "n_words", "n_hit", "runs"), "hits")
        if gone is None:
            too_many = F.col("n_hit") > F.lit(coverage) * F.col("n_words")
            gone, hits = hits.where(too_many).select("row"), hits.where(~too_many)
        if hits.isEmpty():
            break
        changed = common.stored(texts.join(hits, "row").select("row", "text", "runs")
                                .mapInArrow(cut, "row long, text string"), "changed")
        rounds.append(changed.withColumn("round", F.lit(len(rounds))))
        texts = changed.select("row", F.lit(None).cast("long").alias("id"), "text")
    kept = whole.join(gone, "row", "left_anti")
    if not rounds:
        return kept.select("doc.*")
    every = rounds[0]
    for r in rounds[1:]:
        every = every.unionAll(r)
    last = every.groupBy("row").agg(F.max_by("text", "round").alias("new"))
    new, out = F.col("new"), []
    for f in docs.schema.fields:
        old = F.col("doc").getField(f.name)
        changed = {text: new, n_chars: F.length(new)}.get(f.name)
        out.append((old if changed is None else F.when(new.isNotNull(), changed.cast(f.dataType)).otherwise(old)).alias(f.name))
    return kept.join(last, "row", "left").select(*out)


def _cut_block(docs: DataFrame, block: list, window: int, coverage: float, at: int, length_at: int | None) -> DataFrame:
    shared, name = docs.sparkSession.sparkContext.broadcast(block), docs.columns[at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = SuffixAutomaton(shared.value, window)
        for b in common.blocks(batches, name):
            old = b.column(at).to_pylist()
            new = [None if t is None else cut_text(t.encode(), automaton, coverage) for t in old]
            stays = [t is None or n is not None for t, n in zip(old, new)]
            texts = [None if n is None else n.decode() for n in new]
            arrays = list(b.columns)
            if any(s and t != o for s, t, o in zip(stays, texts, old)):
                arrays[at] = pa.array(texts, b.schema.field(at).type)
                if length_at is not None:
                    lengths = [len(t) if s and t is not None and t != o else n for s, t, o, n in
                               zip(stays, texts, old, b.column(length_at).to_pylist())]
                    arrays[length_at] = pa.array(lengths, b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema).filter(pa.array(stays, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the benchmark's windows in every document."""
    hits = find_hits(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
    names = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return hits.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                       F.sha2(names.cast("binary"), 256).alias("items_sha256"),
                       (F.col("n_hit") > 0).alias("contaminated"))


#: The same by joining every document word's window with the items' windows.
ORACLE = r"""
with doc as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from documents),
item as (
  select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w
  from benchmark),
gram as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from item where len(w) > 0)),
place as (
  select doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') as g
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as i
        from doc, (select distinct n from gram) where len(w) >= n)),
hit as (select p.doc_id, p.i, p.n, t.item_id from place p join gram t on p.n = t.n and p.g = t.g),
word as (select doc_id, count(distinct k) as n_hit from (
  select doc_id, unnest(range(i, i + n)) as k from (select distinct doc_id, i, n from hit)) group by doc_id),
found as (select doc_id, count(*) as n_items, string_agg(s, ',' order by s) as names
  from (select distinct doc_id, item_id, cast(item_id as varchar) as s from hit) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, coalesce(word.n_hit, 0) as n_hit,
       coalesce(found.n_items, 0) as n_items, sha256(coalesce(found.names, '')) as items_sha256,
       coalesce(word.n_hit, 0) > 0 as contaminated
from doc d left join word using (doc_id) left join found using (doc_id)
"""
