"""N-gram Jaccard join (operator 8): classes of documents by shared shingles.

Two documents link when the Jaccard similarity of their sets of word shingles
is at least ``percent``; the result is each document's connected class.

1. *Sets.* Documents with the same set are one node from here on, so groups of
   exact copies of any size cost one row. A count sketch of all shingles of all
   documents (a fixed table of 2**17 counters) gives a common order of the
   shingles, rare ones first.
2. *Blocking.* Sets as similar as asked share a shingle among the first
   ``n - ceil(percent n) + 1`` of each in that order (prefix filter, exact), and
   the smaller of the two has it among its first ``n - ceil(2p/(1+p) n) + 1``. Nodes
   meet in the buckets of those shingles. Buckets with one member go, and those
   without a member that has the shingle so early; of buckets with the same
   members the first in the order stays.
3. *Index.* Shingles are hashed into 256 groups; a node's group counts are a
   point. The members of a bucket are searched with an R-tree over these points:
   the overlap with anything in a box is at most the sum of the coordinate
   minima of the query and the box's upper corner, and must reach
   p/(1+p) * (both sizes). Only members of different classes are sought. The
   places of a bucket's shingle in two sets bound the overlap too, as nothing before
   it is shared: a pair is named by the first bucket it shares alone, which each
   member knows from its ``EARLIER`` first buckets (a pair whose first is a later
   one may be named again).
4. *Verification.* Surviving pairs are compared by their whole sets; links join
   classes (alternating star contraction, in Spark).

The first round compares each bucket's members with its member of most buckets
only, which joins groups of near copies in a number of comparisons linear in
their size. Later rounds search the buckets that still hold several classes: all
pairs of buckets no larger than a leaf, and each member's ``reach`` likeliest
partners of another class in larger ones. Buckets with more than that come again
with a ``reach`` four times as large, until no pair is left untested. So no link between classes is lost and no group yields all pairs.
Large buckets are searched in blocks: the members outside a bucket's largest
class against blocks of at most ``block`` members.

Defined cases: null, empty and blank texts have an empty set and are linked
with nothing; fewer than ``k`` words make one shingle; repeated rows (same id) each
come out with the class of their set; null ids are kept, and never name a class
unless all ids of it are null; an empty table gives an empty result; other
columns are not read. Sets are told apart, and shingles compared, by 64-bit
hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common, textvec

K, PERCENT = 4, 85
GROUPS = 256
SKETCH_BITS, SLICES = 17, 32
BLOCK, REACH, LEAF = 4096, 16, 64
#: Buckets by which a node knows that a pair was met before.
EARLIER = 32
#: Rows of at most this many nodes are sent to all executors (8 bytes each).
BROADCAST_ROWS = 2_000_000
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5,
                     0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def shingles(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """(first shingle of each text, hashes): the distinct shingles of each text
    of a block, in order of their first place."""
    buffer, offs = common.text_buffer(column)
    w = textvec.words(buffer, offs, textvec.INK)
    n, counts, m = len(offs) - 1, w.counts, len(w.hash)
    h = np.zeros(max(m - k + 1, 0), np.uint64)
    for j in range(k):
        h += w.hash[j:m - k + 1 + j] * _FACTORS[j % 8]
    place = np.arange(len(h))
    of = w.text_of()
    inside = of[:len(h)] == of[k - 1:] if len(h) else np.zeros(0, bool)
    h, text = textvec.mix(h[inside]), of[place[inside]]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        few = np.array([sum((int(w.hash[w.first[i] + j]) * int(_FACTORS[j % 8]) for j in range(counts[i])),
                            int(counts[i])) & ((1 << 64) - 1) for i in short], np.uint64)
        h, text = np.concatenate([h, textvec.mix(few)]), np.concatenate([text, short])
        order = np.argsort(text, kind="stable")
        h, text = h[order], text[order]
    fresh = ~pd.Series(textvec.mix(h + text.astype(np.uint64) * _FACTORS[0])).duplicated().to_numpy()
    h, text = h[fresh], text[fresh]
    return np.searchsorted(text, np.arange(n + 1)), h


def _nodes(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """64-bit name of each text's set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(textvec.mix(h ^ _FACTORS[1]))])
    size = np.diff(first).astype(np.uint64)
    return textvec.mix(total[first[1:]] - total[first[:-1]] + size * _FACTORS[2]).view(np.int64)


def _points(first: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Group counts of each text's set."""
    n = len(first) - 1
    text = np.repeat(np.arange(n), np.diff(first))
    return np.bincount(text * GROUPS + (h % np.uint64(GROUPS)).astype(np.int64), minlength=n * GROUPS) \
        .reshape(n, GROUPS)


def _binary(points: np.ndarray) -> pa.Array:
    """Points as bytes: one a group, or four for the sets whose counts need it."""
    wide = points.max(1, initial=0) > 255
    return pa.array([r.astype("<u4" if w else "u1").tobytes() for r, w in zip(points, wide)], pa.binary())


def _decoded(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.to_pylist()
    if all(len(v) == GROUPS for v in values):
        return np.frombuffer(b"".join(values), "u1").reshape(-1, GROUPS).astype(np.int32)
    return np.stack([np.frombuffer(v, "u1" if len(v) == GROUPS else "<u4").astype(np.int32) for v in values])


_PROFILE = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("node", pa.int64()), ("point", pa.binary()),
                      ("slice", pa.int32()), ("counts", pa.list_(pa.int64()))])


def profile(docs: DataFrame, k: int = K) -> DataFrame:
    """One row per document (id, n, node, point), and after them the sketch of
    the task's shingles (slice, counts): one reading of the texts for both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in common.blocks(batches, "text"):
            first, h = shingles(b.column(1), k)
            sketch += np.bincount((h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(sketch))
            none = pa.nulls(b.num_rows)
            yield common.out_batch(_PROFILE, id=b.column(0), n=np.diff(first), node=_nodes(first, h),
                                   point=_binary(_points(first, h)), slice=none.cast(pa.int32()),
                                   counts=none.cast(pa.list_(pa.int64())))
        if sketch.any():
            none = pa.nulls(SLICES)
            yield common.out_batch(_PROFILE, id=none.cast(pa.int64()), n=none.cast(pa.int64()),
                                   node=none.cast(pa.int64()), point=none.cast(pa.binary()),
                                   slice=np.arange(SLICES, dtype=np.int32),
                                   counts=pa.array(list(sketch.reshape(SLICES, -1)), pa.list_(pa.int64())))

    return docs.mapInArrow(run, "id long, n long, node long, point binary, slice int, counts array<long>")


def sketch_of(profiles: DataFrame) -> np.ndarray:
    """Counters over all documents (a fixed number of them)."""
    rows = profiles.where("slice is not null").select("slice", F.posexplode("counts")) \
        .groupBy("slice", "pos").agg(F.sum("col").alias("c")).toArrow()
    out = np.zeros(1 << SKETCH_BITS, np.int64)
    out[rows["slice"].to_numpy().astype(np.int64) * (len(out) // SLICES) + rows["pos"].to_numpy()] = rows["c"].to_numpy()
    return out


def prefix_length(n: np.ndarray, percent: int) -> np.ndarray:
    return n - (-(-percent * n // 100)) + 1


def own_length(n: np.ndarray, percent: int) -> np.ndarray:
    """Length of the prefix in which the smaller of two sets has their first
    shared shingle."""
    return n - (-(-2 * percent * n // (100 + percent))) + 1


def least_shared(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that linked sets of these sizes share at least."""
    return -(-percent * (n + m) // (100 + percent))


def least_size(percent: int) -> int:
    """Smallest set that can link with another set: a set of n, with one more."""
    n = 1
    while 100 * n < percent * (n + 1):
        n += 1
    return n


def prefixes(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(token, node, n, place, own): the first shingles of each set with their
    places in the order, once a task; ``own`` if also the smaller set of a pair
    may first share it."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    least = least_size(percent)
    schema = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int64()),
                        ("place", pa.int32()), ("own", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for b in common.blocks(batches, "text"):
            first, h = shingles(b.column(1), k)
            n, node = np.diff(first), _nodes(first, h)
            use = np.zeros(len(n), bool)
            for i in np.flatnonzero(n >= least):
                x = int(node[i])
                if x not in seen:
                    seen.add(x)
                    use[i] = True
            pick = np.repeat(use, n)
            text = np.repeat(np.arange(len(n)), n)[pick]
            h = h[pick]
            order = np.lexsort((h, count[(h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], text))
            text, h = text[order], h[order]
            kept = np.where(use, n, 0)
            rank = np.arange(len(h)) - np.repeat(np.cumsum(kept) - kept, kept)
            early = rank < prefix_length(n, percent)[text]
            text, rank = text[early], rank[early]
            yield common.out_batch(schema, token=h[early].view(np.int64), node=node[text], n=n[text],
                                   place=rank.astype(np.int32), own=rank < own_length(n, percent)[text])

    return docs.mapInArrow(run, "token long, node long, n long, place int, own boolean")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcasting if its (counted) rows are few."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def buckets(prefix_rows: DataFrame) -> DataFrame:
    """(node, n, tokens) of nodes in buckets with several members: the buckets
    of each as (place, token) in the order; of buckets with the same members only
    the first."""
    several = prefix_rows.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.max("own").alias("own")) \
        .where("own and lo <> hi").select("token")
    several = common.stored(several, "tokens")
    rows = prefix_rows.join(_small(several, several.count()), "token").select("token", "node", "n", "place")
    rows = common.stored(rows, "shared")
    # members have the shingles of buckets with the same members in the same order
    first = rows.groupBy("token").agg(
        F.count("*").alias("k"), F.sum("place").alias("place"),
        F.min("node").alias("lo"), F.max("node").alias("hi"), F.sum(F.xxhash64("node").bitwiseAND(0xFFFFFFFF)).alias("x"),
        F.sum(F.shiftrightunsigned(F.xxhash64("node"), 32)).alias("y")) \
        .groupBy("lo", "hi", "k", "x", "y").agg(F.min_by("token", "place").alias("token")).select("token")
    first = common.stored(first, "first")
    return rows.join(_small(first, first.count()), "token") \
        .groupBy("node", "n").agg(F.sort_array(F.collect_set(F.struct("place", "token"))).alias("tokens"))


class RTree:
    """R-tree over count vectors, packed by sorting; searched by upper bounds
    of the overlap."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points, self.size = points, points.sum(1)
        # pack: by size, then slices by the coordinate that spreads most
        order = np.argsort(self.size, kind="stable")
        spread = points.var(0).argmax() if len(points) else 0
        slab = leaf * max(1, int(np.sqrt(len(order) / leaf)))
        for a in range(0, len(order), slab):
            part = order[a:a + slab]
            order[a:a + slab] = part[np.argsort(points[part, spread], kind="stable")]
        self.order = order
        cut = np.arange(0, len(order), leaf)
        self.high = np.maximum.reduceat(points[order], cut) if len(order) else points
        self.low_size = np.minimum.reduceat(self.size[order], cut) if len(order) else self.size
        self.high_size = np.maximum.reduceat(self.size[order], cut) if len(order) else self.size
        self.leaf = leaf

    def search(self, q: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(members that may link with the point, bound of the overlap)."""
        n = int(q.sum())
        near = np.flatnonzero((100 * self.high_size >= percent * n) & (percent * self.low_size <= 100 * n))
        if len(near):
            top = np.minimum(self.high[near], q).sum(1)
            # overlap >= percent (n + m) / (100 + percent) for a member of size m
            near = near[(100 + percent) * top >= percent * (n + np.maximum(self.low_size[near], -(-percent * n // 100)))]
        if not len(near):
            return near, near
        at = (near[:, None] * self.leaf + np.arange(self.leaf)).ravel()
        at = self.order[at[at < len(self.order)]]
        bound = np.minimum(self.points[at], q).sum(1)
        ok = (100 + percent) * bound >= percent * (n + self.size[at])
        return at[ok], bound[ok]


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("cut", pa.int64())])


def _pairs_of(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum(node[a], node[b]), np.maximum(node[a], node[b])


class Bucketed:
    """Rows of buckets: class, point, size, place of the bucket's shingle, and
    the buckets that a row's node had before (``early``)."""

    def __init__(self, klass: np.ndarray, points: np.ndarray, place: np.ndarray, early: list[np.ndarray]) -> None:
        self.klass, self.points, self.place, self.early = klass, points, place, early
        self.size, self.sets = points.sum(1), {}

    def may_link(self, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        """Whether the shingles from the bucket's on are enough for a link."""
        least = least_shared(self.size[a], self.size[b], percent)
        return (self.klass[a] != self.klass[b]) & (self.size[a] - self.place[a] >= least) \
            & (self.size[b] - self.place[b] >= least)

    def first_met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no earlier bucket of both is known."""
        return np.fromiter((self._early(i).isdisjoint(self._early(j)) for i, j in zip(a, b)), bool, len(a))

    def _early(self, i: int) -> frozenset:
        if i not in self.sets:
            self.sets[i] = frozenset(self.early[i].tolist())
        return self.sets[i]


def search_leaves(rows: Bucketed, start: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of different classes that may link, in groups no larger than
    a leaf of the tree (given by first row and size), all groups at once."""
    out_a, out_b, points, total = [], [], rows.points, rows.size
    for s in np.unique(size):
        i, j = np.triu_indices(s, 1)
        base = start[size == s]
        for part in np.array_split(base, 1 + len(base) * len(i) // 12_000):
            a, b = (part[:, None] + i).ravel(), (part[:, None] + j).ravel()
            near = rows.may_link(a, b, percent)
            a, b = a[near], b[near]
            ok = (100 + percent) * np.minimum(points[a], points[b]).sum(1) >= percent * (total[a] + total[b])
            a, b = a[ok], b[ok]
            ok = rows.first_met(a, b)
            out_a.append(a[ok])
            out_b.append(b[ok])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def search_tree(rows: Bucketed, of: np.ndarray, role: np.ndarray, reach: int,
                percent: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row pairs among the rows ``of`` a bucket: the likeliest partners of another
    class of each query, and whether some query has more. ``role``: 1 for queries,
    0 for members that are only searched, 2 for both."""
    tree_of = of[role != 1]
    tree, a, b, cut = RTree(rows.points[tree_of]), [], [], False
    for i in of[role != 0]:
        at, bound = tree.search(rows.points[i], percent)
        at = tree_of[at]
        ok = rows.may_link(np.full(len(at), i), at, percent)
        at, bound = at[ok], bound[ok]
        ok = rows.first_met(np.full(len(at), i), at)
        at, bound = at[ok], bound[ok]
        if len(at) > reach:
            likely = bound / (rows.size[i] + rows.size[at] - bound)
            at, cut = at[np.argsort(-likely, kind="stable")[:reach]], True
        a.append(np.full(len(at), i))
        b.append(at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b]), cut


def search_buckets(members: DataFrame, nodes: DataFrame, reach: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b, cut) from (token, node, klass, place, nth) rows of buckets with
    several classes and the (node, point, early) rows of their nodes: pairs to
    compare; and rows with the ``cut`` token of buckets in which a member has more
    partners than named."""
    per_class = members.groupBy("token", "klass").count()
    per = per_class.groupBy("token").agg(F.max_by("klass", F.struct("count", "klass")).alias("major"),
                                         F.max("count").alias("n_major"), F.sum("count").alias("n_all"))
    rows = members.join(per, "token")
    minor = F.col("klass") != F.col("major")
    n_major, n_minor = (F.ceil(c / F.lit(float(block))).cast("int") for c in (
        F.col("n_major"), F.col("n_all") - F.col("n_major")))
    home = F.pmod(F.xxhash64("node"), F.when(minor, n_minor).otherwise(n_major)).cast("int")
    # tasks (i, j): minor block i as queries against major block j (j >= 0) or
    # minor block -1 - j
    as_query = F.transform(F.sequence(-n_minor, n_major - 1), lambda j: F.struct(
        F.col("home").alias("i"), j.alias("j"), F.when(j == -1 - F.col("home"), 2).otherwise(1).alias("role")))
    minor_target = F.transform(F.sequence(F.lit(0), n_minor - 1), lambda i: F.struct(
        i.alias("i"), (-1 - F.col("home")).alias("j"), F.lit(0).alias("role")))
    minor_target = F.filter(minor_target, lambda s: s["i"] != F.col("home"))
    major_target = F.transform(F.sequence(F.lit(0), n_minor - 1), lambda i: F.struct(
        i.alias("i"), F.col("home").alias("j"), F.lit(0).alias("role")))
    whole = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(2).alias("role")))
    tasks = F.when(F.col("n_all") <= block, whole).when(minor, F.concat(as_query, minor_target)).otherwise(major_target)
    spread = rows.withColumn("home", home).select("token", "node", "klass", "place", "nth", F.explode(tasks).alias("t")) \
        .join(nodes, "node").select("token", "t.i", "t.j", "t.role", "node", "klass", "place",
                                    F.slice("early", F.lit(1), F.col("nth")).alias("early"), "point")
    n = common.parallelism(members.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_groups(batches):
            token, node, klass, role = (t[c].to_numpy() for c in ("token", "node", "klass", "role"))
            in_bucket = Bucketed(klass, _decoded(t["point"]), t["place"].to_numpy().astype(np.int64),
                                 common.list_values(t["early"]))
            start = np.append(_starts(t), len(token))
            size, start = np.diff(start), start[:-1]
            small = size <= LEAF
            a, b = search_leaves(in_bucket, start[small], size[small], percent)
            found, cuts = [_pairs_of(node, a, b)], []
            for k, n in zip(start[~small], size[~small]):
                at = np.arange(k, k + n)
                a, b, cut = search_tree(in_bucket, at, role[at], reach, percent)
                found.append(_pairs_of(node, a, b))
                if cut:
                    cuts.append(token[k])
            pairs = np.unique(np.concatenate([np.stack(x, 1) for x in found]), axis=0)
            none = [None] * len(pairs)
            yield common.out_batch(_PAIR, a=pairs[:, 0], b=pairs[:, 1], cut=none)
            if cuts:
                none = [None] * len(cuts)
                yield common.out_batch(_PAIR, a=none, b=none, cut=cuts)

    return spread.repartition(n, "token", "i", "j").sortWithinPartitions("token", "i", "j") \
        .mapInArrow(run, "a long, b long, cut long")


def _starts(t: pa.Table) -> np.ndarray:
    """First rows of the (token, i, j) groups of sorted rows."""
    keys = np.stack([t[c].to_numpy().astype(np.int64) for c in ("token", "i", "j")], 1)
    return np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(1)))


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows again, cut only between (token, i, j) groups."""
    held = None
    for b in batches:
        if b.num_rows:
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t])
            last = int(_starts(t)[-1])
            if last:
                yield t.slice(0, last)
            held = t.slice(last)
    if held is not None:
        yield held


def sets_of(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(node, shingles) of the documents with these (id) rows: sorted hashes."""
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text"):
            first, h = shingles(b.column(1), k)
            yield common.out_batch(schema, node=_nodes(first, h), shingles=pa.array(
                [np.sort(h[a:z]).tobytes() for a, z in zip(first, first[1:])], pa.binary()))

    # a repeated id may stand for several texts, so sets come out by node
    return docs.join(_small(ids, ids.count()), "id", "left_semi").mapInArrow(run, "node long, shingles binary")


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the pairs whose whole sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common_ = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common_ >= percent * (len(both) - common_))
            keep = pa.array(ok, pa.bool_())
            yield common.out_batch(schema, a=b.column(0).filter(keep), b=b.column(1).filter(keep))

    one = sets.groupBy("node").agg(F.first("shingles").alias("shingles"))
    both = pairs.select("a", "b").join(one.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a") \
        .join(one.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def classes(links: DataFrame) -> DataFrame:
    """(node, klass) of every node with a link: the smallest node reachable, by
    alternating star contraction (each round written once)."""
    edges = links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()
    while True:
        both = edges.unionAll(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        # large star: a node's larger neighbours go to its smallest neighbour
        large = edges.select(F.col("u").alias("c"), F.col("v").alias("x")) \
            .join(low.withColumnRenamed("v", "c"), "c").select(F.col("x").alias("v"), F.col("m").alias("u")).distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u") \
            .unionAll(least.select("v", F.col("m").alias("u"))).distinct()
        edges = common.stored(small, "classes")
        # done when every node hangs on one root, which hangs on nothing
        ends = edges.select(F.col("v").alias("x"), F.lit(1).alias("below"), F.lit(0).alias("above")) \
            .unionAll(edges.select("u", F.lit(0), F.lit(1)))
        per = ends.groupBy("x").agg(F.sum("below").alias("below"), F.max("above").alias("above"))
        if per.where("below > 1 or (below > 0 and above > 0)").isEmpty():
            return edges.select(F.col("v").alias("node"), F.col("u").alias("klass")) \
                .unionAll(edges.select(F.col("u").alias("node"), F.col("u").alias("klass")).distinct())


def jaccard_classes(docs: DataFrame, k: int = K, percent: int = PERCENT, id: str = "doc_id", text: str = "text",
                    block: int = BLOCK) -> DataFrame:
    """(id, n, klass) of every row: number of distinct shingles and the
    smallest id of its class."""
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    profiles = common.stored(profile(docs, k), "profiles")
    rows = profiles.where("n is not null")
    prefix_rows = common.stored(prefixes(docs, sketch_of(profiles), k, percent), "prefixes")
    found = common.stored(buckets(prefix_rows), "buckets")
    nodes = rows.join(_small(found.select("node"), found.count()), "node", "left_semi") \
        .groupBy("node").agg(F.min("id").alias("id"), F.first("point").alias("point")) \
        .join(found.select("node", F.slice("tokens.token", 1, EARLIER).alias("early")), "node")
    links = _all_links(docs, common.stored(nodes, "nodes"), found, k, percent, block)
    of_node = rows.select("id", "n", "node")
    if links is not None:
        klass = classes(links)
        of_node = of_node.join(klass, "node", "left").withColumn("klass", F.coalesce("klass", "node"))
    else:
        of_node = of_node.withColumn("klass", F.col("node"))
    first = of_node.where("n > 0").groupBy("klass").agg(F.min("id").alias("first"))
    return of_node.join(first, "klass", "left").select(
        "id", "n", F.when(F.col("n") > 0, F.col("first")).otherwise(F.col("id")).alias("klass"))


def _all_links(docs: DataFrame, nodes: DataFrame, found: DataFrame, k: int, percent: int, block: int) -> DataFrame | None:
    """Links that connect every class; None without any."""
    found = found.select("node", "n", F.size("tokens").alias("degree"), F.posexplode("tokens").alias("nth", "t")) \
        .select("t.token", "node", "n", "t.place", "nth", "degree")
    hubs = found.groupBy("token").agg(F.max_by(F.struct("node", "n"), F.struct("degree", "node")).alias("hub"))
    star = found.join(hubs, "token").where("hub.node <> node") \
        .where(F.least("hub.n", "n") * 100 >= F.greatest("hub.n", "n") * percent) \
        .select(F.least("hub.node", "node").alias("a"), F.greatest("hub.node", "node").alias("b"))
    found = found.select("token", "node", "place", "nth")
    spark = docs.sparkSession
    links, tested, sets, reach = *(common.Growing(spark, n) for n in ("links", "pairs", "sets")), REACH
    pairs = tested.add(_bounded(star.distinct(), nodes, percent))
    while True:
        if not pairs.isEmpty():
            ends = common.stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "ends")
            new = ends.join(sets.all().select("node"), "node", "left_anti") if sets.paths else ends
            ids = common.stored(nodes.select("node", "id").join(new, "node").select("id").distinct(), "ids")
            sets.add(sets_of(docs, ids, k))
            # only the sets of this round's pairs are shuffled
            links.add(verify(pairs, sets.all().join(_small(ends, ends.count()), "node", "left_semi"), percent))
        # classes so far; of the buckets, only those with several classes and,
        # after the first search, with pairs that were not named yet
        klass = common.stored(classes(links.all()), "klass") if links.paths and not links.all().isEmpty() else None
        members = found if klass is None else found.join(klass, "node", "left")
        members = members.withColumn("klass", F.coalesce("klass", "node") if klass is not None else F.col("node"))
        open_ = members.groupBy("token").agg(F.min("klass").alias("lo"), F.max("klass").alias("hi")).where("lo <> hi")
        open_ = common.stored(open_.select("token"), "open")
        members = common.stored(members.join(_small(open_, open_.count()), "token"), "members")
        ends = members.select("node").distinct()
        of_members = nodes.select("node", "point", "early").join(_small(ends, ends.count()), "node", "left_semi")
        named = common.stored(search_buckets(members, of_members, reach, percent, block), "named")
        found = members.join(named.where("cut is not null").select(F.col("cut").alias("token")).distinct(), "token") \
            .select("token", "node", "place", "nth")
        fresh = named.where("a is not null").select("a", "b").distinct()
        pairs = tested.add(fresh.join(tested.all(), ["a", "b"], "left_anti"))
        if pairs.isEmpty() and named.where("cut is not null").isEmpty():
            break
        reach *= 4
    return links.all()


def _bounded(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose points allow a link (sum of coordinate minima)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _decoded(b.column(2)), _decoded(b.column(3))
            keep = pa.array((100 + percent) * np.minimum(x, y).sum(1) >= percent * (x.sum(1) + y.sum(1)))
            yield common.out_batch(schema, a=b.column(0).filter(keep), b=b.column(1).filter(keep))

    p = nodes.select(F.col("node"), "point")
    both = pairs.join(p.select(F.col("node").alias("a"), F.col("point").alias("x")), "a") \
        .join(p.select(F.col("node").alias("b"), F.col("point").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def one_of_each(docs: DataFrame, k: int = K, percent: int = PERCENT, id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """The documents, all columns, without those of a class but its smallest id
    (rows that share an id stay or go together)."""
    gone = common.stored(jaccard_classes(docs, k, percent, id, text).where("id <> klass")
                         .select(F.col("id").alias(id)).distinct(), "gone")
    return docs.join(_small(gone, gone.count()), id, "left_anti")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents by 4-word shingles and a similarity of 0.85."""
    return jaccard_classes(common.read(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("klass").alias("component_id"))


ORACLE = r"""
with recursive word as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
  from documents),
shingle as (
  select distinct doc_id, array_to_string(w[i:i + 3], ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as i from word where len(w) > 0)),
size as (select doc_id, count(*) as n from shingle group by doc_id),
link as (
  select a.doc_id as x, b.doc_id as y
  from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id
  join size p on p.doc_id = a.doc_id join size q on q.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, p.n, q.n
  having 100 * count(*) >= 85 * (p.n + q.n - count(*))),
reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select reach.doc_id, link.y from reach join link on link.x = reach.r)
select d.doc_id, cast(coalesce(s.n, 0) as bigint) as n_shingles, min(reach.r) as component_id
from documents d left join size s using (doc_id) join reach using (doc_id)
group by d.doc_id, s.n
"""
