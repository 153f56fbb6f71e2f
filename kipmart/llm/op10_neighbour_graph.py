"""Approximate nearest neighbours (operator 10): NN-descent, greedy graph search.

*Nodes.* Equal vectors are one node, whatever their number (told apart by 128 bits
of hash); a node is expanded to its rows of the smallest ids at the end. So a group
of copies takes no room in neighbour lists, and its ties go to the smaller ids exactly.

*Parts.* A node is in the cell of the nearest of some centres, fitted to a bounded sample
of the nodes (k-means), one for each ``block`` nodes; a cell of more than twice that is
dealt into several parts by a hash.
Every node is in one part; a vector is shuffled to its part once, and a part is
worked on by one task in arrays.

*Build.* Vectors are scaled to length 1. The start graph of a part comes from trees of
planes between random nodes (more trees for more nodes), which cut on to leaves;
inside a leaf each node takes its nearest (a matrix product). Then NN-descent: each
round joins every node with its neighbours and (the nearest) reverse neighbours,
compares the members of each such neighbourhood with each other, and gives each
member the better of them. A pair is compared again only if one of its two edges
came in the round before. Rounds go on until no more than the share ``least`` of all
edges changes.

*Search.* A query goes to the cells of the nearest centres.
In a part it starts from its own neighbours, if it is there, and the best of some
entry nodes, and walks greedily: each round expands the best unexpanded candidates
(half a pool), scores their neighbours, and keeps the best candidates; it ends when
no unexpanded candidate is left. ``pool`` is shared out to the cells that are
visited, at first with ``CELL_POOL`` each if there are as many cells. How large a pool
is needed depends on the vectors: a sample of 200 queries is compared with all nodes,
and while less than the share ``recall`` of their nearest is found, they search again
with twice as many cells and with twice the pool in each, and the way that finds more
is gone on with, in the end to all parts with all nodes as entries. Then all queries
search that way.
Scores of the result are computed on the original vectors in double precision.
``exhaustive=True`` compares the queries with all nodes in blocks instead, so nothing
is missed.

Joins carry ids; vectors are shuffled with their node or query only. A neighbourhood
has at most ``2 * degree`` members, the caps that define NN-descent; it is an
approximate search by nature, and its recall is measured in the tests.

Defined cases: null, zero and non-finite vectors (or ones with a null
component) take no part, neither do vectors whose length differs from the most
usual one; rows that share an id are rows of their own, each a candidate and,
if the id is asked for, a query; ties go to the smaller id; a query row is never
its own result; fewer candidates than asked are all returned; empty tables give
an empty result; other columns are not read. Vectors of one direction but other
lengths are nodes of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kipmart.llm import common

DEGREE, BLOCK_ROWS, LEAF_ROWS, LEAST = 32, 16384, 512, 0.01
POOL, RECALL = 256, 0.95
#: Candidates kept in a cell as long as the pool doesn't reach for all cells.
CELL_POOL = 32
#: Queries that are also compared with every node, to choose the pool.
SAMPLE = 200
#: Nodes that the centres are fitted to, a cell and in all, and rounds of fitting.
FIT_ROWS, MOST_FIT_ROWS, FIT_ROUNDS = 256, 1 << 16, 10
#: Rows of a result gathered before they leave a task.
OUT_ROWS = 1 << 16
#: Better edges gathered before they are merged with the lists.
MERGE_ROWS = 1 << 21
#: Tasks of a step with a task for each part.
MOST_TASKS = 4096


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(row, id, v) of the rows that take part, as arrays of doubles (or floats, if
    they are); ``row`` numbers them."""
    kind = vectors.select(F.col(vector)).schema[0].dataType.simpleString()
    v = F.col(vector).cast("array<float>" if kind == "array<float>" else "array<double>")
    ok = (F.col(id).isNotNull() & v.isNotNull() & (F.size(v) > 0)
          & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
          & F.exists(v, lambda x: x != 0))
    rows = vectors.where(ok).select(F.col(id).cast("long").alias("id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), "s").limit(1).select("s")
    return rows.withColumn("row", F.monotonically_increasing_id()) \
        .join(F.broadcast(size), F.size("v") == F.col("s")).select("row", "id", "v")


def _arrays(column) -> np.ndarray:
    """A column of equally long lists as rows, in its own precision."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    # the largest component first, so that no square overflows or vanishes
    v = v / np.abs(v).max(1, keepdims=True)
    return (v / np.sqrt((v * v).sum(1, keepdims=True))).astype("<f4")


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(x), [
        None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int64) * width), pa.py_buffer(x)]).cast(pa.binary())


def _prepared(rows: DataFrame) -> DataFrame:
    """(id, u): unit vectors as bytes."""
    schema = pa.schema([("id", pa.int64()), ("u", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield common.out_batch(schema, id=b.column(0), u=_binary(_unit(_arrays(b.column(1)))))

    return rows.select("id", "v").mapInArrow(run, "id long, u binary")


def _matrix(column, kind: str = "<f4") -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), kind).reshape(len(values), -1)


_EDGE = pa.schema([("src", pa.int64()), ("dst", pa.int64()), ("sim", pa.float32())])
#: (query_id, id, score): a query's candidate.
_PAIR = pa.schema([("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.float64())])
PAIR = "query_id long, id long, score double"


def _edges(held: list[tuple], schema: pa.Schema = _EDGE) -> pa.RecordBatch:
    return common.out_batch(schema, **{f.name: np.concatenate(c) for f, c in zip(schema, zip(*held))})


def _gathered(parts: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many small blocks in batches of some size."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= OUT_ROWS:
            yield _edges(held, schema)
            held, n = [], 0
    if n:
        yield _edges(held, schema)


# cells and parts


@dataclass
class Cells:
    """The cells of the nearest centre."""

    centres: np.ndarray
    #: A cell's parts are numbered from first[cell] to first[cell + 1] - 1.
    first: np.ndarray

    def _blocks(self, u: np.ndarray) -> Iterator[np.ndarray]:
        """How near the centres are, some rows at a time."""
        rows = max(1, (1 << 22) // len(self.centres))
        return (u[a:a + rows] @ self.centres.T for a in range(0, len(u), rows))

    def of(self, u: np.ndarray) -> np.ndarray:
        if len(self.centres) == 1:
            return np.zeros(len(u), np.int64)
        return np.concatenate([near.argmax(1) for near in self._blocks(u)])

    def visited(self, u: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each vector visits, the nearest ones."""
        cells = len(self.centres)
        if probes >= cells:
            return np.tile(np.arange(cells), (len(u), 1))
        return np.concatenate([np.argpartition(-near, probes - 1, axis=1)[:, :probes] for near in self._blocks(u)])


def fitted(x: np.ndarray, cells: int, seed: int = 3) -> Cells:
    """Centres of the rows, unit vectors, by k-means."""
    cells = max(1, min(cells, len(x)))
    found = Cells(np.zeros((1, 1), "<f4"), np.arange(cells + 1))
    if cells > 1:
        found.centres = x[np.random.RandomState(seed).choice(len(x), cells, replace=False)]
        for _ in range(FIT_ROUNDS):
            at = found.of(x)
            order = np.argsort(at, kind="stable")
            here, start = np.unique(at[order], return_index=True)
            centres = found.centres.copy()  # one that is nearest to none stays
            centres[here] = np.add.reduceat(x[order], start)
            found.centres = centres / np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), np.float32(1e-9))
    return found


def cells_of(nodes: DataFrame, n: int, block: int) -> Cells:
    """The cells of ``n`` nodes, and how many parts each has."""
    wanted = max(1, -(-n // block))
    if wanted == 1:
        return fitted(np.zeros((0, 1), "<f4"), 1)
    # a bounded sample comes to the driver
    some = nodes.where(common.hash_sample("id", n, min(FIT_ROWS * wanted, MOST_FIT_ROWS)))
    rows = sorted(_prepared(some).collect(), key=lambda r: r["id"])
    cells = fitted(np.frombuffer(b"".join(r["u"] for r in rows), "<f4").reshape(len(rows), -1), wanted)
    schema = pa.schema([("cell", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(cells.first) - 1, np.int64)
        for b in batches:
            if b.num_rows:
                found += np.bincount(cells.of(_unit(_arrays(b.column(0)))), minlength=len(found))
        yield common.out_batch(schema, cell=np.arange(len(found)), n=found)

    counts = nodes.select("v").mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    parts = np.ones(len(cells.first) - 1, np.int64)
    for r in counts:
        parts[r["cell"]] = max(1, -(-r["n"] // (2 * block)))
    cells.first = np.concatenate([[0], np.cumsum(parts)])
    return cells


# the graph of a part: arrays of node places, where n stands for none


def _nearest(ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest others of each row of a block."""
    sim = x @ x.T
    np.fill_diagonal(sim, -2)
    k = min(k, len(ids) - 1)
    if k < 1:
        return ids[:0], ids[:0], np.zeros(0, np.float32)
    at = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[at.ravel()], np.take_along_axis(sim, at, 1).ravel()


@dataclass
class Lists:
    """The best edges of each node, nearest first."""

    to: np.ndarray
    sim: np.ndarray
    fresh: np.ndarray

    def edges(self) -> tuple[np.ndarray, ...]:
        src, at = np.nonzero(self.to < len(self.to))
        return src, self.to[src, at], self.sim[src, at], self.fresh[src, at]


def _best(n: int, k: int, src: np.ndarray, dst: np.ndarray, sim: np.ndarray, fresh: np.ndarray) -> Lists:
    """The k best distinct edges of each node, ties to the smaller place; an edge
    that is there twice is as old as its older one."""
    # an edge in one number, so that sorting takes no comparisons of several arrays
    bits = np.uint64(max(1, int(n).bit_length()))
    room = np.uint64(min(32, 62 - 2 * int(bits)))
    one, most = np.uint64(1), (1 << int(room)) - 1
    near = ((np.clip(sim, -1, 1).astype(np.float64) + 1) * (most / 2)).astype(np.uint64)
    key = np.sort(((((src.astype(np.uint64) << bits) | dst.astype(np.uint64)) << one) | fresh.astype(np.uint64)) << room | near)
    pair = key >> (room + one)
    key = key[np.append(True, pair[1:] != pair[:-1])] if len(key) else key
    src, far = key >> (room + one + bits), np.uint64(most) - (key & np.uint64(most))
    edge = (key >> room) & np.uint64((1 << (int(bits) + 1)) - 1)  # node and age
    key = np.sort((src << room | far) << (bits + one) | edge)
    src = (key >> (room + bits + one)).astype(np.int64)
    rank = np.arange(len(key)) - np.searchsorted(src, np.arange(n))[src]
    key, src, rank = key[rank < k], src[rank < k], rank[rank < k]
    out = Lists(np.full((n, k), n, np.int32), np.full((n, k), -2, np.float32), np.zeros((n, k), bool))
    out.to[src, rank] = ((key >> one) & np.uint64((1 << int(bits)) - 1)).astype(np.int32)
    out.sim[src, rank] = 1 - ((key >> (bits + one)) & np.uint64(most)).astype(np.float64) * (2 / most)
    out.fresh[src, rank] = (key & one).astype(bool)
    return out


def _leaves(at: np.ndarray, x: np.ndarray, leaf: int, random: np.random.RandomState) -> Iterator[np.ndarray]:
    """Parts of at most ``leaf`` rows, halved by the plane between two random rows."""
    todo = [at]
    while todo:
        at = todo.pop()
        if len(at) <= leaf:
            yield at
            continue
        a, b = random.choice(len(at), 2, replace=False)
        half = np.argsort(x[at] @ (x[at[a]] - x[at[b]]), kind="stable")
        todo += [at[half[:len(at) // 2]], at[half[len(at) // 2:]]]


def start_graph(x: np.ndarray, degree: int, leaf: int, seed: int = 3) -> Lists:
    """Edges to the nearest inside leaves. One tree for each halving that leads from
    all nodes to a leaf, at least 4."""
    trees = max(4, int(np.ceil(np.log2(max(len(x), 1) / leaf))))
    found = [_nearest(at, x[at], max(4, degree // 4)) for t in range(trees)
             for at in _leaves(np.arange(len(x)), x, leaf, np.random.RandomState(seed + 1 + t))]
    src, dst, sim = (np.concatenate(c) for c in zip(*found))
    return _best(len(x), degree, src, dst, sim, np.ones(len(src), bool))


def _neighbourhoods(graph: Lists) -> tuple[np.ndarray, np.ndarray]:
    """Each node's neighbours and nearest reverse neighbours once, those of no node
    last, and whether one of these edges is fresh."""
    src, dst, sim, fresh = graph.edges()
    n, k = graph.to.shape
    back = _best(n, k, dst, src, sim, fresh)
    both = np.sort(np.hstack([graph.to, back.to]).astype(np.int64) << 1 | ~np.hstack([graph.fresh, back.fresh]), axis=1)
    members, fresh = both >> 1, (both & 1) == 0
    again = np.zeros_like(fresh)
    again[:, 1:] = members[:, 1:] == members[:, :-1]
    members[again | (members == n)], fresh[again | (members == n)] = n, False
    order = np.argsort(members, axis=1, kind="stable")
    return np.take_along_axis(members, order, 1), np.take_along_axis(fresh, order, 1)


def descend(graph: Lists, x: np.ndarray) -> Lists:
    """One round: better edges found in neighbourhoods, merged with the graph;
    only edges that were not in it are ``fresh`` in the result."""
    n, degree = graph.to.shape
    members, fresh = _neighbourhoods(graph)
    src, dst, sim, new = graph.edges()
    best = Lists(graph.to, graph.sim, np.zeros_like(graph.fresh))
    held, count = [(dst[new], src[new], sim[new])], 0

    def merged() -> Lists:
        old, found = best.edges(), [np.concatenate(c) for c in zip(*held)]
        return _best(n, degree, *(np.concatenate(c) for c in zip(old, (*found, np.ones(len(found[0]), bool)))))

    padded = np.vstack([x, np.zeros((1, x.shape[1]), x.dtype)])
    worst = np.append(best.sim[:, -1], np.float32(9))  # lists that aren't full take any
    live = np.flatnonzero(fresh.any(1))
    width = (members < n).sum(1)
    live = live[np.argsort(width[live], kind="stable")]
    for a in range(0, len(live), 256):
        mid = live[a:a + 256]
        wide = int(width[mid[-1]])
        m, f = members[mid, :wide], fresh[mid, :wide]
        v = padded[m]
        s = np.matmul(v, v.transpose(0, 2, 1))
        ok = s > worst[m][:, :, None]
        ok &= f[:, :, None] | f[:, None, :]
        ok[:, np.arange(wide), np.arange(wide)] = False
        at = np.flatnonzero(ok)
        one, other = at // wide, at // (wide * wide) * wide + at % wide
        one, other, s = m.ravel()[one], m.ravel()[other], s.ravel()[at]
        real = other < n
        held.append((one[real], other[real], s[real]))
        count += len(at)
        if count >= MERGE_ROWS:
            best, held, count = merged(), [], 0
            worst[:n] = best.sim[:, -1]
    return merged() if held else best


def linked(x: np.ndarray, degree: int, leaf: int, least: float) -> np.ndarray:
    """Each node's neighbours and nearest reverse neighbours, by NN-descent."""
    graph = start_graph(x, degree, leaf)
    while True:
        graph = descend(graph, x)
        if graph.fresh.sum() <= least * degree * len(x):
            break
    links = _neighbourhoods(graph)[0]
    return links[:, :max(1, int((links < len(x)).sum(1).max()))]


def walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, pool: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, node, sim) of the best ``pool`` nodes that each query finds, nearest
    first. ``own``: a query's place among the nodes or -1; it isn't found."""
    n = len(x)
    entries = np.unique(np.linspace(0, n - 1, min(n, max(pool, int(np.sqrt(n)) + 1))).astype(np.int64))
    few = max(1, (1 << 20) // (n + 1))
    for a in range(0, len(q), few):
        yield from _walk(x, links, q[a:a + few], own[a:a + few], pool, entries, a)


def _walk(x: np.ndarray, links: np.ndarray, q: np.ndarray, own: np.ndarray, pool: int, entries: np.ndarray, base: int) -> Iterator[tuple]:
    n, rows = len(x), np.arange(len(q))[:, None]
    home = np.flatnonzero(own >= 0)
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    seen[home, own[home]] = True
    flat = seen.ravel()

    def scored_new(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of (query * (n + 1) + node) not seen before, and their similarities."""
        pairs = np.sort(pairs[~flat[pairs]])
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        flat[pairs] = True
        node, sim = pairs % (n + 1), np.empty(len(pairs), np.float32)
        edge = np.searchsorted(pairs, np.arange(len(q) + 1) * (n + 1))
        for i in np.flatnonzero(np.diff(edge)):
            sim[edge[i]:edge[i + 1]] = x[node[edge[i]:edge[i + 1]]] @ q[i]
        return pairs, sim

    def kept(node: np.ndarray, sim: np.ndarray, done: np.ndarray) -> tuple[np.ndarray, ...]:
        if sim.shape[1] > pool:
            at = np.argpartition(-sim, pool - 1, axis=1)[:, :pool]
            node, sim, done = (np.take_along_axis(c, at, 1) for c in (node, sim, done))
        at = np.argsort(-sim, axis=1, kind="stable")
        return tuple(np.take_along_axis(c, at, 1) for c in (node, sim, done))

    def added(found: tuple[np.ndarray, ...], pairs: np.ndarray, sim: np.ndarray) -> tuple[np.ndarray, ...]:
        query = pairs // (n + 1)
        if found[1].shape[1] >= pool:
            better = sim > found[1][query, -1]
            pairs, sim, query = pairs[better], sim[better], query[better]
        if not len(pairs):
            return found
        start = np.searchsorted(query, rows.ravel())
        at = np.arange(len(query)) - start[query]
        shape = (len(q), int(at.max()) + 1)
        node, near = np.full(shape, n, np.int64), np.full(shape, -2, np.float32)
        node[query, at], near[query, at] = pairs % (n + 1), sim
        return kept(*(np.hstack(c) for c in zip(found, (node, near, node == n))))

    sim = q @ x[entries].T
    sim[seen[:, entries]] = -2
    seen[:, entries] = True
    node = np.where(sim > -1.5, entries[None], n)
    found = kept(node, sim, node == n)
    found = added(found, *scored_new((home[:, None] * (n + 1) + links[own[home]]).ravel()))
    while True:
        node, sim, done = found
        grow = ~done & (np.cumsum(~done, axis=1) <= max(1, pool // 2))
        query, at = np.nonzero(grow)
        if not len(query):
            break
        done |= grow
        found = added(found, *scored_new((query[:, None] * (n + 1) + links[node[query, at]]).ravel()))
    query, at = np.nonzero(node < n)
    yield base + query, node[query, at], sim[query, at]


# graph and search over all parts


#: A part in one row: its number, ids, vectors and links as bytes.
PART = "part long, n long, ids binary, v binary, links binary"


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """(part, its batches) of rows sorted by their first column."""
    held: list[pa.RecordBatch] = []
    key = None
    for b in batches:
        if not b.num_rows:
            continue
        part = b.column(0).to_numpy()
        edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
        for a, z in zip(edge, edge[1:]):
            if held and part[a] != key:
                yield key, held
                held = []
            key = int(part[a])
            held.append(b.slice(a, z - a))
    if held:
        yield key, held


def _dealt(rows: DataFrame, cells: Cells, *order: str) -> DataFrame:
    """The rows of a part together, in as many tasks as there are parts."""
    n = int(min(cells.first[-1], MOST_TASKS))
    return rows.repartitionById(n, F.pmod(F.col("part"), F.lit(n)).cast("int")).sortWithinPartitions("part", *order)


def build(nodes: DataFrame, cells: Cells, degree: int = DEGREE, leaf: int = LEAF_ROWS, least: float = LEAST) -> DataFrame:
    """The parts of (id, v) nodes, each with its neighbour graph, as ``PART`` rows."""
    placed = pa.schema([("part", pa.int64()), ("id", pa.int64()), ("v", pa.binary())])
    made = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("links", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _arrays(b.column(1))
                cell = cells.of(_unit(v))
                share = b.column(2).to_numpy() % (cells.first[cell + 1] - cells.first[cell])
                yield common.out_batch(placed, part=cells.first[cell] + share, id=b.column(0), v=_binary(v))

    kind = _kind(nodes)

    def graph(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, held in _by_part(batches):
            t = pa.Table.from_batches(held)
            ids, v = t["id"].to_numpy(), _matrix(t["v"], kind)
            order = np.argsort(ids)
            ids, v = ids[order], v[order]
            links = linked(_unit(v), degree, leaf, least).astype(_place(len(ids)))
            yield common.out_batch(made, part=[part], n=[len(ids)], ids=[ids.astype("<i8").tobytes()], v=[v.tobytes()], links=[links.tobytes()])
            common.release()

    rows = nodes.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(1 << 30)).alias("h")) \
        .mapInArrow(place, "part long, id long, v binary")
    return common.stored(_dealt(rows, cells).mapInArrow(graph, PART), "graph")


def _kind(rows: DataFrame) -> str:
    return "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def _place(n: int) -> str:
    return "<u2" if n < 1 << 16 else "<u4"


class Part:
    """A part's arrays, out of its row."""

    def __init__(self, n: int, ids: bytes, v: bytes, links: bytes, kind: str) -> None:
        self.ids, self.v = np.frombuffer(ids, "<i8"), np.frombuffer(v, kind).reshape(n, -1)
        self.links = np.frombuffer(links, _place(n)).reshape(n, -1).astype(np.int64)
        self.u = _unit(self.v)

    def found(self, ids: np.ndarray, v: np.ndarray, k: int, pool: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(query_id, id, score): the nodes that may be among the k nearest: the k best found
        by float32 similarity and those within the margin, with the cosine in double precision."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.where(self.ids[at] == ids, at, -1)
        for query, node, sim in walk(self.u, self.links, _unit(v), own, pool):
            start = np.flatnonzero(np.diff(query, prepend=-1))
            size = np.diff(np.append(start, len(query)))
            edge = np.repeat(np.where(size >= k, sim[np.minimum(start + k, start + size) - 1], -2), size)
            near = sim >= edge - MARGIN
            query, node = query[near], node[near]
            yield ids[query], self.ids[node], _cosine(v[query], self.v[node])


def _cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(np.float64), y.astype(np.float64)
    dot, nx, ny = ((p * q).sum(1) for p, q in ((x, y), (x, x), (y, y)))
    return dot / (np.sqrt(nx) * np.sqrt(ny))


def search(graph: DataFrame, cells: Cells, points: DataFrame, queries: DataFrame, k: int, pool: int = POOL,
           recall: float = RECALL) -> DataFrame:
    """(query_id, id, score) candidates of (query_id, v) rows that are nodes; ``pool`` is
    doubled until the sampled queries find the share ``recall`` of their k nearest."""
    sample = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(SAMPLE).collect()
    if not sample:
        return queries.sparkSession.createDataFrame([], PAIR)
    kind = _kind(queries)
    ids, v = np.array([r["query_id"] for r in sample]), np.array([r["v"] for r in sample], kind)
    truth = _true(points, ids, _unit(v), k)
    wanted = recall * sum(map(len, truth.values()))
    cell_count, largest = len(cells.first) - 1, graph.agg(F.max("n")).first()[0]
    probes = int(np.clip(pool // CELL_POOL, 1, cell_count))
    ways = [(probes, max(k, -(-pool // probes)))]
    while recall > 0 and ways:
        found = [sum(len(truth[q] & got.get(q, set())) for q in truth) for got in _sampled(graph, cells, ids, v, k, ways)]
        probes, each = ways[int(np.argmax(found))]
        if max(found) >= wanted:
            ways = [(probes, each)]
            break
        ways = [(min(2 * probes, cell_count), each)] * (probes < cell_count) + [(probes, 2 * each)] * (each < largest)
    probes, each = ways[0] if ways else (probes, each)
    return _searched(graph, cells, queries, k, probes, each)


def _first(pairs: DataFrame, by: str, k: int, ways: int = 1) -> list[dict[int, set[int]]]:
    """The k best of a few queries, for each way of searching."""
    w = W.partitionBy("way", "query_id").orderBy(F.desc(by), "id")
    out: list[dict[int, set[int]]] = [{} for _ in range(ways)]
    for r in pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("way", "query_id", "id").collect():
        out[r["way"]].setdefault(r["query_id"], set()).add(r["id"])
    return out


def _true(points: DataFrame, ids: np.ndarray, u: np.ndarray, k: int) -> dict[int, set[int]]:
    """The k nearest of all nodes to a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                nodes, x = b.column(0).to_numpy(), _matrix(b.column(1))
                for a in range(0, len(nodes), 8192):
                    yield _edges([_near(ids, u, nodes[a:a + 8192], x[a:a + 8192], k)]).rename_columns(["query_id", "id", "sim"])

    return _first(points.mapInArrow(run, "query_id long, id long, sim float").withColumn("way", F.lit(0)), "sim", k)[0]


def _sampled(graph: DataFrame, cells: Cells, ids: np.ndarray, v: np.ndarray, k: int,
             ways: list[tuple[int, int]]) -> list[dict[int, set[int]]]:
    """What a few queries find by the walk of ``_searched``, for each (probes, pool)."""
    visits = np.zeros((len(ways), len(ids), len(cells.first) - 1), bool)
    for visit, (probes, _) in zip(visits, ways):
        np.put_along_axis(visit, cells.visited(_unit(v), probes), True, axis=1)
    kind = v.dtype.str
    schema = pa.schema([*_PAIR, ("way", pa.int32())])

    def walks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for r in b.to_pylist():
                asked = visits[:, :, np.searchsorted(cells.first, r["part"], "right") - 1]
                if asked.any():
                    here = Part(r["n"], r["ids"], r["v"], r["links"], kind)
                    for w in np.flatnonzero(asked.any(1)):
                        for found in here.found(ids[asked[w]], v[asked[w]], k, ways[w][1]):
                            yield *found, np.full(len(found[0]), w, np.int32)

    return _first(graph.mapInArrow(lambda b: _gathered(walks(b), schema), PAIR + ", way int"), "score", k, len(ways))


def _searched(graph: DataFrame, cells: Cells, queries: DataFrame, k: int, probes: int, pool: int) -> DataFrame:
    """Each query's candidates, from the parts that it visits."""
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("ids", pa.binary()), ("v", pa.binary()), ("links", pa.binary()), ("query_id", pa.int64())])
    kind = _kind(queries)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                some = b.slice(a, 1024)
                ids, v = some.column(0).to_numpy(), _arrays(some.column(1))
                cell = cells.visited(_unit(v), probes)
                for s in range(int(np.diff(cells.first).max())):  # the cell's s-th part
                    at, to = np.nonzero(cells.first[cell] + s < cells.first[cell + 1])
                    part = cells.first[cell[at, to]] + s
                    for z in range(0, len(at), 8192):
                        i, none = at[z:z + 8192], pa.nulls(len(at[z:z + 8192]), pa.binary())
                        yield common.out_batch(schema, part=part[z:z + 8192], n=pa.nulls(len(i), pa.int64()), ids=none,
                                               v=_binary(v[i]), links=none, query_id=ids[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        here, number = None, None
        for b in batches:
            part = b.column(0).to_numpy()
            edge = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
            for a, z in zip(edge, edge[1:]):
                n = b.column(1)[a].as_py()
                if n is not None:  # the part itself comes before its queries
                    here = Part(n, *(b.column(c)[a].as_py() for c in (2, 3, 4)), kind)
                    number = part[a]
                    a += 1
                if z > a and part[a] == number:  # a part may have no node
                    yield from here.found(b.column(5).slice(a, z - a).to_numpy(), _matrix(b.column(3).slice(a, z - a), kind), k, pool)

    asked = queries.select("query_id", "v").mapInArrow(visit, PART + ", query_id long")
    rows = graph.withColumn("query_id", F.lit(None).cast("long")).unionAll(asked)
    return _dealt(rows, cells, F.col("n").isNull()) \
        .mapInArrow(lambda b: _gathered(run(b), _PAIR), PAIR)


#: Cosines of float32 vectors of length 1 are nearer than this to the exact ones.
MARGIN = 1e-4


def _near(qs: np.ndarray, y: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, sim): each query's k nearest of a block of nodes, and those as near within the margin."""
    sim = y @ x.T
    sim[qs[:, None] == ids] = -2
    edge = -np.partition(-sim, k - 1, axis=1)[:, k - 1] if len(ids) > k else np.full(len(sim), -1.5)
    at, to = np.nonzero(sim >= np.maximum(edge - MARGIN, -1.5)[:, None])
    return qs[at], ids[to], sim[at, to]


def all_nodes(points: DataFrame, queries: DataFrame, k: int, part_rows: int = 65536, query_rows: int = 4096) -> DataFrame:
    """(query_id, id, sim): each query's k nearest nodes, and those as near within
    the margin, by comparing it with every node: each part of the nodes meets each
    block of the queries once, in a task of bounded size."""
    parts = -(-points.count() // part_rows) or 1
    blocks = -(-queries.count() // query_rows) or 1
    some = points.select("id", "u", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"),
                         F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")).alias("block"))
    asked = queries.select("query_id", "u", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"),
                           F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("block"))

    def meet(nodes: pa.Table, queries: pa.Table) -> pa.Table:
        out = []
        if nodes.num_rows and queries.num_rows:
            ids, x = nodes["id"].to_numpy(), _matrix(nodes["u"])
            qs, y = queries["query_id"].to_numpy(), _matrix(queries["u"])
            out = [_near(qs[a:a + 256], y[a:a + 256], ids, x, k) for a in range(0, len(qs), 256)]
        table = pa.Table.from_batches([_edges(out)] if out else [], schema=_EDGE)
        return table.rename_columns(["query_id", "id", "sim"])

    return some.groupBy("part", "block").cogroup(asked.groupBy("part", "block")) \
        .applyInArrow(meet, "query_id long, id long, sim float")


def scored(found: DataFrame, nodes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): the found nodes that may be among the k nearest, with the
    cosine in double precision of the original vectors. Candidates are first cut to
    the best by float32 similarity, with a margin far above its error."""
    near = _best_of_all(found, "sim", k, MARGIN)
    pairs = near.join(nodes, "id").join(asked.select("query_id", F.col("v").alias("w")), "query_id")

    def cosine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield common.out_batch(_PAIR, query_id=b.column(0), id=b.column(1), score=_cosine(_arrays(b.column(2)), _arrays(b.column(3))))

    return pairs.select("query_id", "id", "v", "w").mapInArrow(cosine, PAIR)


def _best_of_all(pairs: DataFrame, by: str, k: int, margin: float) -> DataFrame:
    """Each query's k best pairs and those as good within the margin."""
    w = W.partitionBy("query_id").orderBy(F.desc(by), "id")
    return pairs.withColumn("rank", F.row_number().over(w)).withColumn(
        "edge", F.max(F.when(F.col("rank") == k, F.col(by))).over(W.partitionBy("query_id"))) \
        .where(F.col("edge").isNull() | (F.col(by) >= F.col("edge") - margin)).drop("rank", "edge")


def of_rows(pairs: DataFrame, members: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, id, score): scored pairs of nodes as results of the query
    rows. A node stands for its k + 1 first rows, of which one may be the query."""
    first = W.partitionBy("node").orderBy("id", "row")
    few = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).drop("n")
    best = W.partitionBy("query_node").orderBy(F.desc("score"), "id", "row")
    lists = pairs.select(F.col("query_id").alias("query_node"), F.col("id").alias("node"), "score").join(few, "node") \
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1) \
        .groupBy("query_node").agg(F.array_sort(F.collect_list(F.struct("n", "row", "id", "score"))).alias("near"))
    lists = common.stored(lists, "lists")
    others = F.slice(F.filter("near", lambda x: x["row"] != F.col("query_row")), 1, k)
    return asked.select("query_id", F.col("row").alias("query_row"), F.col("node").alias("query_node")) \
        .join(lists, "query_node").select("query_id", F.posexplode(others).alias("at", "x")) \
        .select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.id").alias("id"), F.col("x.score").alias("score"))


#: Rows of numbers that are broadcast at most.
SENT_ROWS = 1 << 18


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding",
            degree: int = DEGREE, pool: int = POOL, recall: float = RECALL, block: int = BLOCK_ROWS,
            exhaustive: bool = False, **settings) -> DataFrame:
    """(query_id, rank, id, score) of the query rows against all other rows."""
    rows = common.stored(usable(vectors, id, vector), "vectors")
    keyed = rows.select("row", "id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit(1), "v").alias("g"))
    firsts = keyed.groupBy("h", "g").agg(F.min("row").alias("node"))
    members = common.stored(keyed.join(firsts, ["h", "g"]).select("node", "row", "id"), "members")
    copies = members.where("row <> node").select("row")
    n_copies, n = copies.count(), members.where("row = node").count()
    nodes = rows
    if n_copies:
        nodes = rows.join(F.broadcast(copies) if n_copies <= SENT_ROWS else copies, "row", "left_anti")
    nodes = nodes.select(F.col("row").alias("id"), "v")
    asked = members.withColumnRenamed("id", "query_id").where(is_query)
    one = asked.groupBy("node").agg(F.min("row").alias("row"))
    queries = common.stored(rows.withColumnRenamed("id", "query_id").where(is_query).join(one, "row")
                            .select(F.col("node").alias("query_id"), "v"), "queries")
    if exhaustive:
        points = common.stored(_prepared(nodes), "points")
        asked_points = _prepared(queries.withColumnRenamed("query_id", "id")).withColumnRenamed("id", "query_id")
        found = scored(all_nodes(points, common.stored(asked_points, "asked"), k), nodes, queries, k)
    elif n:
        cells = cells_of(nodes, n, block)
        found = search(build(nodes, cells, degree, **settings), cells, _prepared(nodes), queries, k, pool, recall)
        found = _best_of_all(found, "score", k, 0)
    else:
        found = vectors.sparkSession.createDataFrame([], PAIR)

    def itself(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _arrays(b.column(1))
                yield common.out_batch(_PAIR, query_id=b.column(0), id=b.column(0), score=_cosine(v, v))

    return of_rows(found.unionAll(queries.mapInArrow(itself, PAIR)), members, asked, k)


def op10_neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every 50th vector among all others."""
    found = nearest(common.read(spark, sf_dir, "embeddings"), F.col("query_id") % 50 == 0)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")
