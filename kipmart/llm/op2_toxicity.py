"""Toxicity (operator 2): a linear-chain conditional random field over words.

Two states, ordinary and toxic; a word's emission is the sum of the weights of
its hash and of the hash of its first four bytes (so inflected forms share
evidence), plus a bias; four transition weights tie neighbours together.

Labelled tokens: document labels are brought down to words. A word (or first
four bytes) is offensive when the share of toxic documents holding it is far
above the share of clean ones; in a toxic document its places are labelled toxic,
all other places are labelled ordinary. ``train`` fits the field by gradient
steps on the exact log-likelihood (forward-backward) over a bounded sample:
about ``bound`` labelled documents, picked by a hash of their id.

``tag`` gives, for every document, the score (a logistic curve on the largest
marginals and the expected number of toxic words, fitted on the same sample) and
the offending byte spans: runs of words whose marginal is at least 0.5.

The chain of a whole block of texts is handled as one sequence of 2x2 matrices
(as odds, a Moebius map each) that starts anew at each text, and is scanned in
rows of 64 steps, so forward and backward passes need no loop over words.

Defined cases: null and empty texts have no words and get the score of a text
without toxic words; without labels of both kinds, or without any offensive
word, no word is toxic; repeated rows get the same score; spans of a text are in
order and do not overlap; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common, textvec

SAMPLE = 5000
#: A feature is kept as an emission weight if this many sampled documents hold it.
LEAST_DOCUMENTS = 3
#: An offensive word occurs in this many toxic documents of the sample, and in
#: this share of them, at least (copies of one document must not make words offensive).
LEAST_TOXIC, LEAST_TOXIC_SHARE = 5, 0.01
#: Natural logarithm of (share of toxic documents) / (share of clean ones).
OFFENSIVE = 4.5
PREFIX = 4
_ROW = 64
_TABLE_BITS = 22
OUT = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("n_toxic", pa.int64()),
                 ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
_FEATURES = pa.schema([("label", pa.int32()), ("words", pa.list_(pa.int64())),
                       ("heads", pa.list_(pa.int64()))])


def _heads(buffer: np.ndarray, w: textvec.Words) -> np.ndarray:
    """Hash of the first bytes of each word (of the whole word, if shorter)."""
    h = np.zeros(len(w.start), np.uint64)
    for k in range(PREFIX):
        at = w.start + k
        byte = np.where(at < w.end, textvec.LOWER[buffer[np.minimum(at, len(buffer) - 1)]], 0) if len(buffer) else at
        h = h << np.uint64(8) | byte.astype(np.uint64)
    return textvec.mix(h + np.uint64(1))


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, word hashes, hashes of the words' heads) of (label, text) rows."""
    for b in common.blocks(batches, "text"):
        buffer, offs = common.text_buffer(b.column(1))
        w = textvec.words(buffer, offs)
        lists = [pa.ListArray.from_arrays(pa.array(w.first.astype(np.int32)), pa.array(h.view(np.int64)))
                 for h in (w.hash, _heads(buffer, w))]
        yield common.out_batch(_FEATURES, label=b.column(0), words=lists[0], heads=lists[1])


def _scan(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Odds r_t = (a_t r_{t-1} + b_t) / (c_t r_{t-1} + d_t) for all t, r_{-1} = 1."""
    n = len(a)
    if n <= _ROW:
        out, r = np.empty(n), 1.0
        for t, (p, q, u, v) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
            r = (p * r + q) / (u * r + v)
            out[t] = r
        return out
    rows = -(-n // _ROW)
    pad = rows * _ROW - n
    a, b, c, d = (np.concatenate([x, np.full(pad, e)]).reshape(rows, _ROW).T.copy()
                  for x, e in ((a, 1.0), (b, 0.0), (c, 0.0), (d, 1.0)))
    p, q, u, v = a[0].copy(), b[0].copy(), c[0].copy(), d[0].copy()
    for t in range(1, _ROW):  # the whole map of each row
        p, q, u, v = a[t] * p + b[t] * u, a[t] * q + b[t] * v, c[t] * p + d[t] * u, c[t] * q + d[t] * v
        s = 1 / np.maximum(np.maximum(p, q), np.maximum(u, v))
        p, q, u, v = p * s, q * s, u * s, v * s
    r = np.concatenate([[1.0], _scan(p, q, u, v)[:-1]])
    out = np.empty((_ROW, rows))
    for t in range(_ROW):
        r = (a[t] * r + b[t]) / (c[t] * r + d[t])
        out[t] = r
    return out.T.ravel()[:n]


def marginals(emission: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of state 1 at each word, expected moves between states at
    each word but a text's first, as rows 00 01 10 11). ``emission``: log odds
    of state 1; ``first``: first word of each text; ``move``: 2x2 log weights."""
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 4))
    e, m = np.exp(np.clip(emission, -30, 30)), np.exp(move)
    head = np.zeros(n, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    zero = np.zeros(n)
    # forward odds with the word's own emission; at a text's first word just that
    ahead = _scan(np.where(head, 0, e * m[1, 1]), np.where(head, e, e * m[0, 1]),
                  np.where(head, zero, m[1, 0]), np.where(head, 1, m[0, 0]))
    # backward odds without it, from the last word to the first
    last = np.concatenate([head[1:], [True]])
    en = np.concatenate([e[1:], [1.0]])
    back = _scan(*(np.where(last, x, y)[::-1] for x, y in (
        (0, m[1, 1] * en), (1, m[1, 0]), (0, m[0, 1] * en), (1, m[0, 0]))))[::-1]
    p = ahead * back / (1 + ahead * back)
    both = np.stack([m[0, 0] + zero[1:], m[0, 1] * e[1:] * back[1:], ahead[:-1] * m[1, 0],
                     ahead[:-1] * m[1, 1] * e[1:] * back[1:]], 1)
    both[head[1:]] = 0
    return p, both / np.maximum(both.sum(1, keepdims=True), 1e-300)


@dataclass
class ToxicityModel:
    keys: np.ndarray  # 64-bit hashes of words and heads that have a weight
    weights: np.ndarray
    bias: float
    move: np.ndarray
    curve: np.ndarray
    _slots: np.ndarray | None = field(default=None, repr=False)

    def __getstate__(self):
        return {**self.__dict__, "_slots": None}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Index of each hash among the keys; their number where it has none."""
        if self._slots is None:
            self._slots = np.full(1 << _TABLE_BITS, -1, np.int32)
            self._slots[(self.keys >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = np.arange(len(self.keys))
        if not len(self.keys):
            return np.zeros(len(hashes), int)
        at = self._slots[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
        return np.where((at >= 0) & (self.keys[at] == hashes), at, len(self.keys))

    def emission(self, words: np.ndarray, heads: np.ndarray) -> np.ndarray:
        w = np.append(self.weights, 0.0)
        return w[self.find(words)] + w[self.find(heads)] + self.bias

    def summary(self, p: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What the document score sees: largest marginal, expected number of
        toxic words (log), and their share."""
        n = len(first) - 1
        expected, size, most = textvec.sums(p, first), np.diff(first), np.zeros(n)
        full = np.flatnonzero(size)
        if len(full):
            most[full] = np.maximum.reduceat(p, first[:-1][full])
        return np.stack([most, np.log1p(expected), expected / np.maximum(size, 1), np.ones(n)], 1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(summary @ self.curve, -30, 30)))


def _document_shares(hashes: np.ndarray, of: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct hashes, documents with each, toxic ones, log ratio of shares)."""
    order = np.lexsort((of, hashes))
    h, d = hashes[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    keys, where = np.unique(h[new], return_inverse=True)
    n = np.bincount(where, minlength=len(keys))
    bad = np.bincount(where, toxic[d[new]], minlength=len(keys))
    ratio = np.log((bad + 0.1) / (toxic.sum() + 0.2)) - np.log((n - bad + 0.1) / ((~toxic).sum() + 0.2))
    return keys, n, bad, ratio


def fit(labels: np.ndarray, words: list[np.ndarray], heads: list[np.ndarray], steps: int = 25,
        rate: float = 0.3, pull: float = 1e-3) -> ToxicityModel:
    """The field of documents with these labels, word and head hashes."""
    toxic = labels.astype(bool)
    none = ToxicityModel(np.zeros(0, np.uint64), np.zeros(0), -8.0, np.zeros((2, 2)),
                         np.array([0, 0, 0, -4.0 if not toxic.all() or not len(toxic) else 4.0]))
    if toxic.all() or not toxic.any():
        return none
    size = np.array([len(w) for w in words])
    of = np.repeat(np.arange(len(size)), size)
    flat = [np.concatenate(x) for x in (words, heads)]
    offensive, keys = np.zeros(len(of), bool), []
    for h in flat:
        k, n, bad, ratio = _document_shares(h, of, toxic)
        keys.append(k[n >= LEAST_DOCUMENTS])
        least = max(LEAST_TOXIC, LEAST_TOXIC_SHARE * toxic.sum())
        offensive |= np.isin(h, k[(bad >= least) & (ratio >= OFFENSIVE)])
    model = ToxicityModel(np.unique(np.concatenate(keys)), np.zeros(0), -6.0, np.zeros((2, 2)), none.curve)
    model.weights = np.zeros(len(model.keys))
    gold_all = (offensive & toxic[of]).astype(float)
    # all toxic documents and as many clean ones train the field
    clean = np.flatnonzero(~toxic)
    used = np.sort(np.concatenate([np.flatnonzero(toxic), clean[:max(int(toxic.sum()), 200)]]))
    pick = np.isin(of, used)
    gold, first = gold_all[pick], np.concatenate([[0], np.cumsum(size[used])])
    at = [model.find(h[pick]) for h in flat]
    dim = len(model.keys) + 1
    counts = sum(np.bincount(a, minlength=dim) for a in at)
    moves = gold[1:] + 2 * gold[:-1] if len(gold) else np.zeros(0)
    inner = np.ones(max(len(gold) - 1, 0), bool)
    cut = first[1:-1]
    inner[cut[(cut > 0) & (cut < len(gold))] - 1] = False
    seen = np.bincount(moves[inner].astype(int), minlength=4).reshape(2, 2)
    theta, bias, move = np.zeros(dim), model.bias, model.move.copy()
    speed, speed_move = np.zeros(dim), np.zeros((2, 2))
    for _ in range(steps):
        p, both = marginals(theta[at[0]] + theta[at[1]] + bias, first, move)
        error = gold - p
        grad = sum(np.bincount(a, error, minlength=dim) for a in at) / np.sqrt(np.maximum(counts, 1)) - pull * theta
        grad[-1] = 0  # features without a weight
        speed += grad ** 2
        theta += 3 * rate * grad / np.sqrt(speed + 1e-8)
        bias += rate * np.clip(error.sum() / np.sqrt(max(gold.sum(), 1)), -1, 1)
        pairs = (seen - both.sum(0).reshape(2, 2)) / np.sqrt(seen + 1) - pull * move
        speed_move += pairs ** 2
        move += rate * pairs / np.sqrt(speed_move + 1e-8)
    model.weights, model.bias, model.move = theta[:-1], float(bias), move
    bounds = np.concatenate([[0], np.cumsum(size)])
    summaries = []
    for part in np.array_split(np.arange(len(size)), 1 + bounds[-1] // 200_000):
        first = bounds[part[0]:part[-1] + 2] if len(part) else bounds[:1]
        at = slice(first[0], first[-1])
        p, _ = marginals(model.emission(flat[0][at], flat[1][at]), first - first[0], move)
        summaries.append(model.summary(p, first - first[0]))
    model.curve = _logistic(np.concatenate(summaries), toxic)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, pull: float = 0.05) -> np.ndarray:
    """Weights of a logistic regression, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + pull * w)
    return w


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", bound: int = SAMPLE,
          id: str = "doc_id", text: str = "text") -> ToxicityModel:
    """Fit on about ``bound`` labelled documents that ``learn`` allows."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull())
    kept = known.where(common.hash_sample(id, known.count(), bound)) \
        .select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(kept), "id") \
        .select("label", "text")
    got = rows.mapInArrow(features, "label int, words array<long>, heads array<long>").toArrow()
    words, heads = ([v.view(np.uint64) for v in common.list_values(got[c])] for c in ("words", "heads"))
    data = list(zip(got["label"].to_pylist(), words, heads))
    del got, words, heads
    common.release()
    data.sort(key=lambda r: (r[0], r[1].tobytes()))  # the same model in any task order
    return fit(np.array([r[0] for r in data], int), [r[1] for r in data], [r[2] for r in data])


def tag(docs: DataFrame, model: ToxicityModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, score, n_toxic, starts, ends): document score, number of words
    tagged toxic, and the byte bounds of the offending spans."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: ToxicityModel = shared.value
        for b in common.blocks(batches, "text"):
            buffer, offs = common.text_buffer(b.column(1))
            w = textvec.words(buffer, offs)
            p, _ = marginals(m.emission(w.hash, _heads(buffer, w)), w.first, m.move)
            hit, of = p >= 0.5, w.text_of()
            at = np.flatnonzero(hit)
            begin = at[np.append(True, (np.diff(at) > 1) | (np.diff(of[at]) > 0))[:len(at)]]
            finish = at[np.append((np.diff(at) > 1) | (np.diff(of[at]) > 0), True)[-len(at) or 1:]] if len(at) else at
            cut = pa.array(np.searchsorted(of[begin], np.arange(b.num_rows + 1)).astype(np.int32))
            base = offs[of[begin]]
            yield common.out_batch(
                OUT, id=b.column(0), score=m.score(m.summary(p, w.first)),
                n_toxic=textvec.sums(hit.astype(float), w.first).astype(np.int64),
                starts=pa.ListArray.from_arrays(cut, pa.array(w.start[begin] - base)),
                ends=pa.ListArray.from_arrays(cut, pa.array(w.end[finish] - base)))

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(
        run, "id long, score double, n_toxic long, starts array<long>, ends array<long>")


def learn_rows(id: str = "doc_id") -> Column:
    """Labels that the query may learn from."""
    return common.crc_mod(id, 5) != 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, with its offending byte spans."""
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"), learn_rows())
    return tag(docs, model).select(
        F.col("id").alias("doc_id"), (common.crc_mod("id", 5) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic", "starts", "ends")
