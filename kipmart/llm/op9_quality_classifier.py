"""Quality classifier (operator 9): a factorisation machine.

A document is a sparse vector of hashed words (length-normalised counts over the
whole text), structure statistics (:data:`STATISTICS`) and a metadata field, the
stored character count. The score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f [ (sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2 ]

whose bracket is the sum of all pairwise interactions <v_i, v_j> x_i x_j, in
time linear in the number of words.

``train`` fits it by minibatch Adam on the logistic loss over a bounded sample
(about ``bound`` labelled documents, picked by a hash of their id); ``score``
rates every row's whole text in one pass without a shuffle.

Defined cases: a null text is empty and gets the score of its statistics; a
null character count is replaced by the counted one; without labels of both
kinds every score is the share of 1 among the labels (0.5 without any);
repeated rows get the same score; labels with a null are not learnt from; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common, textvec

BITS = 15
FACTORS = 4
SAMPLE = 4000
STATISTICS = ["log bytes", "log words", "log stored characters", "capitals", "digits", "symbols",
              "white space", "word length", "distinct words", "words a line", "distinct lines",
              "lines ending in a stop", "pipes", "beyond ASCII"]
OUT = pa.schema([("id", pa.int64()), ("score", pa.float64())])
_FEATURES = pa.schema([("label", pa.int32()), ("ids", pa.list_(pa.int32())),
                       ("counts", pa.list_(pa.int32())), ("stats", pa.list_(pa.float64()))])
_LINE = ~textvec.kind_of([10])


_CAPITAL, _DIGIT = textvec.kind_of([*range(65, 91)]), textvec.kind_of([*range(48, 58)])
_SPACE, _PIPE, _STOP = textvec.kind_of([9, 10, 11, 12, 13, 32]), textvec.kind_of([124]), textvec.kind_of([33, 46, 63])
_SYMBOL = ~(textvec.WORD | _SPACE)
_BEYOND = textvec.kind_of([*range(128, 256)])



def describe(column: pa.Array, stored: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each distinct word, its hashed id, its count, statistics)."""
    buffer, offs = common.text_buffer(column)
    n, size = len(offs) - 1, np.diff(offs).astype(float)
    w = textvec.words(buffer, offs)
    of, ids = w.text_of(), (w.hash >> np.uint64(64 - BITS)).astype(np.int64)
    key, counts = np.unique(of << BITS | ids, return_counts=True)
    lines = textvec.words(buffer, offs, _LINE)
    line_of = lines.text_of()
    # two lines differ when their hashes do; the text's number goes into the hash
    line_key = np.unique(textvec.mix(lines.hash + line_of.astype(np.uint64) * np.uint64(textvec._ODD)),
                         return_index=True)[1]
    n_words, n_lines = w.counts.astype(float), lines.counts.astype(float)
    shares = []
    for kind in (_CAPITAL, _DIGIT, _SYMBOL, _SPACE, _PIPE, _BEYOND):
        at = np.cumsum(np.concatenate([[0], kind[buffer]]))
        shares.append((at[offs[1:]] - at[offs[:-1]]) / np.maximum(size, 1))
    capital, digit, symbol, space, pipe, beyond = shares
    length = textvec.sums((w.end - w.start).astype(float), w.first)
    stops = textvec.sums(_STOP[buffer[lines.end - 1]].astype(float) if len(lines.end) else np.zeros(0), lines.first)
    begin = np.maximum(np.bincount(key >> BITS, minlength=n), 0)
    stats = np.stack([
        np.log1p(size), np.log1p(n_words), np.log1p(np.where(stored < 0, size, stored)), capital, digit,
        symbol, space, length / np.maximum(n_words, 1), begin / np.maximum(n_words, 1),
        np.log1p(n_words / np.maximum(n_lines, 1)),
        np.bincount(line_of[line_key], minlength=n) / np.maximum(n_lines, 1),
        stops / np.maximum(n_lines, 1), pipe, beyond], 1)
    return key >> BITS, key & ((1 << BITS) - 1), counts, stats


def _stored(column: pa.Array) -> np.ndarray:
    return column.cast(pa.float64()).fill_null(-1.0).to_numpy(zero_copy_only=False)


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of (label, text, n_chars) rows."""
    for b in common.blocks(batches, "text"):
        of, ids, counts, stats = describe(b.column(1), _stored(b.column(2)))
        cut = np.searchsorted(of, np.arange(b.num_rows + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v.astype(np.int32))) for v in (ids, counts)]
        yield common.out_batch(_FEATURES, label=b.column(0), ids=lists[0], counts=lists[1],
                               stats=pa.array(list(stats), pa.list_(pa.float64())))


@dataclass
class FactorisationMachine:
    mean: np.ndarray
    spread: np.ndarray
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margin(self, n: int, of: np.ndarray, ids: np.ndarray, counts: np.ndarray,
               stats: np.ndarray) -> np.ndarray:
        """Score before the logistic of ``n`` texts; features sorted by text."""
        of, ids, x = sparse(n, of, ids, counts, (stats - self.mean) / self.spread)
        first = np.searchsorted(of, np.arange(n + 1))
        vx = self.factors[ids] * x[:, None]
        pairs = textvec.sums(vx, first) ** 2 - textvec.sums(vx * vx, first)
        return self.bias + textvec.sums(self.linear[ids] * x, first) + 0.5 * pairs.sum(1)


def sparse(n: int, of: np.ndarray, ids: np.ndarray, counts: np.ndarray,
           stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list of (text, feature, value): words of length 1, then statistics."""
    square = np.bincount(of, counts.astype(float) ** 2, minlength=n)
    x = counts / np.sqrt(np.maximum(square, 1))[of]
    k = stats.shape[1]
    of = np.concatenate([of, np.repeat(np.arange(n), k)])
    ids = np.concatenate([ids, np.tile((1 << BITS) + np.arange(k), n)])
    x = np.concatenate([x, np.clip(stats, -6, 6).ravel()])
    order = np.argsort(of, kind="stable")
    return of[order], ids[order], x[order]


def fit(labels: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], stats: np.ndarray,
        epochs: int = 8, batch: int = 64, rate: float = 0.02, decay: float = 1e-4,
        seed: int = 5) -> FactorisationMachine:
    """Adam over minibatches of the logistic loss; steps touch only the
    features of the batch."""
    rng, dim = np.random.RandomState(seed), (1 << BITS) + len(STATISTICS)
    mean = stats.mean(0) if len(stats) else np.zeros(len(STATISTICS))
    spread = stats.std(0) + 1e-3 if len(stats) else np.ones(len(STATISTICS))
    share = labels.mean() if len(labels) else 0.5
    m = FactorisationMachine(mean, spread, float(np.log((share + 1e-3) / (1 - share + 1e-3))),
                             np.zeros(dim), np.zeros((dim, FACTORS)))
    if not 0 < share < 1:
        return m
    m.factors = rng.normal(0, 0.02, (dim, FACTORS))
    theta = np.concatenate([m.linear[:, None], m.factors], 1)
    first, second, t = np.zeros_like(theta), np.zeros_like(theta), 0
    scaled = (stats - mean) / spread
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            at = order[a:a + batch]
            n = len(at)
            of = np.repeat(np.arange(n), [len(rows[i][0]) for i in at])
            of, ids, x = sparse(n, of, np.concatenate([rows[i][0] for i in at]),
                                np.concatenate([rows[i][1] for i in at]), scaled[at])
            cut = np.searchsorted(of, np.arange(n + 1))
            v = theta[ids, 1:]
            vx = v * x[:, None]
            total = textvec.sums(vx, cut)
            z = m.bias + textvec.sums(theta[ids, 0] * x, cut) + 0.5 * (total ** 2 - textvec.sums(vx * vx, cut)).sum(1)
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[at]) / n
            g = (error[of] * x)[:, None]
            grad = np.concatenate([g, g * (total[of] - vx)], 1)
            used, where = np.unique(ids, return_inverse=True)
            sums = np.stack([np.bincount(where, grad[:, k]) for k in range(grad.shape[1])], 1) + decay * theta[used]
            t += 1
            first[used] = 0.9 * first[used] + 0.1 * sums
            second[used] = 0.999 * second[used] + 0.001 * sums ** 2
            step = first[used] / (1 - 0.9 ** t) / (np.sqrt(second[used] / (1 - 0.999 ** t)) + 1e-8)
            theta[used] -= rate * step
            m.bias -= rate * 10 * error.sum()
    m.linear, m.factors = theta[:, 0].copy(), theta[:, 1:].copy()
    return m


def _columns(docs: DataFrame, text: str, n_chars: str) -> list[Column]:
    stored = F.col(n_chars).cast("double") if n_chars in docs.columns else F.lit(None).cast("double")
    return [F.col(text).alias("text"), stored.alias("n_chars")]


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", bound: int = SAMPLE,
          id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> FactorisationMachine:
    """Fit on about ``bound`` labelled documents that ``learn`` allows."""
    known = labels.where(learn & F.col(label).isNotNull() & F.col(id).isNotNull())
    kept = known.where(common.hash_sample(id, known.count(), bound)) \
        .select(F.col(id).alias("id"), F.col(label).cast("int").alias("label")).distinct()
    rows = docs.select(F.col(id).alias("id"), *_columns(docs, text, n_chars)).join(F.broadcast(kept), "id") \
        .select("label", "text", "n_chars")
    got = rows.mapInArrow(features, "label int, ids array<int>, counts array<int>, stats array<double>").toArrow()
    stats, ids, counts = (common.list_values(got[c]) for c in ("stats", "ids", "counts"))
    labels = got["label"].to_pylist()
    del got
    common.release()
    order = sorted(range(len(labels)), key=lambda i: (stats[i].tobytes(), labels[i], ids[i].tobytes(),
                                                      counts[i].tobytes()))  # the same model in any task order
    return fit(np.array([labels[i] for i in order], float), [(ids[i], counts[i]) for i in order],
               np.array([stats[i] for i in order], float).reshape(len(order), len(STATISTICS)))


def score(docs: DataFrame, model: FactorisationMachine, id: str = "doc_id", text: str = "text",
          n_chars: str = "n_chars") -> DataFrame:
    """(id, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text"):
            z = shared.value.margin(b.num_rows, *describe(b.column(1), _stored(b.column(2))))
            yield common.out_batch(OUT, id=b.column(0), score=1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.select(F.col(id).cast("long").alias("id"), *_columns(docs, text, n_chars)) \
        .mapInArrow(run, "id long, score double")


def keep_good(docs: DataFrame, model: FactorisationMachine, least: float = 0.7, text: str = "text",
              n_chars: str = "n_chars") -> DataFrame:
    """The documents, all columns, whose score is at least ``least``."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(model), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            stored = _stored(b.column(columns.index(n_chars))) if n_chars in columns else np.full(b.num_rows, -1.0)
            z = shared.value.margin(b.num_rows, *describe(b.column(columns.index(text)), stored))
            yield b.filter(pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))) >= least))

    return docs.mapInArrow(run, docs.schema)


def learn_rows(id: str = "doc_id") -> Column:
    """Labels that the query may learn from."""
    return common.crc_mod(id, 4) != 2


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document; 1 from a score of 0.7."""
    docs = common.read(spark, sf_dir, "documents")
    model = train(docs, common.read(spark, sf_dir, "labels"), learn_rows())
    return score(docs, model).select(
        F.col("id").alias("doc_id"), (common.crc_mod("id", 4) == 2).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"))
