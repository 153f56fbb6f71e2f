"""Language identification (operator 4): family first, then pairs within it.

Texts are counts of hashed byte groups (two and three bytes, whole text). One
linear support vector machine per language family against the rest picks the
family; inside it, one machine per pair of languages votes (one versus one), and
the summed margins break ties. Families come from :data:`FAMILIES`; a language
that the table does not name is a family of its own. Margins become scores by a
logistic curve fitted on the training sample; a document's score is the
product of its family's and its language's.

``train`` reads a bounded sample: at most about ``per_language`` documents of
each language, picked by a hash of their id. ``predict`` scores every row's
whole text in one pass without a shuffle.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
rows with a null language are never learnt from, but predicted; with no
training rows every text is ``und``; repeated rows are predicted alike; ties of
margins go to the alphabetically first language; other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common, textvec

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "fy", "is", "lb", "nl", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "pt", "ro"],
    "slavic": ["be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
}
BITS = 15
PER_LANGUAGE = 600
OUT = pa.schema([("id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
_FEATURES = pa.schema([("lang", pa.string()), ("ids", pa.list_(pa.int32())),
                       ("counts", pa.list_(pa.int32()))])
_LETTER = regex.compile(r"\p{L}")


def family_of(language: str) -> str:
    return next((f for f, langs in FAMILIES.items() if language in langs), f"only {language}")


def _groups(buffer: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Feature of each place and group size; places across texts get the last one."""
    out = []
    for size in (2, 3):
        h, inside = textvec.letter_groups(buffer, offsets, size, BITS - 1)
        out.append(np.where(inside, h + (size - 2 << BITS - 1), 1 << BITS))
    return out


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, distinct features, their counts) of (lang, text) rows."""
    for b in common.blocks(batches, "text"):
        buffer, offs = common.text_buffer(b.column(1))
        groups = _groups(buffer, offs)
        ids, counts = [], []
        for a, z in zip(offs, offs[1:]):
            n = np.bincount(np.concatenate([g[a:z] for g in groups]), minlength=(1 << BITS) + 1)[:-1]
            at = np.flatnonzero(n)
            ids.append(at.astype(np.int32))
            counts.append(n[at].astype(np.int32))
        yield common.out_batch(_FEATURES, lang=b.column(0), ids=pa.array(ids, pa.list_(pa.int32())),
                               counts=pa.array(counts, pa.list_(pa.int32())))


def linear_svm(rows: list[tuple[np.ndarray, np.ndarray]], sign: np.ndarray, dim: int,
               epochs: int = 4, reg: float = 1e-4, seed: int = 7) -> np.ndarray:
    """Weights of a linear support vector machine (hinge loss, stochastic
    subgradient steps, average of the last epochs). Both sides weigh alike."""
    rng, w, mean, scale, t, kept = np.random.RandomState(seed), np.zeros(dim), np.zeros(dim), 1.0, 0, 0
    share = {s: len(sign) / (2 * max((sign == s).sum(), 1)) for s in (1, -1)}
    for epoch in range(epochs):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (reg * (t + 1 / reg))
            ids, x = rows[i]
            margin = sign[i] * scale * w[ids].dot(x)
            scale *= 1 - rate * reg
            if margin < 1:
                w[ids] += x * (rate * sign[i] * share[sign[i]] / scale)
        if epoch >= epochs // 2:
            mean += scale * w
            kept += 1
    return mean / max(kept, 1)


def logistic_curve(margin: np.ndarray, positive: np.ndarray) -> float:
    """Slope of the curve from margin to score, by Newton steps, with a weak
    pull to 0 so that a parted sample does not give an endless slope."""
    size = np.abs(margin).mean() or 1.0
    x, y, a = margin / size, np.where(positive, 1.0, 0.0), 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * x, -30, 30)))
        a -= (x.dot(p - y) + 0.01 * a) / ((x * x).dot(p * (1 - p)) + 0.01)
        a = min(max(a, 0.1), 20.0)
    return a / size


@dataclass
class LanguageModel:
    languages: list[str]
    families: list[str]
    pairs: list[tuple[str, str]]
    weights: np.ndarray  # (features + 1, families + pairs); the last row is 0
    slopes: np.ndarray

    def predict(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text of a block."""
        n, size = len(offsets) - 1, np.diff(offsets)
        full, total = np.flatnonzero(size), np.zeros((n, len(self.slopes)))
        if len(full):
            for g in _groups(buffer, offsets):
                for k in range(len(self.slopes)):
                    total[full, k] += np.add.reduceat(self.weights[:, k][g], offsets[full], dtype=np.float64)
        p = 1 / (1 + np.exp(-np.clip(total / np.maximum(size, 1)[:, None] * self.slopes, -30, 30)))
        nf = len(self.families)
        fam = p[:, :nf] / np.maximum(p[:, :nf].sum(1, keepdims=True), 1e-12)
        best = total[:, :nf].argmax(1)
        lang, score = np.zeros(n, int), np.zeros(n)
        for f, name in enumerate(self.families):
            own = [k for k, x in enumerate(self.languages) if family_of(x) == name]
            rows = np.flatnonzero(best == f)
            votes, sure = np.zeros((len(rows), len(own))), np.zeros((len(rows), len(own)))
            for k, (a, b) in enumerate(self.pairs):
                if family_of(a) == name:
                    i, j, q = own.index(self.languages.index(a)), own.index(self.languages.index(b)), p[rows, nf + k]
                    votes[:, i] += q >= 0.5
                    votes[:, j] += q < 0.5
                    sure[:, i] += q / (len(own) - 1)
                    sure[:, j] += (1 - q) / (len(own) - 1)
            if len(own) == 1:
                sure[:] = 1
            pick = (votes + 1e-3 * sure).argmax(1)
            lang[rows] = np.array(own)[pick]
            score[rows] = fam[rows, f] * sure[np.arange(len(rows)), pick]
        return lang, score


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> LanguageModel:
    """The model of (language, features, counts) rows."""
    dim = 1 << BITS
    rows = [(ids, c / max(np.sqrt((c.astype(float) ** 2).sum()), 1e-9)) for _, ids, c in sample]
    lang = np.array([x[0] for x in sample])
    languages = sorted(set(lang.tolist()))
    fam = np.array([family_of(x) for x in lang])
    families = sorted(set(fam.tolist()))
    pairs = [(a, b) for a, b in itertools.combinations(languages, 2) if family_of(a) == family_of(b)]
    jobs = [(np.arange(len(rows)), fam == f) for f in families]
    jobs += [(np.flatnonzero((lang == a) | (lang == b)), None) for a, b in pairs]
    weights, slopes = np.zeros((dim + 1, len(jobs)), np.float32), np.ones(len(jobs))
    size = np.array([max(c.sum() / 2, 1) for _, _, c in sample])
    for k, (at, positive) in enumerate(jobs):
        if positive is None:
            positive = lang[at] == pairs[k - len(families)][0]
        sign = np.where(positive, 1, -1)
        w = linear_svm([rows[i] for i in at], sign, dim)
        weights[:-1, k] = w
        margin = np.array([w[sample[i][1]].dot(sample[i][2]) for i in at]) / size[at]
        slopes[k] = logistic_curve(margin, positive)
    return LanguageModel(languages, families, pairs, weights, slopes)


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, id: str = "doc_id",
          text: str = "text", lang: str = "lang") -> LanguageModel:
    """Fit on the rows that ``learn`` allows; the driver gets the features of
    at most about ``per_language`` documents of each language."""
    rows = docs.where(learn & F.col(lang).isNotNull() & F.col(text).isNotNull())
    n = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    keep = F.lit(False)
    for value, count in n.items():
        keep = keep | ((F.col(lang) == value) & common.hash_sample(id, count, per_language))
    sample = rows.where(keep).select(F.col(lang).alias("lang"), F.col(text).alias("text")) \
        .mapInArrow(features, "lang string, ids array<int>, counts array<int>").toArrow()
    got = zip(sample["lang"].to_pylist(), common.list_values(sample["ids"]), common.list_values(sample["counts"]))
    data = [(a, i, c) for a, i, c in got if len(i)]
    data.sort(key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))  # the same model in any task order
    del sample, got
    common.release()
    return fit(data)


def label_block(model: LanguageModel, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(language, score) of the texts of a block."""
    n = len(column)
    buffer, offs = common.text_buffer(column)
    known = [bool(model.languages) and bool(t) and _LETTER.search(t) is not None for t in column.to_pylist()]
    lang, score = model.predict(buffer, offs) if model.languages else (np.zeros(n, int), np.zeros(n))
    return np.array([*model.languages, "und"], object)[np.where(known, lang, -1)], np.where(known, score, 0.0)


def predict(docs: DataFrame, model: LanguageModel, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text"):
            lang, score = label_block(shared.value, b.column(1))
            yield common.out_batch(OUT, id=b.column(0), lang_pred=lang, score=score)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")) \
        .mapInArrow(run, "id long, lang_pred string, score double")


def keep_known(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The documents, all columns, with a predicted language (not ``und``)
    whose score is at least ``least``."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            lang, score = label_block(shared.value, b.column(at))
            yield b.filter(pa.array((lang != "und") & (score >= least)))

    return docs.mapInArrow(run, docs.schema)


def learn_rows(id: str = "doc_id") -> Column:
    """Rows that the query may learn from."""
    return common.crc_mod(id, 4) != 2


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    docs = common.read(spark, sf_dir, "documents")
    p = predict(docs, train(docs, learn_rows()))
    return p.select(F.col("id").alias("doc_id"), (common.crc_mod("id", 4) == 2).alias("held_out"),
                    "lang_pred", "score")
