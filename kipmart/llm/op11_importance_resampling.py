"""Target-distribution importance resampling (operator 11): draws the documents
whose words look most like a target's.

1. *Counts.* Features are the runs of 1 to ``runs`` consecutive words, hashed into
   ``buckets``; each task folds its texts into one array of counts, and Spark adds
   the arrays up. The driver gets one number a bucket (10,000 of them).
2. *Weights.* A bucket's gain is the scaled log ratio of its smoothed shares in
   the target and in the documents; a document's weight is the floored mean
   of the gains of its features, taken from the array of gains for a whole block
   of texts at once.
3. *Scores.* weight plus Gumbel noise from a hash of the id, so the k highest
   scores are a draw without replacement, the same in every run.
4. *Selection.* The k-th key in the order (score falling, id, row) is found by
   weighted median-of-medians: every task sorts the keys of its part that are
   still open and gives their median and number; the median of these medians,
   weighted by the numbers, has at least a quarter of the open keys on either
   side, so every round discards that share for certain. One pass a round gives the
   counts on both sides of a pivot and the medians of either. ``FINISH`` keys or
   fewer are sorted directly.
5. *Ranks.* Only the winners are sorted, by a range-partitioned sort.

Only the scored keys are stored (five numbers a document), sorted inside each
file, so later rounds skip row groups beyond the open interval.

Defined cases: a null text has no words; documents without features weigh 0;
a null id takes part, hashed as no characters, last among equal scores;
repeated rows are each scored and drawn on their own, among equal keys in the
order they were stored; an empty table, an empty target or too few eligible
documents draw nothing or as many as the share gives; other columns are not
read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common, textvec
from kipmart.plans.ids import sequence_number

RUNS, BUCKETS, LEAST_WORDS, PERCENT, SEED = 1, 10_000, 20, 10, 2024
#: So many open keys are sorted directly.
FINISH = 4096
#: Features of up to so many bytes are hashed byte by byte for a whole block.
SHORT = 48

_T = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _T = np.where(_T & 1, (_T >> 1) ^ np.uint32(0xEDB88320), _T >> 1)
CRC_TABLE = _T.astype(np.uint32)


def range_crc32(buffer: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of byte ranges of the buffer: all ranges a byte further at
    a time, longest ranges first."""
    size = end - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.full(len(size), 0xFFFFFFFF, np.uint32)
    open_ = len(size) - np.searchsorted(size[::-1], np.arange(min(SHORT, int(size[0])) if len(size) else 0), side="right")
    for k, m in enumerate(open_):
        c = crc[:m]
        crc[:m] = CRC_TABLE[(c ^ buffer[start[:m] + k]) & np.uint32(0xFF)] ^ (c >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(np.count_nonzero(size > SHORT)):
        crc[i] = zlib.crc32(buffer[start[i]:start[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def features(column: pa.Array, runs: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, text of each feature, words of each text)."""
    buffer, offs = common.text_buffer(column)
    low = textvec.LOWER[buffer]
    start, end, first = textvec.bounds(low, offs)
    n_words = np.diff(first)
    text = np.repeat(np.arange(len(n_words)), n_words)
    if runs > 1:
        # the words again, one space after each: a run is then one byte range
        size = end - start
        place = np.cumsum(size + 1) - size - 1
        plain = np.full(int((size + 1).sum()), 32, np.uint8)
        plain[np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)] = low[textvec.WORD[buffer]]
        low, start, end = plain, place, place + size
    bucket, of = [], []
    for r in range(1, runs + 1):
        a, z = slice(0, len(text) - r + 1), slice(r - 1, len(text))
        inside = text[a] == text[z]
        bucket.append((range_crc32(low, start[a][inside], end[z][inside]) % np.uint32(buckets)).astype(np.int64))
        of.append(text[a][inside])
    return np.concatenate(bucket), np.concatenate(of), n_words


def bucket_counts(table: DataFrame, text: str, runs: int = RUNS, buckets: int = BUCKETS) -> np.ndarray:
    """Number of features in each bucket, over all texts of the table."""
    schema = pa.schema([("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in common.blocks(batches, "text"):
            total += np.bincount(features(b.column(0), runs, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield common.out_batch(schema, bucket=some.astype(np.int32), n=total[some])

    rows = table.select(F.col(text).alias("text")).mapInArrow(run, "bucket int, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(docs: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket: floor(1000 ln of the ratio of its smoothed shares)."""
    b, s_all, t_all = len(docs), float(docs.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + b) / ((s + 1.0) * (t_all + b))))
                     for s, t in zip(docs.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, runs: int = RUNS, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)
    schema = pa.schema([(c, pa.int64()) for c in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in common.blocks(batches, "text"):
            bucket, of, n_words = features(b.column(1), runs, len(table))
            n = np.bincount(of, minlength=b.num_rows)
            at = np.concatenate([[0], np.cumsum(n)])
            order = np.argsort(of, kind="stable") if runs > 1 else slice(None)
            total = np.concatenate([[0], np.cumsum(table[bucket[order]])])
            yield common.out_batch(schema, doc_id=b.column(0), n_words=n_words, n_features=n,
                                   weight=(total[at[1:]] - total[at[:-1]]) // np.maximum(n, 1))

    return docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text")) \
        .mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 32 bits of a hash of the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _key() -> Column:
    """The order of the draw, as one ascending value; no two rows share it."""
    return F.struct((-F.col("score")).alias("low"), F.col("doc_id").isNull().cast("int").alias("none"),
                    F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("row"))


Key = tuple[int, int, int, int]
_PARTS = pa.schema([("above", pa.int32()), ("n", pa.int64()), *((c, pa.int64()) for c in ("low", "none", "id", "row"))])


def _medians(keys: DataFrame, lo: Key | None, hi: Key | None, pivot: Key | None) -> list:
    """One row for each task and side of the pivot (0: up to it): number and
    lower median of the keys over ``lo`` and up to ``hi``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.stack([c.to_numpy().astype(np.int64) for c in b.columns], 1) for b in batches if b.num_rows]
        if not parts:
            return
        k = np.concatenate(parts)
        k = k[np.lexsort(k.T[::-1])]
        cut = len(k) if pivot is None else _up_to(k, pivot)
        sides = [(s, part[(len(part) - 1) // 2], len(part)) for s, part in enumerate((k[:cut], k[cut:])) if len(part)]
        yield common.out_batch(_PARTS, above=[s for s, _, _ in sides], n=[n for _, _, n in sides],
                               **{c: [int(m[i]) for _, m, _ in sides] for i, c in enumerate(("low", "none", "id", "row"))})

    return _between(keys, lo, hi).mapInArrow(run, "above int, n long, low long, none long, id long, row long").collect()


def _up_to(k: np.ndarray, pivot: Key) -> int:
    """How many of the sorted keys are not after the pivot."""
    a, z = 0, len(k)
    for i, v in enumerate(pivot):
        part = k[a:z, i]
        a, z = a + int(np.searchsorted(part, v, "left")), a + int(np.searchsorted(part, v, "right"))
    return z


def _literal(key: Key) -> Column:
    low, none, id, row = (F.lit(int(v)) for v in key)
    return F.struct(low.cast("long").alias("low"), none.cast("int").alias("none"), id.cast("long").alias("id"),
                    row.cast("long").alias("row"))


def _between(keys: DataFrame, lo: Key | None, hi: Key | None) -> DataFrame:
    """The open keys; the bounds of the score reach the files' statistics."""
    if lo is not None:
        keys = keys.where(F.col("score") <= -lo[0]).where(_key() > _literal(lo))
    if hi is not None:
        keys = keys.where(F.col("score") >= -hi[0]).where(_key() <= _literal(hi))
    return keys.select(_key().alias("k")).select("k.low", "k.none", "k.id", "k.row")


def weighted_median(parts: list[tuple[int, Key]]) -> Key:
    """The smallest median that, with those before it, has half of all keys."""
    half, seen = sum(n for n, _ in parts) / 2, 0
    for n, key in sorted(parts, key=lambda p: p[1]):
        seen += n
        if seen >= half:
            return key
    raise ValueError("no parts")


def cutoff(keys: DataFrame, k: int, finish: int = FINISH) -> Key:
    """The exact k-th key (from 1) of the rows (score, doc_id, row)."""
    lo = hi = pivot = None
    rows = _medians(keys, lo, hi, pivot)
    while True:
        open_ = sum(r.n for r in rows)
        if open_ <= finish:
            left = sorted(map(tuple, _between(keys, lo, hi).collect()))
            return left[k - 1]
        pivot = weighted_median([(r.n, (r.low, r.none, r.id, r.row)) for r in rows])
        both = _medians(keys, lo, hi, pivot)
        below = sum(r.n for r in both if r.above == 0)
        if k == below:
            return pivot
        if k < below:
            hi, rows = pivot, [r for r in both if r.above == 0]
        else:
            lo, k, rows = pivot, k - below, [r for r in both if r.above == 1]


def ranked(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, finish: int = FINISH) -> DataFrame:
    """The stored rows of :func:`score` with their rank in the draw, from 1;
    null for those that are not drawn."""
    able = scored.where(F.col("n_words") >= least_words)
    k = percent * able.count() // 100
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last = cutoff(able, k, finish)
    drawn = (F.col("n_words") >= least_words) & (_key() <= _literal(last))
    winners = sequence_number(scored.where(drawn), [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")],
                              name="rank")
    return winners.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("long")))


def score(docs: DataFrame, target: DataFrame, runs: int = RUNS, buckets: int = BUCKETS, seed: int = SEED,
          id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, row) of every row, stored;
    sorted by score inside each file."""
    gain = gains(bucket_counts(docs, text, runs, buckets), bucket_counts(target, target_text, runs, buckets))
    rows = weighted(docs, gain, runs, id, text).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)) \
        .withColumn("row", F.monotonically_increasing_id())
    return common.stored(rows.sortWithinPartitions(F.col("score").desc()), "scored")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS,
             id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The drawn documents, all columns (rows that share an id with a drawn one
    come along)."""
    drawn = ranked(score(docs, target, id=id, text=text, **how), percent, least_words).where("rank is not null")
    ids = drawn.select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(ids, F.col(id).cast("long").eqNullSafe(F.col("__id")), "left_semi")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents of 20 words and more, drawn towards the
    benchmark's words."""
    docs, target = (common.read(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return ranked(score(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = r"""
with recursive word as (
  select 0 as kind, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from documents
  union all
  select 1, null, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) from benchmark),
step(i, k, c) as (
  select i, 0, i from range(256) t(i)
  union all
  select i, k + 1, case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end from step where k < 8),
crc_table as (select list(c order by i) as t from step where k = 8),
term as (select w, hex(encode(w)) as h from (select distinct w from word)),
roll(w, h, place, c) as (
  select w, h, 0, 4294967295 from term
  union all
  select w, h, place + 1, xor(t[xor(c, cast('0x' || substr(h, 2 * place + 1, 2) as bigint)) % 256 + 1], c // 256)
  from roll, crc_table where 2 * place < length(h)),
bucket as (select w, xor(c, 4294967295) % 10000 as b from roll where 2 * place = length(h)),
cell as (
  select b, count(*) filter (kind = 0) as s, count(*) filter (kind = 1) as t from word join bucket using (w) group by b),
total as (select sum(s) as s, sum(t) as t from cell),
gain as (
  select b, cast(floor(1000 * ln(cast(cell.t + 1 as double) * cast(total.s + 10000 as double)
      / (cast(cell.s + 1 as double) * cast(total.t + 10000 as double)))) as bigint) as g
  from cell, total),
doc as (
  select doc_id, count(*) as n, cast(floor(sum(g) / count(*)) as bigint) as weight
  from word join bucket using (w) join gain using (b) where kind = 0 group by doc_id),
scored as (
  select doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight, coalesce(weight, 0)
      + cast(floor(-1000 * ln(-ln((cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) + 0.5::double)
      / 4294967296.0::double))) as bigint) as score
  from documents left join doc using (doc_id)),
able as (
  select doc_id, row_number() over (order by score desc, doc_id) as rank, count(*) over () as n
  from scored where n_features >= 20)
select doc_id, n_features, weight, score, rank
from scored left join (select doc_id, rank from able where rank <= 10 * n // 100) using (doc_id)
"""
