"""Token-id output (operator 1): documents as Parquet lists of token ids.

``write_tokens`` range-partitions the documents on their id, sorts each
partition, encodes it and writes one row per document: ``doc_id``, ``part``,
``start_in_part``, ``n_tokens``, ``tokens``. ``part`` is a folder, numbered in
ascending id order; inside, rows are in ascending id order. The files have

* the delta writer: ids are dictionary-coded while a column chunk's dictionary
  is small and delta-binary-packed beyond, counts and starts delta-packed;
* row groups and pages of a set size, and page indexes (column and offset
  indexes), so that a filter on ``doc_id`` reads only the pages it needs;
* metadata apart from the ids: a read of ``doc_id`` and ``n_tokens`` alone does
  not touch the id pages.

``read_offsets`` turns the counts per part (one row each) into the first token
offset of each part, ``read_tokens`` gives the documents with their offset in
the whole stream, for all or for selected ids.

Defined cases: a null text is empty (only the end id); null ids come first, in
the first part; repeated rows are written each (ties in any order); an empty
table writes no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kipmart.llm import common
from kipmart.llm.wordcoder import coder

SCHEMA = "doc_id long, part int, start_in_part long, n_tokens long, tokens array<int>"
OUT = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("start_in_part", pa.int64()),
                 ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))])
#: Writer settings: row groups of 32 MB and pages of 256 KB, so that a selective
#: read skips at both levels; format version 2 has the delta encodings.
WRITER = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "20000",
    "compression": "zstd",
}


def append_end(ids: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The ids with the end id after each document, and their offsets."""
    if end_id is None:
        return ids, offsets
    return np.insert(ids, offsets[1:], end_id), offsets + np.arange(len(offsets))


def write_tokens(docs: DataFrame, path: str, vocabulary: str = "byte_bpe_50k.json",
                 end_id: int | None = 0, id: str = "doc_id", text: str = "text",
                 block_bytes: int = common.TOKEN_BLOCK_BYTES) -> None:
    """Encode every document and write the token files under ``path``."""
    from pyspark import TaskContext

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, at = coder(common.vocabulary(vocabulary)), TaskContext.get().partitionId(), 0
        for b in common.blocks(batches, "text", block_bytes):
            ids, offs = append_end(*code.encode(*common.text_buffer(b.column(1))), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.view(np.int32)))
            yield common.out_batch(OUT, doc_id=b.column(0), part=np.full(b.num_rows, part, np.int32),
                                   start_in_part=at + offs[:-1], n_tokens=np.diff(offs), tokens=lists)
            at += int(offs[-1])

    rows = docs.select(F.col(id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    (rows.repartitionByRange(common.parallelism(docs.sparkSession), "doc_id")
         .sortWithinPartitions("doc_id").mapInArrow(encode, SCHEMA)
         .write.options(**WRITER).partitionBy("part").parquet(path))


def _stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(part, part_start): reads the counts only; one row per part, so the
    running sum over all parts is small however many documents there are."""
    per_part = _stored(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    return per_part.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of all documents, or of ``doc_ids``
    (a filter that reaches the files' page indexes)."""
    rows = _stored(spark, path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(read_offsets(spark, path)), "part").select(
        "doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "tokens")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the token files of all documents, then digest what they hold."""
    path = common.temp_path(spark, "tokens")
    write_tokens(common.read(spark, sf_dir, "documents"), path)
    rows = read_tokens(spark, path)
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            crc = [zlib.crc32(flat[a:z]) for a, z in zip([0, *ends[:-1]], ends)]
            yield common.out_batch(out, doc_id=b.column(0), start=b.column(1), n_tokens=b.column(2),
                                   ids_crc32=crc)

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
