"""Token counts (operator 6): lengths of whole texts under a public tokenizer.

``token_counts`` encodes in Arrow batches that return lengths only. Rows are
handled in blocks of equal bytes, and texts are cut at safe boundaries (see
:mod:`kipmart.llm.wordcoder`), so memory depends on neither the number of rows
in a batch nor the length of one text's tokens. No shuffle.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows
are counted each; an empty table gives an empty result; only the id and text
columns are read, other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.llm import common
from kipmart.llm.wordcoder import coder

OUT = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])


def token_counts(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", id: str = "doc_id",
                 text: str = "text", block_bytes: int = common.TOKEN_BLOCK_BYTES) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row's whole text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(common.vocabulary(vocabulary))
        for b in common.blocks(batches, "text", block_bytes):
            buffer, offs = common.text_buffer(b.column(1))
            yield common.out_batch(OUT, id=b.column(0), n_bytes=np.diff(offs),
                                   n_tokens=code.lengths(buffer, offs))

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")) \
        .mapInArrow(count, "id long, n_bytes long, n_tokens long")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document (limit 512)."""
    c = token_counts(common.read(spark, sf_dir, "documents"))
    return c.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens",
                    (F.col("n_tokens") > 512).alias("over_limit"))
