"""Shared helpers: reading tables, vocabulary files, temp tables, hash samples."""

from __future__ import annotations

import ctypes
import os
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kipmart.session import ensure_checkpoint_dir

#: Text handled at a time inside a task; only a longer single text is handled alone.
BLOCK_BYTES = 1 << 20
#: Blocks of the tokenizing operators, which hash each distinct piece once a block.
TOKEN_BLOCK_BYTES = 1 << 22


#: What a worker keeps from task to task of the tokenizing operators (see
#: ``wordcoder.coder``); it goes when the blocks of another step begin.
coders: dict = {}

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once a session's
    application: its functions are imported there by name."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        target = os.path.join(tempfile.mkdtemp(prefix="kipmart-code-"), "kipmart_code.zip")
        with zipfile.ZipFile(target, "w") as z:
            for folder, _, names in os.walk(package):
                for n in names:
                    if n.endswith(".py"):
                        path = os.path.join(folder, n)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        sc.addPyFile(target)
        _shipped.add(sc.applicationId)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A given table, by a path that only Spark has to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file (each machine has its own copy)."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return posixpath.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def temp_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options) -> DataFrame:
    """``df`` written once as Parquet under ``spark.checkpoint.dir`` and read
    back, so that later steps (and lost executors) don't compute it again."""
    path = temp_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Growing:
    """A table under ``spark.checkpoint.dir`` that grows by whole results. It is
    read as one scan however many were added, so rounds that read it share
    their plans' generated code."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.paths, self.schema = spark, temp_path(spark, name), [], None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes ``df``; gives what was added."""
        self.paths.append(f"{self.root}/{len(self.paths)}")
        self.schema = df.schema
        df.write.parquet(self.paths[-1])
        return self._read(self.paths[-1:])

    def all(self) -> DataFrame | None:
        return self._read(self.paths) if self.paths else None

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths)


def parallelism(spark: SparkSession) -> int:
    """Tasks for steps that Spark would not size by itself."""
    return max(spark.sparkContext.defaultParallelism,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column's text form, modulo ``n``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def hash_sample(column: str, n_rows: int, bound: int) -> Column:
    """A deterministic filter that keeps about ``bound`` of ``n_rows`` rows."""
    share = min(1.0, bound / max(n_rows, 1))
    return F.pmod(F.xxhash64(F.col(column)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary())
    return [b or b"" for b in column.to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts; null is empty."""
    return [t or "" for t in column.to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str,
           block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows in blocks balanced by the bytes of their texts, so that a
    task's memory does not depend on how long the texts of a batch are."""
    if block_bytes == BLOCK_BYTES:
        coders.clear()
        release()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        size = np.diff(text_buffer(column)[1])
        block = np.cumsum(size) // block_bytes
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
    release()


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts one after the other, offsets of the rows in them);
    a null takes no bytes."""
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def list_values(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays (no Python objects per value)."""
    return [v for chunk in column.chunks for v in (
        np.split(chunk.flatten().to_numpy(zero_copy_only=False), np.cumsum(
            chunk.value_lengths().to_numpy(zero_copy_only=False))[:-1]) if len(chunk) else [])]


def release() -> None:
    """Give memory that Arrow and the C library hold for later back to the
    system: Python workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def out_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    """A record batch of these columns in the order of the schema."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type)
         for f, c in ((f, columns[f.name]) for f in schema)], schema=schema)
