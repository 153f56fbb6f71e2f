"""Writing multi-output jobs: cut lineage once, then write every output.

A change batch (placing orders, cancels, line deletes) yields several tables
that share their expensive first steps. :func:`write_outputs` checkpoints the
shared inputs into the cluster's checkpoint folder (reliable storage, so a lost
executor does not force a recomputation from the raw scans), then writes each
output as Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from kipmart.session import ensure_checkpoint_dir


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` into ``spark.checkpoint.dir`` and return a DataFrame
    that reads it back (never a local checkpoint)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_temp_table(df: DataFrame, prefix: str = "kipmart") -> DataFrame:
    """Materialise ``df`` as Parquet in a fresh folder under
    ``spark.checkpoint.dir`` and return a DataFrame reading it back: the same
    lineage cut as :func:`cut_lineage`, but later scans stay columnar (column
    pruning, filter pushdown)."""
    folder = ensure_checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{folder}/{prefix}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def drop_temp_tables(spark, prefix: str = "kipmart") -> int:
    """Delete the folders :func:`write_temp_table` left under the checkpoint
    folder (through the Hadoop file system of that folder, so it works on
    HDFS/S3 too). Returns the number of folders removed. Call it after the
    DataFrames that read them are no longer needed."""
    folder = ensure_checkpoint_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    removed = 0
    for st in fs.listStatus(root):
        if st.isDirectory() and st.getPath().getName().startswith(prefix + "-"):
            fs.delete(st.getPath(), True)
            removed += 1
    return removed


def write_outputs(outputs: dict[str, DataFrame], path: str, mode: str = "overwrite",
                  partition_by: dict[str, list[str]] | None = None) -> dict[str, str]:
    """Write each named output to ``path/name`` (Parquet); returns the paths."""
    written = {}
    for name, df in outputs.items():
        target = f"{path.rstrip('/')}/{name}"
        w = df.write.mode(mode)
        cols = (partition_by or {}).get(name)
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(target)
        written[name] = target
    return written
