"""Dense sequential numbering without a single-partition window.

``row_number() over (order by k)`` with no partition moves every row into one
task. Instead the rows are range-partitioned by a global sort, each row takes
its position inside its partition, and a per-partition offset (one row per
partition, so its size is bounded by the partition count, not by the data) is
added. The sorted rows and their positions are written once as Parquet under
``spark.checkpoint.dir`` (a lineage cut), so positions and partition counts
are read from the same materialised data, also when an executor is lost and a
task re-runs; later scans of it stay columnar.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kipmart.plans.materialize import write_temp_table


def _positions(pid: str, pos: str) -> dict:
    """Partition index and 0-based position inside the partition
    (``monotonically_increasing_id`` = partition index << 33 | position)."""
    part = F.spark_partition_id()
    return {pid: part,
            pos: F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)}


def sequence_number(df: DataFrame, order: list[Column], start: Column | int = 1,
                    name: str = "n") -> DataFrame:
    """Add ``name`` = ``start`` + 0-based rank of the row in ``order``.

    ``order`` must be a total order (add a unique tie-breaker) for the numbers
    to be deterministic. ``start`` may be a literal or a scalar subquery
    column (``DataFrame.scalar()``), e.g. the current highest id plus one.
    """
    pid, pos = "__pid", "__pos"
    sorted_df = df.orderBy(*order).withColumns(_positions(pid, pos))
    sorted_df = write_temp_table(sorted_df, "kipmart-seq")
    counts = sorted_df.groupBy(pid).agg(F.count(F.lit(1)).alias("__cnt"))
    # one row per partition: a window over it is tiny and bounded
    offsets = counts.select(
        pid, (F.sum("__cnt").over(Window.orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)))
        .alias("__off"))
    offsets = offsets.fillna(0, ["__off"])
    base = start if isinstance(start, Column) else F.lit(start)
    out = (sorted_df.join(F.broadcast(offsets), pid)
           .withColumn(name, (base + F.col("__off") + F.col(pos)).cast("bigint"))
           .drop(pid, pos, "__off"))
    return out


def number_within(df: DataFrame, keys: list[str], order: list[Column], name: str = "rn"
                  ) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` without putting a
    key's rows into one task.

    The rows are range-partitioned by ``keys + order`` (a hot key is spread
    over several partitions) and written once with their position inside the
    partition. Per (partition, key) the first position and the row count are
    aggregated; a key's offset in a partition is the count of its rows in the
    partitions before it — a window over at most one row per partition the key
    spans, so it stays small however hot the key is. ``order`` must make the
    order total for the numbers to be deterministic.
    """
    pid, pos = "__pid", "__pos"
    srt = df.orderBy(*[F.col(k) for k in keys], *order).withColumns(_positions(pid, pos))
    srt = write_temp_table(srt, "kipmart-rank")
    per = (srt.groupBy(pid, *keys)
           .agg(F.min(pos).alias("__start"), F.count(F.lit(1)).alias("__n")))
    before = Window.partitionBy(*keys).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    return (srt.join(per.select(pid, *keys, "__start", "__off"), [pid, *keys])
            .withColumn(name, (F.col(pos) - F.col("__start") + F.col("__off") + 1).cast("bigint"))
            .drop(pid, pos, "__start", "__off"))
