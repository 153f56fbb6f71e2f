"""Joins whose big side may hold hot keys.

AQE splits a skewed join only when both of its inputs come straight from a
shuffle. When the other side is an aggregate or an earlier join on the same key,
its partitioning is reused and the hot key stays in one task. ``spread_join``
splits hot keys by construction, and only those: one pass over the key columns
counts them in a sketch; a key with more than ``1 / SHARE`` of the rows, and more than
``rows_per_task``, is dealt over as many tasks as its count asks for, and its one row
on the other side is repeated once for each. All other keys are joined plainly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with no more than this share of the rows is left to one task; at most so
#: many keys can have more, so the sketch below finds every one of them.
SHARE = 512
ROWS_PER_TASK = 1_000_000
#: Keys that the sketch tracks: four for each that may be hot.
TRACKED = 4 * SHARE


def hot_keys(big: DataFrame, keys: list[str], rows_per_task: int = ROWS_PER_TASK) -> Column:
    """A scalar subquery: map of the hot keys' hashes to numbers of tasks."""
    counts = big.select(F.xxhash64(*[F.col(k) for k in keys]).alias("__k")) \
        .agg(F.expr(f"approx_top_k(__k, {SHARE}, {TRACKED})").alias("t"), F.count(F.lit(1)).alias("n"))
    return counts.select(F.expr(
        f"map_from_entries(transform(filter(t, x -> x.count > {rows_per_task} and x.count * {SHARE} > n), "
        f"x -> struct(x.item, cast(ceil(x.count / greatest({rows_per_task}, n / {SHARE})) as int))))").alias("m")).scalar()


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left", by: str = "seq",
                rows_per_task: int = ROWS_PER_TASK, counted: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (at most one row per key) on ``keys``; ``how``
    is inner, left, left_semi or left_anti. ``by``: a column of ``big`` that
    differs between the rows of a key. ``counted``: a table to count the keys in where
    ``big`` is the result of a join (it should hold a key as often)."""
    tasks = F.coalesce(F.element_at(hot_keys(big if counted is None else counted, keys, rows_per_task), F.xxhash64(*[F.col(k) for k in keys])), F.lit(1))
    dealt = big.withColumn("__part", F.pmod(F.xxhash64(F.col(by)), tasks).cast("int"))
    copies = small.withColumn("__part", F.explode(F.sequence(F.lit(0), tasks - 1)))
    return dealt.join(copies, [*keys, "__part"], how).drop("__part")
