"""Running values along a key, without a key's rows in one task.

A window over a key keeps all of its rows in one task. Here the rows are sorted
by range over key and order together, so a hot key lies over several tasks; each
task computes its own part, and what a part leaves behind is carried over
its border through one row per part.

* :func:`running_last`: the last value seen so far (JVM windows inside a part).
* :func:`asof_join`: the same for two tables sorted together, inside a part while it
  is written, so its rows are shuffled once.
* :func:`local_scan`: prefixes of composed maps. Every event is a map of states
  to states; maps are composed along the key with an associative function, in
  doubling steps over whole arrays. :func:`carried` composes over the borders
  what reaches a part's first key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kipmart.plans.ids import _positions
from kipmart.plans.materialize import write_temp_table

PID, POS = "__pid", "__pos"
Maps = tuple[np.ndarray, ...]


def sorted_parts(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The rows sorted by range, with their part and place in it, written once.
    ``order`` should be total within a key."""
    srt = df.orderBy(*[F.col(k) for k in keys], *order).withColumns(_positions(PID, POS))
    return write_temp_table(srt, "kipmart-scan")


def running_last(parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """Add ``name``: the last ``value`` that is not null, up to and with the
    row, among the rows of its key; null if none. ``parts`` from
    :func:`sorted_parts`."""
    here = Window.partitionBy(PID, *keys).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    return _over_borders(parts.withColumn(name, F.last(value, ignorenulls=True).over(here)), parts, keys, value, name)


def _over_borders(out: DataFrame, parts: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """``out`` with ``name`` filled, where its own part has no ``value`` of the key yet,
    with that of the ``parts`` before."""
    key = F.struct(*[F.col(k) for k in keys])
    last = F.max_by(F.struct(key.alias("k"), value.alias("v")), F.when(value.isNotNull(), F.col(POS)))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    # one row per part; keys are sorted, so an older key's value can't be followed by this key's
    carry = parts.groupBy(PID).agg(last.alias("__own")).select(
        PID, F.last("__own", ignorenulls=True).over(before).alias("__carry"))
    carried = F.when(F.col("__carry.k").eqNullSafe(key), F.col("__carry.v"))
    return out.join(F.broadcast(carry), PID).withColumn(name, F.coalesce(F.col(name), carried)).drop("__carry")


def _last_in_part(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Rows sorted by ``keys`` with ``name``: the last ``value`` that is not null, up to and
    with the row, among the rows of its key in the same task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key and value at the end of the batch before
        for b in batches:
            if not b.num_rows:
                continue
            of = [b.column(b.schema.get_field_index(k)) for k in keys]
            values, place = b.column(b.schema.get_field_index(value)), np.arange(b.num_rows)
            fresh = np.zeros(b.num_rows, bool)
            for c in of:
                differs = pc.fill_null(pc.not_equal(c[1:], c[:-1]), False).to_numpy(zero_copy_only=False)
                null = c.is_null().to_numpy(zero_copy_only=False)
                fresh[1:] |= differs | (null[1:] != null[:-1])
            start = np.maximum.accumulate(np.where(fresh, place, 0))
            at = np.maximum.accumulate(np.where(values.is_valid().to_numpy(zero_copy_only=False), place, -1))
            at = np.where(at >= start, at, -1)
            pool = values
            if held is not None and held[0] == [c[0].as_py() for c in of]:
                at[(at < 0) & (start == 0)] = b.num_rows
                pool = pa.concat_arrays([values, held[1]])
            last = pool.take(pa.array(at, mask=at < 0))
            held = [c[-1].as_py() for c in of], last.take(pa.array([b.num_rows - 1]))
            yield pa.RecordBatch.from_arrays([*b.columns, last], names=[*b.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, df.schema[value].dataType)]))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], at: list[str], name: str) -> DataFrame:
    """The ``left`` rows with ``name``: a struct of the other columns of the last
    ``right`` row of the same key that is not after them; null if none. Both have
    the columns ``keys`` and ``at``; rows are compared by ``at[0]``, at equal
    times right rows come first, then by the rest of ``at``. Null keys match
    nothing; null times are before all others."""
    fields = [c for c in right.columns if c not in keys]
    rest = [c for c in left.columns if c not in [*keys, *at]]
    rows = left.select(*keys, *at, F.lit(1).alias("__side"), F.struct(F.lit(True).alias("__here"), *rest).alias("__left"),
                       F.lit(None).cast(right.select(F.struct(*fields).alias("r")).schema["r"].dataType).alias("__right"))
    marks = right.dropna(subset=keys).select(
        *keys, *at, F.lit(0).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"),
        F.struct(*fields).alias("__right"))
    srt = rows.unionByName(marks).orderBy(*keys, at[0], "__side", *at[1:]).withColumns(_positions(PID, POS))
    parts = write_temp_table(_last_in_part(srt, keys, "__right", "__found"), "kipmart-scan")
    own = [F.col(c).cast(left.schema[c].dataType).alias(c) if c in [*keys, *at] else F.col(f"__left.{c}") for c in left.columns]
    return _over_borders(parts.where(F.col("__side") == 1), parts, keys, F.col("__right"), "__found") \
        .select(*own, F.col("__found").alias(name))


def segmented(maps: Maps, fresh: np.ndarray, compose: Callable[[Maps, Maps], Maps]) -> Maps:
    """Inclusive prefixes of the maps within each segment (``fresh``: its first
    event), by doubling steps."""
    n, maps = len(fresh), tuple(m.copy() for m in maps)
    place = np.arange(n) - np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    step = 1
    while True:
        at = np.flatnonzero(place >= step)
        if not len(at):
            return maps
        done = compose(tuple(m[at - step] for m in maps), tuple(m[at] for m in maps))
        for m, d in zip(maps, done):
            m[at] = d
        step *= 2


def local_scan(df: DataFrame, keys: list[str], order: list[Column], inputs: list[str], names: list[str],
               maps: Callable[..., Maps], compose: Callable[[Maps, Maps], Maps], before: bool = False) -> DataFrame:
    """The rows sorted by range, with part and place, and with the integer columns
    ``names``: the map composed of the key's events in this part up to and with
    the row. ``maps`` turns the ``inputs`` (integer columns, nulls given as 0) of a
    batch into one map an event; ``compose(f, g)`` is ``f`` then ``g``. With ``before``
    also ``__b_`` columns: the map up to the row before, where ``__b`` is 1 (the key
    has an earlier row in this part). Written once."""
    key = F.to_json(F.struct(*[F.col(k) for k in keys]))
    srt = df.orderBy(*[F.col(k) for k in keys], *order).withColumns(_positions(PID, POS)).withColumn("__key", key)
    added = [*names, *(["__b", *[f"__b_{n}" for n in names]] if before else [])]
    schema = T.StructType([*srt.schema.fields, *[T.StructField(n, T.LongType()) for n in added]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # key and map at the end of the batch before
        for b in batches:
            if not b.num_rows:
                continue
            of = b.column(b.schema.get_field_index("__key"))
            fresh = np.ones(b.num_rows, bool)
            fresh[1:] = pc.not_equal(of[1:], of[:-1]).to_numpy(zero_copy_only=False)
            column = [b.column(b.schema.get_field_index(c)).cast(pa.int64()).fill_null(0).to_numpy() for c in inputs]
            m = tuple(np.asarray(x, np.int64) for x in maps(*column))
            goes_on = held is not None and held[0] == of[0].as_py()
            last = tuple(x[0] if goes_on else 0 for x in (held[1] if goes_on else m))
            if goes_on:
                first = compose(held[1], tuple(x[:1] for x in m))
                m = tuple(np.concatenate([f, x[1:]]) for f, x in zip(first, m))
            m = segmented(m, fresh, compose)
            held = of[-1].as_py(), tuple(x[-1:].copy() for x in m)
            if before:
                earlier = (~fresh).astype(np.int64)
                earlier[0] = goes_on
                m = (*m, earlier, *[np.concatenate([[v], x[:-1]]) for v, x in zip(last, m)])
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(x, pa.int64()) for x in m]],
                                             names=[*b.schema.names, *added])

    return write_temp_table(srt.mapInArrow(run, schema), "kipmart-scan")


def carried(scanned: DataFrame, names: list[str], compose: Callable[[Maps, Maps], Maps]) -> DataFrame:
    """(part, key, map) that reaches each part's first key from the parts before:
    one row per part, composed in order on the driver."""
    last = F.max_by(F.struct("__key", *names), POS)
    ends = scanned.groupBy(PID).agg(F.min_by("__key", POS).alias("first"), last.alias("last")).orderBy(PID).collect()
    rows, key, held = [], None, None
    for r in ends:
        own = tuple(np.array([r["last"][n]], np.int64) for n in names)
        if r["first"] == key:
            rows.append((r[PID], key, *[int(x[0]) for x in held]))
            if r["last"]["__key"] == key:
                own = compose(held, own)
        key, held = r["last"]["__key"], own
    fields = [T.StructField(PID, scanned.schema[PID].dataType), T.StructField("__key", T.StringType()),
              *[T.StructField(f"__c_{n}", T.LongType()) for n in names]]
    return scanned.sparkSession.createDataFrame(rows, T.StructType(fields))


def with_carry(scanned: DataFrame, names: list[str], compose: Callable[[Maps, Maps], Maps]) -> DataFrame:
    """The scanned rows with ``__c_`` columns: the map that comes before a row's
    part on its key; null where nothing does."""
    return scanned.join(F.broadcast(carried(scanned, names, compose)), [PID, "__key"], "left")
