"""Keyed change batches: latest change per key (W2) and keyed merges.

"Latest per key" is a grouped ``max_by`` over a struct rather than a
``row_number`` window: the aggregate is computed partially on the map side,
so a key that receives a third of all changes costs one row per map task
before the shuffle, where a window would pull all of them into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kipmart.plans.ids import sequence_number


def latest_per_key(df: DataFrame, keys: list[str], seq: str = "seq",
                   earliest: bool = False) -> DataFrame:
    """One row per ``keys``: the row with the highest ``seq`` (lowest with
    ``earliest=True``). ``seq`` must be unique within a key."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest])
    pick = F.min_by if earliest else F.max_by
    return (df.groupBy(*keys).agg(pick(packed, F.col(seq)).alias("__r"))
            .select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest]))


def merge_update(base: DataFrame, changes: DataFrame, keys: list[str],
                 columns: list[str]) -> DataFrame:
    """Overwrite ``columns`` of the base rows that have a change (changes are
    already one row per key); other rows and columns stay. No inserts."""
    ch = changes.select(*keys, *[F.col(c).alias(f"__new_{c}") for c in columns],
                        F.lit(True).alias("__hit"))
    j = base.join(ch, keys, "left")
    new = {c: F.when(F.col("__hit"), F.col(f"__new_{c}")).otherwise(F.col(c)) for c in columns}
    return j.select(*[new[c].alias(c) if c in new else F.col(c) for c in base.columns])


def split_valid(df: DataFrame, rules: list[tuple[Column, str]]):
    """first failing rule names the ``reason``; returns (valid, rejected)."""
    reason = F.lit(None).cast("string")
    for cond, why in reversed(rules):
        reason = F.when(cond, F.lit(why)).otherwise(reason)
    tagged = df.withColumn("reason", reason)
    return (tagged.filter(F.col("reason").isNull()).drop("reason"),
            tagged.filter(F.col("reason").isNotNull()))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str], columns: list[str],
           seq: str = "seq", id_col: str | None = "id", start_id: Column | int | None = None
           ) -> DataFrame:
    """Insert-or-update by a unique key.

    Keys present in ``base`` get the latest change's ``columns``; other base
    columns stay. Unknown keys are inserted (missing columns NULL) and, with
    ``id_col``, numbered after the current highest id in the order of their
    first request.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in columns])
    latest = (changes.groupBy(*keys).agg(F.max_by(packed, F.col(seq)).alias("__r"), F.min(seq).alias("__first"))
              .select(*keys, "__first", *[F.col(f"__r.`{c}`").alias(c) for c in columns]))
    updated = merge_update(base, latest.select(*keys, *columns), keys, columns)
    new = latest.join(base.select(*keys), keys, "left_anti")
    if id_col:
        if start_id is None:
            start_id = base.agg(F.coalesce(F.max(id_col), F.lit(0)) + 1).scalar()
        new = sequence_number(new, [F.col("__first").asc(), *[F.col(k).asc() for k in keys]],
                              start_id, id_col)
    types = dict(base.dtypes)
    inserted = new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(types[c]).alias(c)
                            for c in base.columns])
    return updated.unionByName(inserted)
