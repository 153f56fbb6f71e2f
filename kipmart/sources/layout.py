"""Storage layout for the shop tables at scale.

``write_shop`` writes each shop table as Parquet clustered on the column its
queries filter or join on, so Parquet min/max statistics skip row groups:

* ``shop_orders``: range-partitioned and sorted by ``created_at`` — month, day
  and year ranges (F1-F3) read only the matching row groups;
* ``shop_items``: range-partitioned and sorted by ``order_id`` — the line ⋈
  order join and the per-order aggregates read key-clustered files;
* the dimensions (products, categories, images, members) sorted by ``id``.

Range partitioning sends equal keys to one partition, so the range key is made
unique by the row's id: a hot key then spreads over several files. ``load_shop(spark, path, kind="parquet")`` reads
the result.
"""

from __future__ import annotations

from pyspark.sql import functions as F

#: Range keys, each ending in a unique column: equal leading keys (a hot order, a
#: busy day) then spread over as many files as their rows need.
CLUSTER = {
    "shop_orders": ["created_at", "id"],
    "shop_items": ["order_id", "id"],
    "shop_products": ["id"],
    "shop_categories": ["id"],
    "shop_product_images": ["product_id", "id"],
    "shop_members": ["id"],
}


MONTH = "order_month"


def write_shop(T, path: str, files: dict[str, int] | None = None, mode: str = "overwrite",
               by_month: bool = False) -> None:
    """Write the six shop tables of ``T`` under ``path`` (one folder each).

    ``files`` gives the output file count of a table; without it the session's
    shuffle partitions, coalesced by AQE, decide.

    ``by_month=True`` also partitions the two fact tables by ``order_month``
    (``yyyy-MM`` of the order's ``created_at``; order lines get it from their
    order). Month, day and year reports then add a predicate on that column
    (see ``reports._orders_in`` / ``_items_in``) and Spark lists only the
    matching month folders of both tables.
    """
    files = files or {}
    root = path.rstrip("/")
    month_of = None
    if by_month:
        month_of = T.orders.select(F.col("id").alias("order_id"),
                                   F.date_format("created_at", "yyyy-MM").alias(MONTH))
    for name, key in CLUSTER.items():
        df = T.table(name)
        n = [files[name]] if name in files else []
        if by_month and name == "shop_orders":
            df = df.withColumn(MONTH, F.date_format("created_at", "yyyy-MM"))
        elif by_month and name == "shop_items":
            df = df.join(month_of, "order_id", "left")
        if by_month and name in ("shop_orders", "shop_items"):
            # each task covers a run of months, so a month folder gets few files
            out = (df.repartitionByRange(*n, F.col(MONTH), *map(F.col, key))
                   .sortWithinPartitions(MONTH, *key).write.mode(mode).partitionBy(MONTH))
        else:
            out = df.repartitionByRange(*n, *map(F.col, key)).sortWithinPartitions(*key).write.mode(mode)
        out.parquet(f"{root}/{name}.parquet")


def overwrite_touched(spark, path: str, changes, columns: list[str], keys: list[str] | None = None, part: str = MONTH) -> list:
    """S7 on a table stored by ``part``: overwrite ``columns`` of the rows that
    ``changes`` (one row per key) names, writing only the folders that hold such a
    row. Returns these folders' values (a bounded list: one for each month).

    The touched folders' new rows are written apart first, then put in place of
    those folders alone (dynamic partition overwrite), so other folders keep their
    files, and a run that is repeated gives the same table."""
    from kipmart.plans.materialize import write_temp_table
    from kipmart.plans.upsert import merge_update
    keys = keys or ["id"]
    stored = spark.read.parquet(path)
    touched = [r[0] for r in stored.join(changes.select(*keys), keys, "left_semi").select(part).distinct().collect()]
    if not touched:
        return []
    here = F.col(part).isin([v for v in touched if v is not None])
    if None in touched:
        here = F.coalesce(here, F.lit(True))
    merged = write_temp_table(merge_update(stored.filter(here), changes, keys, columns), "kipmart-touched")
    (merged.select(stored.columns).repartitionByRange(F.col(part), *map(F.col, keys)).sortWithinPartitions(part, *keys)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path))
    return sorted(touched, key=lambda v: (v is None, v))


def mixed_versions(versions: list, defaults: dict):
    """One table from tables written before and after a migration. A column that
    a version lacks gets its declared default there; a stored NULL stays NULL."""
    from functools import reduce

    from kipmart.operators.changes import with_defaults
    full = [with_defaults(v, defaults) for v in versions]
    names = [c for i, v in enumerate(full) for c in v.columns if not any(c in w.columns for w in full[:i])]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), full).select(names)


def read_versions(spark, folders: list[str], defaults: dict):
    """:func:`mixed_versions` of Parquet folders, one for each version."""
    return mixed_versions([spark.read.parquet(f) for f in folders], defaults)
