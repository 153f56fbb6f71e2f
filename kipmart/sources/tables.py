"""Table scans. Parquet (tests, lakes) or JDBC (a live shop database).

:class:`Shop` is the namespace ``T`` every operator takes. Attribute access
returns a lazy DataFrame; nothing is read until an action runs, and Catalyst
prunes columns and pushes filters into each scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kipmart.sources.adapter import RAW_TABLES, VIEWS

SHOP_TABLES = ("shop_orders", "shop_items", "shop_products", "shop_categories",
               "shop_product_images", "shop_members")

# Short attribute names for the shop tables.
ALIASES = {
    "orders": "shop_orders",
    "items": "shop_items",
    "products": "shop_products",
    "categories": "shop_categories",
    "product_images": "shop_product_images",
    "members": "shop_members",
}


# The tables' names in the shop's database.
JDBC_TABLES = {
    "shop_orders": "orders",
    "shop_items": "order_items",
    "shop_products": "products",
    "shop_categories": "categories",
    "shop_product_images": "product_images",
    "shop_members": "members",
}
#: Tables that one task must never read alone.
JDBC_FACTS = ("shop_orders", "shop_items")


def jdbc_options(name: str, jdbc: dict) -> dict:
    """Arguments of :func:`read_jdbc` for one table. ``jdbc["bounds"]`` gives
    (lowest, highest) id by table; order and line tables need one."""
    bounds = jdbc.get("bounds", {}).get(name)
    if bounds is None and name in JDBC_FACTS:
        raise ValueError(f"give jdbc bounds (lowest and highest id) of {name}")
    low, high = bounds or (None, None)
    return {**{k: v for k, v in jdbc.items() if k != "bounds"}, "lower_bound": low, "upper_bound": high}


class Shop:
    """Lazily built shop tables and change batches over one data folder.

    ``kind="fixture"``: derive the shop tables from the driver's tables with the
    adapter SQL. ``kind="parquet"``: the folder already holds ``shop_*`` tables.
    ``kind="jdbc"``: read them from a database (``jdbc`` = url, properties,
    num_partitions, and ``bounds``: the id range of each table to split).
    """

    def __init__(self, spark: SparkSession, path: str, kind: str = "fixture",
                 jdbc: dict | None = None, raw_path: str | None = None,
                 materialize: bool = False):
        self.spark = spark
        # fixture only: write each derived shop table once (clustered Parquet
        # under spark.checkpoint.dir) and let every query scan that
        self.materialize = materialize
        self.path = path.rstrip("/")
        self.kind = kind
        self.jdbc = jdbc or {}
        # where the driver tables behind the change batches live (default: path)
        self.raw_path = (raw_path or path).rstrip("/")
        self._cache: dict[str, DataFrame] = {}

    # raw driver table
    def raw(self, name: str) -> DataFrame:
        key = "raw:" + name
        if key not in self._cache:
            self._cache[key] = self.spark.read.parquet(f"{self.raw_path}/{name}.parquet")
        return self._cache[key]

    def table(self, name: str) -> DataFrame:
        """A driver table, shop table or change batch by its full name."""
        if name in self._cache:
            return self._cache[name]
        if name in RAW_TABLES:
            return self.raw(name)
        if self.kind == "parquet" and name in SHOP_TABLES:
            df = self.spark.read.parquet(f"{self.path}/{name}.parquet")
        elif self.kind == "jdbc" and name in SHOP_TABLES:
            df = read_jdbc(self.spark, JDBC_TABLES[name], **jdbc_options(name, self.jdbc))
        else:
            view = VIEWS[name]
            args = {d: self.table(d) for d in view.deps}
            df = (view.spark_fn(**args) if view.spark_fn is not None
                  else self.spark.sql(view.text("spark"), **args))
            if self.materialize and name in SHOP_TABLES:
                df = self._store(name, df)
        self._cache[name] = df
        return df

    def _store(self, name: str, df: DataFrame) -> DataFrame:
        from pyspark.sql import functions as F

        from kipmart.plans.materialize import write_temp_table
        from kipmart.sources.layout import CLUSTER
        key = CLUSTER[name]
        if not VIEWS[name].in_order:
            df = df.repartitionByRange(*map(F.col, key))
        return write_temp_table(df.sortWithinPartitions(*key), f"kipmart-{name}")

    def derived(self, name: str, build):
        """A result derived from these tables, built once per namespace (e.g. a
        change batch applied once and read by several outputs)."""
        key = "derived:" + name
        if key not in self._cache:
            self._cache[key] = build(self)
        return self._cache[key]

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        try:
            return self.table(ALIASES.get(name, name))
        except KeyError as e:  # pragma: no cover - typo guard
            raise AttributeError(name) from e


def load_shop(spark: SparkSession, path: str, kind: str = "fixture", raw_path: str | None = None,
              materialize: bool = False, **jdbc) -> Shop:
    return Shop(spark, path, kind, jdbc or None, raw_path, materialize)


def read_jdbc(spark: SparkSession, table: str, url: str, properties: dict | None = None,
              partition_column: str = "id", lower_bound: int | None = None,
              upper_bound: int | None = None, num_partitions: int = 64) -> DataFrame:
    """Parallel JDBC scan: ``num_partitions`` range reads on ``partition_column``.

    Without bounds the table is read by one task, which only suits small
    dimension tables.
    """
    return spark.read.format("jdbc").options(**jdbc_reader_options(
        table, url, properties, partition_column, lower_bound, upper_bound, num_partitions)).load()


def jdbc_reader_options(table: str, url: str, properties: dict | None = None, partition_column: str = "id",
                        lower_bound: int | None = None, upper_bound: int | None = None,
                        num_partitions: int = 64) -> dict[str, str]:
    """The options of that scan. Timestamps come without a zone, as the stored
    tables have them, so that a ``created_at`` range reaches the database."""
    options = {"url": url, "dbtable": table, "preferTimestampNTZ": "true", **(properties or {})}
    if lower_bound is not None and upper_bound is not None:
        options |= {"partitionColumn": partition_column, "lowerBound": str(lower_bound),
                    "upperBound": str(upper_bound), "numPartitions": str(num_partitions)}
    return options


class InlineShop(Shop):
    """A namespace over given DataFrames (tests and callers holding their own
    tables); names not given fall back to an underlying folder when one is set."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], path: str = ""):
        super().__init__(spark, path or "/nonexistent", "fixture")
        for k, v in tables.items():
            self._cache[ALIASES.get(k, k)] = v
