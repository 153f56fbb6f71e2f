"""Catalogue read model.

Categories are a dimension; products can be large. Per-category counts are
aggregated on the product side first and joined to categories afterwards, so
the join sees one row per category. The product ⟕ category join is left to
AQE, which broadcasts the category side from its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.plans.ids import sequence_number


def name_key(c: Column) -> Column:
    """MySQL's default collation ignores case and trailing blanks."""
    return F.lower(F.rtrim(c))


# ---------------------------------------------------------------------- S2
def category_by_id(T, requests: DataFrame) -> DataFrame:
    """S2 in bulk: look up every requested id (column ``id``); ``found`` is
    false for ids without a category (the reference's 404)."""
    c = T.categories.select("id", "name", "description")
    r = requests.select(F.col("id").cast("int").alias("id")).distinct()
    return (r.join(c, "id", "left")
            .withColumn("found", F.col("name").isNotNull()))


def category_requests(T) -> DataFrame:
    """Ids asked for: every category id used by a product plus the ids named in
    the category change batch (some do not exist)."""
    used = T.products.select(F.col("category_id").alias("id")).where(F.col("id").isNotNull())
    asked = T.table("chg_categories").select("id").where(F.col("id").isNotNull())
    return used.unionByName(asked)


# ---------------------------------------------------------------------- A1/A2
def category_product_counts(T) -> DataFrame:
    """Active products per category; empty categories show 0. The
    ``status='active'`` predicate belongs to the join's product side, never
    after the join."""
    counts = (T.products.filter(F.col("status") == "active")
              .groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count")))
    c = T.categories
    return (c.join(counts, c.id == counts.category_id, "left")
            .select(c.id, c.name, c.description,
                    F.coalesce(F.col("product_count"), F.lit(0)).alias("product_count"))
            .orderBy("name", "id"))


def deletable_categories(T) -> DataFrame:
    """Categories with no product of any status (delete allowed)."""
    used = (T.products.where(F.col("category_id").isNotNull())
            .groupBy(F.col("category_id").alias("id")).agg(F.count(F.lit(1)).alias("__n")))
    return (T.categories.join(used, "id", "left").filter(F.col("__n").isNull())
            .select("id", "name", "description"))


# ------------------------------------------------------------------- A6 / J8
def category_name_duplicates(T) -> DataFrame:
    """Normalised names held by more than one category."""
    c = T.categories
    return (c.groupBy(name_key(F.col("name")).alias("name_key"))
            .agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("min_id"),
                 F.max("id").alias("max_id"))
            .filter(F.col("n") > 1))


def category_name_conflicts(T) -> DataFrame:
    """J8 in bulk: for every category, how many *other* categories share its
    normalised name. Computed from per-name counts, so a popular name costs
    one aggregate row, never a list of pairs."""
    c = T.categories.withColumn("name_key", name_key(F.col("name")))
    per_name = c.groupBy("name_key").agg(F.count(F.lit(1)).alias("n"))
    return (c.join(per_name, "name_key")
            .filter(F.col("n") > 1)
            .select("id", "name", (F.col("n") - 1).alias("n_others")))


# ----------------------------------------------------------------------- W1
def category_list_numbered(T) -> DataFrame:
    """The ``#`` column of the category list in name order."""
    c = T.categories.select("id", "name", "description")
    return sequence_number(c, [F.col("name").asc(), F.col("id").asc()], 1, "row_no")


# ----------------------------------------------------------------- C3 / F5-F6
def product_listing(T, active_only: bool = True, category: int | None = None,
                    search: str | None = None, decoded: bool = True) -> DataFrame:
    """The catalogue listing."""
    p = T.products
    if active_only:
        p = p.filter(F.col("status") == "active")
    if category is not None:
        p = p.filter(F.col("category_id") == F.lit(category))
    if search is not None:
        # User text is a LIKE pattern; no escaping, case-insensitive
        pat = f"%{search}%"
        p = p.filter(F.col("name").ilike(pat) | F.col("description").ilike(pat))
    c = T.categories.select(F.col("id").alias("cid"), F.col("name").alias("category_name"))
    j = p.join(c, p.category_id == c.cid, "left").drop("cid")
    extra = {"image_url": F.col("image"),
             "name_lo": F.col("name"),  # V15: overwrites the stored name_lo
             "category_name_lo": F.col("category_name"),
             "old_price": F.lit(None).cast("decimal(12,2)"),
             "is_new": F.lit(False)}
    if decoded:
        extra.update(colors=X.decode_colors("colors"), sizes=X.decode_sizes("sizes"))
    out = j.withColumns(extra)
    return out.orderBy(F.col("sort_order").asc_nulls_last(), F.col("created_at").desc(),
                       F.col("id").asc())


def listing_as_text(df: DataFrame) -> DataFrame:
    """Lists as ``|``-joined text (for flat outputs and comparisons)."""
    return df.withColumns({"colors": F.array_join("colors", "|"),
                           "sizes": F.array_join("sizes", "|")})


def product_listing_total(T, **kw) -> DataFrame:
    """A4: the listing's ``total``."""
    return product_listing(T, decoded=False, **kw).agg(F.count(F.lit(1)).alias("total"))


# ----------------------------------------------------------------- C1 / C2
def product_gallery(T) -> DataFrame:
    """Main image first when set, then extra images by ``sort_order``
    (ties by id), skipping empty paths and copies of the main image."""
    p = T.products.select(F.col("id").alias("product_id"), F.col("image"))
    # A product's image rows are always written together from one edit or
    # insert request's ``extra_images`` list (U6 replaces them all, U7 inserts
    # them), so the per-product list is bounded by one request body.
    imgs = (T.product_images
            .groupBy("product_id")
            .agg(F.array_sort(F.collect_list(F.struct("sort_order", "id", "image_path")))
                 .alias("extra")))
    j = p.join(imgs, "product_id", "left")
    main = F.col("image")
    extra = F.transform(F.coalesce(F.col("extra"), F.array()), lambda s: s["image_path"])
    extra = F.filter(extra, lambda x: ~X.is_falsy(x) & (main.isNull() | (x != main)))
    head = F.when(X.is_falsy(main), F.array().cast("array<string>")).otherwise(F.array(main))
    return j.select("product_id", F.concat(head, extra).alias("images"))


def product_single(T, ids: DataFrame | None = None) -> DataFrame:
    """Full product detail (category names, decoded lists, gallery). With
    ``ids`` (column ``id``) only those products; otherwise every product."""
    p = T.products
    if ids is not None:
        p = p.join(ids.select("id").distinct(), "id", "left_semi")
    c = T.categories.select(F.col("id").alias("cid"), F.col("name").alias("category_name"))
    g = product_gallery(T).withColumnRenamed("product_id", "gid")
    j = (p.join(c, p.category_id == c.cid, "left").drop("cid")
         .join(g, F.col("id") == F.col("gid"), "left").drop("gid"))
    return j.withColumns({"image_url": F.col("image"),
                          "name_lo": F.col("name"),
                          "category_name_lo": F.col("category_name"),
                          "colors": X.decode_colors("colors"),
                          "sizes": X.decode_sizes("sizes"),
                          "old_price": F.lit(None).cast("decimal(12,2)"),
                          "is_new": F.lit(False)})


# ----------------------------------------------------------------------- F7
def parse_id_list(text: Column) -> Column:
    """``intval`` each comma item, drop zeros (array of bigint)."""
    return F.filter(F.transform(F.split(text, ","), lambda s: X.php_intval(s)),
                    lambda v: v != 0)


def check_stock(T, requests: DataFrame) -> DataFrame:
    """F7 in bulk: ``requests`` has ``request_id`` and ``ids`` (comma text).
    Each request gets id, name, stock of the products it names; an empty list
    gives no rows. The id list is a semi join, not an IN-list."""
    wanted = (requests.select("request_id", F.explode(parse_id_list(F.col("ids"))).alias("id"))
              .distinct())
    p = T.products.select("id", "name", "stock")
    return wanted.join(p, "id").select("request_id", "id", "name", "stock")


def stock_check_requests(T, most_ids: int = 100) -> DataFrame:
    """Stock-check requests derived from the incoming orders: one for each order
    (for every ``most_ids`` of its lines, if it has more), whose id text names its
    products, a zero (dropped) and its first product again (duplicates are
    harmless)."""
    from kipmart.sources.requests import _chunks
    lines = _chunks(T.table("req_order_items").select("request_id", F.col("product_id").cast("string").alias("id")),
                    ["request_id"], most_ids)
    ids = F.array_sort(F.collect_list("id"))
    return (lines.groupBy("request_id", "chunk").agg(ids.alias("ids"))
            .select(F.concat(F.col("request_id").cast("string"), F.lit("-"), F.col("chunk").cast("string")).alias("request_id"),
                    F.concat_ws(",", F.col("ids"), F.lit("0"), F.element_at("ids", 1)).alias("ids")))


# ---------------------------------------------------------------- T9 / T10
def product_colors(T) -> DataFrame:
    return T.products.select("id", F.array_join(X.decode_colors("colors"), "|").alias("colors"))


def product_sizes(T) -> DataFrame:
    return T.products.select("id", F.array_join(X.decode_sizes("sizes"), "|").alias("sizes"))


def colors_hex(T) -> DataFrame:
    """T15 over every decoded product colour."""
    return (T.products.select("id", F.posexplode(X.decode_colors("colors")).alias("pos", "color"))
            .select("id", "pos", "color", X.color_hex(F.col("color")).alias("hex")))
