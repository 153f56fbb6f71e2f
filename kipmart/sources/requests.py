"""S3: JSON request bodies as input records, read with an explicit schema.

The reference decodes one JSON body per HTTP request; here a batch of bodies
(a text column, or newline-delimited JSON files) is parsed with ``from_json``
/ ``spark.read.schema(...).json`` — no schema inference, one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kipmart.functions import text as X
from kipmart.plans.ids import number_within

#: Scalars are read as text, whatever their JSON type: the reference takes
#: ``"qty": "2"`` as well as ``"qty": 2`` and truncates ``25.5`` to 25.
_TEXT_ITEM = T.StructType([T.StructField(n, T.StringType())
                           for n in ("id", "qty", "price", "is_preorder", "color")])
CORRUPT = "_corrupt_record"
ORDER_REQUEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in (
        "request_id", "name", "phone", "address", "member_id", "items_total", "total", "shipping_fee",
        "shipping_company", "member_number", "payment_method", "note", "slip")]
    + [T.StructField("items", T.ArrayType(_TEXT_ITEM)), T.StructField(CORRUPT, T.StringType())])


def _whole(c: Column) -> Column:
    """``(int)`` of a given text; NULL stays NULL (``isset``)."""
    return F.when(c.isNotNull(), X.php_intval(c))


def _amount(c: Column) -> Column:
    """Decimal of a given text; 0 if it is no number."""
    return F.when(c.isNotNull(), F.coalesce(F.trim(c).try_cast("decimal(15,2)"), F.lit(0).cast("decimal(15,2)")))


def _typed(raw: DataFrame) -> DataFrame:
    flag = lambda c: F.when(F.coalesce(c, F.lit("")).isin("", "0", "false"), 0).otherwise(1)
    items = F.transform("items", lambda i: F.struct(
        _whole(i["id"]).alias("id"), _whole(i["qty"]).alias("qty"), _amount(i["price"]).alias("price"),
        flag(i["is_preorder"]).alias("is_preorder"), i["color"].alias("color")))
    return raw.select(
        _whole(F.col("request_id")).alias("request_id"), "name", "phone", "address",
        _whole(F.col("member_id")).alias("member_id"), _amount(F.col("items_total")).alias("items_total"),
        _amount(F.col("total")).alias("total"), _whole(F.col("shipping_fee")).alias("shipping_fee"),
        "shipping_company", "member_number", "payment_method", "note", "slip", items.alias("items"))


def _item(c=None):
    return F.struct(F.col("product_id").alias("id"), F.col("quantity").alias("qty"), "price",
                    "is_preorder")


def _chunks(lines: DataFrame, keys: list[str], most: int) -> DataFrame:
    """The lines with ``chunk``: 0 for the first ``most`` of a request, and so on."""
    numbered = number_within(lines, keys, [F.col(c) for c in lines.columns if c not in keys], "__n")
    return numbered.withColumn("chunk", F.floor((F.col("__n") - 1) / F.lit(most)).cast("int")).drop("__n")


def order_request_bodies(requests: DataFrame, lines: DataFrame, most_items: int = 100) -> DataFrame:
    """Encode request rows and their lines as JSON bodies in the shape the
    checkout page posts (header fields plus an ``items`` list). A request's
    lines are one list; one of more than ``most_items`` lines is split over several
    bodies (a real body is capped by the web server's upload limit), so no body grows
    with the data. Requests without lines have an empty list."""
    items = _chunks(lines, ["request_id"], most_items).groupBy("request_id", "chunk").agg(F.collect_list(_item()).alias("items"))
    r = requests.join(items.drop("chunk"), "request_id", "left")
    r = r.withColumn("items", F.coalesce("items", F.array().cast(r.schema["items"].dataType)))
    return r.select(F.to_json(F.struct(*[F.col(c) for c in r.columns])).alias("body"))


def _parsed(bodies: DataFrame, column: str) -> DataFrame:
    """(body, r): each body parsed once. The list of one keeps the parse apart
    from what reads its fields, so the planner does not repeat it for each."""
    body = F.col(column)
    parsed = F.from_json(body, ORDER_REQUEST, {"columnNameOfCorruptRecord": CORRUPT})
    return bodies.select(body.alias("body"), F.explode(F.array(parsed)).alias("r"))


def _bad() -> Column:
    return F.col("r").isNull() | F.col(f"r.{CORRUPT}").isNotNull()


def parse_order_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """Parse JSON bodies; unknown keys are ignored, missing keys are NULL (the
    reference's ``isset`` defaults apply later), numbers may come as text.
    Bodies that are no JSON object are in :func:`rejected_order_requests`."""
    return _typed(_parsed(bodies, column).filter(~_bad()).select("r.*"))


def rejected_order_requests(bodies: DataFrame, column: str = "body") -> DataFrame:
    """(body, reason) of the bodies that :func:`parse_order_requests` leaves out."""
    empty = F.trim(F.coalesce(F.col("body"), F.lit(""))) == ""
    return _parsed(bodies, column).filter(_bad()).select(
        "body", F.when(empty, "empty body").otherwise("malformed JSON").alias("reason"))


def read_order_requests(spark: SparkSession, path: str) -> DataFrame:
    """Newline-delimited JSON files of order requests."""
    return parse_order_requests(spark.read.text(path), "value")


def order_request_lines(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split parsed requests into (headers, lines) for :func:`place_orders`."""
    headers = parsed.drop("items")
    lines = parsed.select("request_id", F.explode("items").alias("i")).select(
        "request_id", F.col("i.id").alias("product_id"), F.col("i.qty").alias("quantity"),
        F.col("i.price").alias("price"), F.col("i.is_preorder").alias("is_preorder"))
    return headers, lines


def read_changes(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> DataFrame:
    """A change batch (one request per record) with an explicit schema; JSON
    lines by default, any file format Spark reads otherwise."""
    return spark.read.schema(schema).format(fmt).load(path)
