"""Banner lists stored as JSON text.

A stored list mixes two shapes: a bare image string (old format) or an object
``{"img": …, "link": …}``. :func:`normalise_banners` turns either into
``array<struct<img, link>>`` with ``link = ''`` for bare strings (objects are kept as they are).
``MAX_SLIDES`` only blocks adding. Malformed JSON gives an empty list. Parsing goes through
``VARIANT`` so both shapes are read without a schema guess.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Slide cap and target box of the banner editor.
MAX_SLIDES = 8
MAX_W, MAX_H = 1920, 700


def normalise_banners(text: Column) -> Column:
    """JSON text → ``array<struct<img:string, link:string>>``, every stored slide."""
    items = F.coalesce(F.try_variant_get(F.try_parse_json(text), "$", "array<variant>"),
                       F.array().cast("array<variant>"))

    def one(v):
        as_str = F.try_variant_get(v, "$", "string")
        is_obj = F.schema_of_variant(v).startswith("OBJECT")
        img = F.when(is_obj, F.try_variant_get(v, "$.img", "string")).otherwise(as_str)
        link = F.when(is_obj, F.try_variant_get(v, "$.link", "string")).otherwise(F.lit(""))
        return F.struct(img.alias("img"), link.alias("link"))

    return F.transform(items, one)


def can_add_slide(text: Column) -> Column:
    """Whether the editor accepts another slide (stored ones are never cut)."""
    return F.size(normalise_banners(text)) < MAX_SLIDES
