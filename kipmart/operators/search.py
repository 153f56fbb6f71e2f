"""F6 in bulk: many product searches at once.

One search is a scan (``catalog.product_listing(search=…)``); many are not many
scans but joins over a posting table of the products' letters.

* Each pattern gives the pieces of letters between its wildcards; its grams are
  their substrings of ``L`` letters, ``L`` the length of the longest piece, three
  at most, and the one empty gram where it has wildcards only (or is empty).
* Only grams that a pattern asks for are posted: one row per product that has
  the gram in its lower-case name or description (the empty one: any of the two).
* A pattern's candidates are the products of its rarest gram, by the number of
  its products; each is then checked with the whole pattern.

A product that matches has every gram of the pattern, so none is lost, also for
patterns under three letters and with wildcards (V14). The patterns' grams and the
postings are written once under ``spark.checkpoint.dir``. All steps are equi-joins
on grams: a hot one is the result's own size where a pattern is no longer than
its gram, and AQE splits it, as both sides come straight from a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kipmart.plans.materialize import write_temp_table

#: Letters of a gram at most.
GRAM = 3


def like_pattern(search: Column) -> Column:
    """User text as a LIKE pattern, ``%`` and ``_`` in it wildcards. A backslash
    before anything but a wildcard or a backslash stands for nothing (MySQL)."""
    return F.regexp_replace(F.concat(F.lit("%"), search, F.lit("%")), r"(\\[%_\\])|\\", "$1")


def _substrings(text: Column, size: Column) -> Column:
    """All substrings of ``size`` letters; none if the text is shorter."""
    n = F.char_length(text) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(text, i, size))) \
        .otherwise(F.array().cast("array<string>"))


def pattern_grams(pattern: Column) -> Column:
    """The grams that each match of a LIKE pattern holds, all of one length."""
    pieces = F.split(F.lower(pattern), r"\\.|[%_]")
    size = F.least(F.lit(GRAM), F.array_max(F.transform(pieces, F.char_length)))
    grams = F.array_distinct(F.flatten(F.transform(pieces, lambda p: _substrings(p, size))))
    return F.when(size > 0, grams).otherwise(F.array(F.lit("")))


def text_grams(text: Column) -> Column:
    """All grams of a text, the empty one too; null has none."""
    sizes = [_substrings(F.lower(text), F.lit(n)) for n in range(1, GRAM + 1)]
    return F.when(text.isNotNull(), F.array_distinct(F.concat(F.array(F.lit("")), *sizes))) \
        .otherwise(F.array().cast("array<string>"))


def product_search_bulk(T, requests: DataFrame) -> DataFrame:
    """(search, id, name) of the active products whose name or description
    holds the text ``search`` of a request. Equal texts are searched once; a null
    text finds nothing."""
    p = T.products.where(F.col("status") == "active").select("id", "name", "description")
    asked = requests.where(F.col("search").isNotNull()).select("search").distinct() \
        .withColumn("pattern", like_pattern(F.col("search")))
    wanted = write_temp_table(
        asked.select("search", "pattern", F.explode(pattern_grams(F.col("pattern"))).alias("gram")), "kipmart-searches")
    grams = F.array_union(text_grams(F.col("name")), text_grams(F.col("description")))
    postings = write_temp_table(
        p.select("id", F.explode(grams).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"),
        "kipmart-postings")
    counts = postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = wanted.join(counts, "gram", "left").groupBy("search", "pattern") \
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("best")) \
        .where("best.n > 0").select("search", "pattern", F.col("best.gram").alias("gram"))
    found = rarest.join(postings, "gram").join(p, "id")
    return found.where(F.ilike("name", F.col("pattern")) | F.ilike("description", F.col("pattern"))) \
        .select("search", "id", "name")


def search_requests(T) -> DataFrame:
    """Stand-in for the users' searches: each product name, its words, their first
    two letters, a pattern of its ends, one letter before any letter, and none."""
    name = F.col("name")
    words = F.split(name, " ")
    texts = F.flatten(F.array(
        words, F.transform(words, lambda w: F.substr(w, F.lit(1), F.lit(2))),
        F.array(F.upper(name), F.concat(F.substr(name, F.lit(1), F.lit(2)), F.lit("%"), F.substr(name, F.lit(-3), F.lit(3))),
                F.concat(F.substr(name, F.lit(1), F.lit(1)), F.lit("_")), F.lit(""))))
    return T.products.where(name.isNotNull()).select(F.explode(texts).alias("search")).distinct()
