"""Category requests judged after the requests before them (U11, replayed).

``apply_category_changes`` checks a batch against the table before it. Here a request
sees what earlier ones left: A may take B's name once B is called C, a name is
free again after its category's delete, and requests may name categories that
the same log inserts.

Whether a request is refused depends on which earlier ones were. All decisions
are made at once, from the names' timelines under the decisions of the round
before, until a round changes none. A decision only depends on earlier requests,
so after n rounds those with fewer than n dependences before them are right, and
what no longer changes is what handling one request at a time gives.

A round has no group in one task: the holders of a name are a running sum along
the name (:mod:`kipmart.plans.scan`), a category's name at a moment is an as-of
join, new ids are a sorted numbering.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kipmart.functions import text as X
from kipmart.operators.catalog import name_key
from kipmart.operators.changes import _int, _next_id, with_defaults
from kipmart.plans.ids import sequence_number
from kipmart.plans.materialize import write_temp_table
from kipmart.plans.scan import Maps, asof_join, local_scan, with_carry
from kipmart.plans.upsert import latest_per_key


def _plus(f: Maps, g: Maps) -> Maps:
    return (f[0] + g[0],)


def _judged_alone(T, log: DataFrame) -> DataFrame:
    """The requests with the reasons that need no other request."""
    used = T.products.groupBy(F.col("category_id").cast("bigint").alias("id")).agg(F.count(F.lit(1)).alias("__used"))
    ch = with_defaults(log, {"description": ("string", None)})
    ch = ch.select("seq", "op", _int(F.col("id")).alias("id"), "name", "description").join(used, "id", "left")
    op, no_id = F.col("op"), F.coalesce(F.col("id"), F.lit(0)) == 0
    reason = (F.when((op == "insert") & X.is_falsy(F.col("name")), "name required")
              .when((op == "update") & (no_id | X.is_falsy(F.col("name"))), "missing data")
              .when((op == "delete") & no_id, "missing id")
              .when((op == "delete") & (F.coalesce(F.col("__used"), F.lit(0)) > 0), "has products")
              .when(~F.coalesce(op.isin("insert", "update", "delete"), F.lit(False)), "unknown op"))
    return ch.select("seq", "op", "id", "name", name_key(F.col("name")).alias("key"), X.php_trim(F.col("name")).alias("stored"),
                     X.php_trim(F.coalesce("description", F.lit(""))).alias("description"), reason.alias("reason"))


def _lives(T, base: DataFrame, asks: DataFrame, deletes: DataFrame, start_id: int | None):
    """(id, born, died, name, description) of every category under the decisions,
    and the renames that found theirs."""
    kept = asks.filter(~F.col("refused"))
    births = sequence_number(kept.filter(F.col("op") == "insert").select("seq", "stored", "description"), [F.col("seq").asc()],
                             _next_id(T.categories, start_id), "id")
    every = base.select("id", F.lit(-1).cast("bigint").alias("born"), "name", "description").unionByName(
        births.select("id", F.col("seq").alias("born"), F.col("stored").alias("name"), "description"))
    died = deletes.join(every.select("id", "born"), "id").filter(F.col("seq") > F.col("born")) \
        .groupBy("id").agg(F.min("seq").alias("died"))
    every = write_temp_table(every.join(died, "id", "left"), "kipmart-categories")
    renames = kept.filter(F.col("op") == "update").select("seq", "id", "stored", "description") \
        .join(every.select("id", "born", "died"), "id") \
        .filter((F.col("seq") > F.col("born")) & (F.col("died").isNull() | (F.col("seq") < F.col("died"))))
    return every, renames


def _refused(asks: DataFrame, every: DataFrame, renames: DataFrame) -> DataFrame:
    """The asks with ``refused`` decided anew and ``was``, the decision before."""
    # a category's names in turn; places are doubled, so a request looks just before itself
    history = every.select("id", F.col("born").alias("at"), name_key(F.col("name")).alias("key")) \
        .unionByName(renames.select("id", F.col("seq").alias("at"), name_key(F.col("stored")).alias("key"))) \
        .unionByName(every.filter("died is not null").select("id", F.col("died").alias("at"), F.lit(None).cast("string").alias("key")))
    looks = history.select("id", (2 * F.col("at") - 1).alias("at"), F.lit(None).cast("bigint").alias("seq"), F.col("key").alias("next")) \
        .unionByName(asks.filter(F.col("op") == "update").select("id", (2 * F.col("seq") - 1).alias("at"), "seq",
                                                                F.lit(None).cast("string").alias("next")))
    seen = write_temp_table(asof_join(looks, history.withColumn("at", 2 * F.col("at")), ["id"], ["at"], "old")
                            .select("id", "at", "seq", "next", F.col("old.key").alias("before")), "kipmart-names")
    moved = seen.filter("seq is null")
    at = (F.col("at") + 1).alias("at")
    steps = moved.filter("next is not null").select(F.col("next").alias("key"), at, F.lit(1).alias("delta")) \
        .unionByName(moved.filter("before is not null").select(F.col("before").alias("key"), at, F.lit(-1).alias("delta"))) \
        .withColumn("ask", F.lit(None).cast("bigint"))
    marks = asks.select("key", (2 * F.col("seq") - 1).alias("at"), F.lit(0).alias("delta"), F.col("seq").alias("ask"))
    sums = with_carry(local_scan(steps.unionByName(marks), ["key"], [F.col("at")], ["delta"], ["held"],
                                 lambda d: (d.astype(np.int64),), _plus), ["held"], _plus)
    held = sums.filter("ask is not null").select(F.col("ask").alias("seq"), (F.col("held") + F.coalesce("__c_held", F.lit(0))).alias("held"))
    own = seen.filter("seq is not null").select("seq", F.col("before").alias("own"))
    out = asks.withColumnRenamed("refused", "was").join(held, "seq").join(own, "seq", "left")
    mine = F.coalesce(F.col("own") == F.col("key"), F.lit(False)).cast("int")
    return write_temp_table(out.withColumn("refused", F.col("held") - mine > 0).drop("held", "own"), "kipmart-asks")


def replay_category_log(T, log: DataFrame, start_id: int | None = None) -> dict:
    """``requests`` (seq, op, id, name, status, reason), ``categories`` (id, name,
    description) after the log, and ``rounds`` (how many were needed).

    ``seq`` is unique. A rename or delete of a category that is not there (any
    more, or yet) is applied to nothing, as in the reference; a name is compared as it was
    sent, without case and trailing blanks, with names as they are stored."""
    base = with_defaults(T.categories, {"description": ("string", None)}) \
        .select(_int(F.col("id")).alias("id"), "name", "description")
    alone = write_temp_table(_judged_alone(T, log), "kipmart-requests")
    fine = alone.filter(F.col("reason").isNull())
    deletes = fine.filter(F.col("op") == "delete").select("id", "seq")
    asks = fine.filter(F.col("op") != "delete").withColumn("refused", F.lit(False))
    rounds = 0
    while True:
        rounds += 1
        every, renames = _lives(T, base, asks, deletes, start_id)
        asks = _refused(asks.drop("was"), every, renames)
        if asks.filter(F.col("refused") != F.col("was")).isEmpty():
            break
    last = latest_per_key(renames.select("id", "seq", F.col("stored").alias("__name"), F.col("description").alias("__text")), ["id"])
    table = every.filter("died is null").join(last, "id", "left").select(
        "id", F.when(F.col("seq").isNotNull(), F.col("__name")).otherwise(F.col("name")).alias("name"),
        F.when(F.col("seq").isNotNull(), F.col("__text")).otherwise(F.col("description")).alias("description"))
    why = alone.join(asks.filter("refused").select("seq", F.lit("duplicate name").alias("__why")), "seq", "left")
    reason = F.coalesce("reason", "__why")
    requests = why.select("seq", "op", "id", F.when(F.col("op") == "delete", F.col("name")).otherwise(F.col("stored")).alias("name"),
                          F.when(reason.isNull(), "applied").otherwise("rejected").alias("status"), reason.alias("reason"))
    return {"requests": requests, "categories": table, "rounds": rounds}
