"""Numbering helpers equal the window functions they replace, also when one
key holds a third of the rows and spans several sort partitions."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from kipmart.plans.ids import number_within, sequence_number


def _data(spark):
    return spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"),
        ((F.col("id") * 7919) % 100003).alias("v"), F.col("id"))


def test_number_within_matches_row_number_with_hot_key(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = _data(spark)
        got = number_within(df, ["k"], [F.col("v"), F.col("id")], "rn")
        want = df.withColumn("rn2", F.row_number().over(Window.partitionBy("k").orderBy("v", "id")))
        j = got.join(want, ["k", "v", "id"])
        assert j.count() == 30000
        assert j.filter("rn <> rn2").count() == 0
        # the hot key really was spread over several partitions of the sort
        assert df.orderBy("k", "v", "id").select(F.spark_partition_id().alias("p")) \
            .distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_sequence_number_is_dense_and_ordered(spark):
    df = _data(spark)
    got = sequence_number(df, [F.col("v"), F.col("id")], 100, "n")
    want = df.withColumn("n2", F.row_number().over(Window.orderBy("v", "id")) + 99)
    j = got.join(want, ["k", "v", "id"])
    assert j.filter("n <> n2").count() == 0
    r = got.agg(F.min("n"), F.max("n"), F.count_distinct("n")).collect()[0]
    assert tuple(r) == (100, 30099, 30000)
