"""Streaming cart fold agrees with the batch replay."""

import tempfile
from decimal import Decimal

from pyspark.sql import functions as F

from kipmart.operators.cart import cart_replay
from kipmart.streaming.cart_stream import cart_updates, read_cart_events


def test_stream_matches_batch_replay(spark, shop):
    ev = shop.table("cart_events")
    src = tempfile.mkdtemp(prefix="cart-src-")
    ckpt = tempfile.mkdtemp(prefix="cart-ckpt-")
    # two files in seq order, so the stream sees two micro-batches in order
    cut = ev.agg(F.percentile_approx("seq", 0.5)).collect()[0][0]
    ev.filter(F.col("seq") <= cut).coalesce(1).write.mode("append").parquet(src)
    ev.filter(F.col("seq") > cut).coalesce(1).write.mode("append").parquet(src)
    q = (cart_updates(read_cart_events(spark, src, max_files_per_trigger=1))
         .writeStream.format("memory").queryName("cart_updates_test").outputMode("update")
         .option("checkpointLocation", ckpt).trigger(availableNow=True).start())
    q.awaitTermination(300)
    out = spark.sql("select * from cart_updates_test").collect()
    assert len({r.last_seq for r in out}) > 1
    latest = {}
    for r in sorted(out, key=lambda r: r.last_seq):
        latest[(r.cart_id, r.product_id, r.color)] = r
    got = {k: (r.qty, Decimal(r.price)) for k, r in latest.items() if r.qty > 0}
    want = {(r.cart_id, r.product_id, r.color): (r.qty, r.price) for r in cart_replay(ev).collect()}
    assert got == want
