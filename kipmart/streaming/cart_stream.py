"""K3 streaming form: carts kept up to date from an event stream.

``readStream`` of cart events → ``groupBy(cart_id)`` →
``applyInPandasWithState``: the per-cart state is the cart's current lines
(bounded by the distinct product/colour pairs of one cart, not by its event
count). Each micro-batch folds the cart's new events in ``seq`` order and
emits the touched carts' lines; a line that disappeared is emitted once with
``qty = 0`` (a tombstone for upsert sinks). A cart never expires, as in the
shop. Experimental: the fold runs row by row in Python, and all events of a cart
in one micro-batch meet in one task; the batch form has neither limit.

Ordering: events of one cart must arrive in ``seq`` order across
micro-batches (within a batch they are sorted). Late events of a cart are
applied when they arrive. The batch form (:func:`kipmart.operators.cart.cart_replay`)
is the reference for a complete history.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT_SCHEMA = T.StructType([
    T.StructField("cart_id", T.LongType()),
    T.StructField("seq", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("color", T.StringType()),
    T.StructField("action", T.StringType()),
    T.StructField("qty", T.LongType()),
    T.StructField("price", T.DecimalType(15, 2)),
])

OUTPUT_SCHEMA = T.StructType([
    T.StructField("cart_id", T.LongType()),
    T.StructField("product_id", T.LongType()),
    T.StructField("color", T.StringType()),
    T.StructField("qty", T.LongType()),
    T.StructField("price", T.StringType()),
    T.StructField("last_seq", T.LongType()),
])

STATE_SCHEMA = T.StructType([T.StructField("lines", T.StringType()),
                             T.StructField("last_seq", T.LongType())])


def _apply(lines: dict, ev) -> None:
    """One event on one cart (the shop front's rules)."""
    key = f"{int(ev.product_id)}\u0001{ev.color or ''}"
    a = ev.action
    if a == "clear":
        lines.clear()
    elif a == "add":
        if key in lines:
            lines[key][0] += int(ev.qty)
        else:
            lines[key] = [int(ev.qty), str(ev.price)]
    elif a == "remove":
        lines.pop(key, None)
    elif a == "set":
        if int(ev.qty) < 1:
            lines.pop(key, None)
        elif key in lines:
            lines[key][0] = int(ev.qty)


def _make_fold():
    def fold_cart(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (cart_id,) = key
        lines, last_seq = {}, -1
        if state.exists:
            raw, last_seq = state.get
            lines = json.loads(raw)
        before = set(lines)
        batch = pd.concat(list(pdfs), ignore_index=True).sort_values("seq", kind="stable")
        for ev in batch.itertuples(index=False):
            _apply(lines, ev)
            last_seq = max(last_seq, int(ev.seq))
        state.update((json.dumps(lines), last_seq))
        rows = []
        for k, (q, p) in lines.items():
            pid, color = k.split("\u0001", 1)
            rows.append((cart_id, int(pid), color, q, p, last_seq))
        for k in before - set(lines):
            pid, color = k.split("\u0001", 1)
            rows.append((cart_id, int(pid), color, 0, None, last_seq))
        if rows:
            yield pd.DataFrame(rows, columns=[f.name for f in OUTPUT_SCHEMA.fields])
    return fold_cart


def cart_updates(events: DataFrame) -> DataFrame:
    """Streaming (or batch) DataFrame of cart events → cart line updates."""
    ev = events.select(*[f.name for f in EVENT_SCHEMA.fields])
    return ev.groupBy("cart_id").applyInPandasWithState(
        _make_fold(), OUTPUT_SCHEMA, STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def read_cart_events(spark, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    """File-source stream of cart events (Parquet), schema given, no inference."""
    return (spark.readStream.schema(EVENT_SCHEMA)
            .option("maxFilesPerTrigger", max_files_per_trigger).parquet(path))

