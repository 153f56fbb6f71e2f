"""Best-fit packing (operator 3): documents into sequences of a fixed length.

Documents longer than a sequence are cut into full pieces and a rest; nothing
else is cut. Pieces are dealt evenly over partitions of a set size; each
partition packs its own by best-fit decreasing and certifies its bin count with
a lower bound from dual feasible functions (see :func:`lower_bound`). A
partition whose count meets its bound still gives up its emptiest bin (the rounded-up
rest of its bound); one with a gap gives up more of its emptiest bins. The
documents of the given-up bins are counted, dealt over as many partitions as
``rows_per_task`` asks for, and packed again, until one partition is left, whose
bins all stay. A round that saves less than ``LEAST_SAVED`` of the bins it got shows
that its gap is the bound's, not the packing's: from then on a partition gives up
its emptiest bin only (unless one task can hold all), and all bins stay once
that brings the partitions down no further. So no task holds more than about
``rows_per_task`` pieces in any round, whatever the lengths are.

``token_pieces`` makes the pieces, ``pack`` places any (length) rows, and
``sequences`` puts the token ids of the pieces together in their order.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed each; equal lengths go in the order of id and piece; an empty table gives
no sequence; a length of 0 or over the capacity raises; null ids are packed as
any other; other columns pass through ``pack`` unless they bear its output's
names (``sequence_id``, ``offset``), which it replaces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kipmart.llm import common
from kipmart.llm.op1_token_output import append_end
from kipmart.llm.wordcoder import coder

CAPACITY = 2048
ROWS_PER_TASK = 50_000
#: Share of the exchanged bins that a round must save for as many to be exchanged again.
LEAST_SAVED = 0.01
#: Emptiest bins given up for each bin over the bound.
GIVE_UP = 8
GIVEN = "given up by op3"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_FIELDS = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                 ("length", pa.int64()), ("ids_crc32", pa.int64())]


def token_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY,
                 end_id: int | None = 0, id: str = "doc_id", text: str = "text",
                 with_ids: bool = False) -> DataFrame:
    """Pieces of every document's ids: (doc_id, piece, start, length,
    ids_crc32), and ``ids`` if asked for."""
    schema = pa.schema(_PIECE_FIELDS + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(common.vocabulary(vocabulary))
        for b in common.blocks(batches, "text", common.TOKEN_BLOCK_BYTES):
            ids, offs = append_end(*code.encode(*common.text_buffer(b.column(1))), end_id)
            size = np.diff(offs)
            n = -(-size // capacity)  # a document without any id has no piece
            row = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(size[row] - start, capacity)
            at = offs[row] + start
            columns = {"doc_id": b.column(0).take(pa.array(row)), "piece": piece.astype(np.int32), "start": start,
                       "length": length, "ids_crc32": [zlib.crc32(ids[a:a + k]) for a, k in zip(at, length)]}
            if with_ids:
                columns["ids"] = pa.ListArray.from_arrays(pa.array(np.append(at, offs[-1]).astype(np.int32)),
                                                          pa.array(ids.view(np.int32)))
            yield common.out_batch(schema, **columns)

    return docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")) \
        .mapInArrow(cut, PIECES + (", ids array<int>" if with_ids else ""))


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """A number of bins that no packing can undercut. ``counts``: number of
    items by length. The largest over all thresholds a of two dual feasible
    functions: lengths over capacity - a count as a whole bin and those under a as
    nothing; and, for lengths over half, the same with the room they leave; and
    of the rounding functions, by which a length counts as ``floor((k + 1) * length /
    capacity)`` of k parts of a bin, or as itself if nothing is rounded."""
    size = np.arange(len(counts))
    n, s = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * size)])
    best = -(-int(s[-1]) // capacity)
    a = np.arange(1, capacity // 2 + 1)
    top, half = len(counts), capacity // 2
    large = n[top] - n[np.minimum(capacity - a + 1, top)]  # over capacity - a
    middle_n = n[np.minimum(capacity - a + 1, top)] - n[np.minimum(half + 1, top)]
    middle_s = s[np.minimum(capacity - a + 1, top)] - s[np.minimum(half + 1, top)]
    small = s[np.minimum(half + 1, top)] - s[np.minimum(a, top)]
    spill = np.maximum(0, -(-(small - (middle_n * capacity - middle_s)) // capacity))
    cut = -(-(s[np.minimum(capacity - a + 1, top)] - s[np.minimum(a, top)]) // capacity) + large
    best = max(best, int((large + middle_n + spill).max()), int(cut.max()))
    for k in range(1, 101):
        parts, rest = np.divmod((k + 1) * size, capacity)
        best = max(best, -(-int((counts * np.where(rest, parts * (k + 1), parts * k)).sum()) // (k * (k + 1))))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, its offset there, load of each bin), items taken in
    the given order, each into the fullest bin that holds it."""
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms = 0  # bit r: some bin has room r
    bins, offsets, loads = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    for i, k in enumerate(lengths.tolist()):
        fit = rooms >> k
        if fit:
            r = k + (fit & -fit).bit_length() - 1
            at = open_at[r].pop()
            if not open_at[r]:
                rooms ^= 1 << r
        else:
            r, at = capacity, len(loads)
            loads.append(0)
        bins[i], offsets[i] = at, loads[at]
        loads[at] += k
        if r > k:
            open_at[r - k].append(at)
            rooms |= 1 << (r - k)
    return bins, offsets, np.array(loads, np.int64)


def _place(table: pa.Table, capacity: int, prefix: int) -> pa.Table:
    """One partition's round: sequence_id and offset of each row, and whether its
    bin is kept (0), the emptiest (1) or another one that is given up (2)."""
    lengths = table["length"].to_numpy()
    if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets, loads = best_fit(lengths[order], capacity)
    given = np.zeros(len(loads), np.int32)
    gap = len(loads) - lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
    emptiest = np.argsort(loads, kind="stable")[:1 + GIVE_UP * gap]
    emptiest = emptiest[loads[emptiest] < capacity]
    given[emptiest[:1]], given[emptiest[1:]] = 1, 2
    seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    seq[order], off[order] = bins, offsets
    return table.append_column("sequence_id", pa.array(prefix + seq)).append_column("offset", pa.array(off)) \
        .append_column(GIVEN, pa.array(given[seq]))


def pack(pieces: DataFrame, capacity: int = CAPACITY, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """The rows with ``sequence_id`` (long) and ``offset`` (long). Each round is
    written once under ``spark.checkpoint.dir``."""
    pieces = pieces.drop("sequence_id", "offset")
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()),
                           T.StructField("offset", T.LongType()), T.StructField(GIVEN, T.IntegerType())])
    done, rows, level, before, wide = None, pieces, 0, None, True
    tasks = max(1, -(-rows.count() // rows_per_task))
    given, first = F.col(f"`{GIVEN}`"), (F.col("offset") == 0).cast("long")  # one row of each bin
    while True:
        n = level

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext
            got = [b for b in batches if b.num_rows]
            if got:
                table = pa.Table.from_batches(got)
                yield from _place(table, capacity, (n << 56) + (TaskContext.get().partitionId() << 32)) \
                    .combine_chunks().to_batches()

        placed = common.stored(rows.repartition(tasks).mapInArrow(run, schema), f"packed-{level}")
        bins, emptiest, bins_emptiest, left, bins_left = (x or 0 for x in placed.agg(
            F.sum(first), F.sum((given == 1).cast("long")), F.sum(F.when(given == 1, first)),
            F.sum((given > 0).cast("long")), F.sum(F.when(given > 0, first))).first())
        if before is not None and before - bins < LEAST_SAVED * before:
            wide = False
        all_fit = left <= rows_per_task
        if not (wide or all_fit):
            left, bins_left = emptiest, bins_emptiest
        n_next = -(-left // rows_per_task)
        # with the emptiest bins only, ever fewer partitions must be left
        last = tasks == 1 or not left or not wide and n_next >= tasks
        stays = F.lit(True) if last else given == 0 if wide or all_fit else given != 1
        kept = placed.where(stays).drop(GIVEN)
        done = kept if done is None else done.unionAll(kept)
        if last:
            return done
        rows, tasks, before, level = placed.where(~stays).select(*pieces.columns), n_next, bins_left, level + 1


def certificate(packed: DataFrame, capacity: int = CAPACITY) -> dict[str, int]:
    """Number of sequences, and the lower bound of the whole (from the counts of
    lengths, at most ``capacity`` numbers)."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packed.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    n = packed.select("sequence_id").distinct().count()
    return {"sequences": n, "lower_bound": lower_bound(counts, capacity), "tokens": int((counts * np.arange(capacity + 1)).sum())}


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, doc_ids, lengths): the packed token ids, from pieces with
    ``ids``. A sequence holds at most ``capacity`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"),
        F.col("p.length").alias("lengths"))


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of these documents with their places in sequences of 2048 tokens."""
    return pack(common.stored(token_pieces(docs), "pieces"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack_documents(common.read(spark, sf_dir, "documents"))
