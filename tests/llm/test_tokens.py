import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from helpers import ODD, SF, docs_of
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kipmart.llm import common
from kipmart.llm import op1_token_output as op1
from kipmart.llm import op3_packing as op3
from kipmart.llm import op6_token_counts as op6
from kipmart.llm.wordcoder import coder

PARTS = ["a", "b", "The", " ", "  ", "\n", "\t", "\r", "\xa0", "\x1c", "\x85", "é", "É", "é", "1", "23", "!", "$$",
         "'s", "'ll", "<|endoftext|>", "<|startoftext|>", "Σ", "ß", "漢字", "😀", "​", "İ", "ﬁ", "_", "|", "̸", "=",
         " ", "　", "—", " word", ", ", ". ", " über", " The.", "<|"]


def library(name):
    return Tokenizer.from_file(common.vocabulary(name))


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_library_s_ids(name):
    rng, tok, code = random.Random(4), library(name), coder(common.vocabulary(name))
    for _ in range(60):
        texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 40))) for _ in range(20)]
        buffer, offs = common.text_buffer(pa.array(texts))
        ids, at = code.encode(buffer, offs)
        want = [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
        assert [ids[a:z].tolist() for a, z in zip(at, at[1:])] == want
        assert code.lengths(buffer, offs).tolist() == [len(w) for w in want]


def test_counts_of_odd_texts(spark):
    tok = library("byte_bpe_50k.json")
    got = op6.token_counts(docs_of(spark, ODD)).collect()
    want = sorted((i or 0, len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD)
    assert sorted((r.id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert op6.token_counts(docs_of(spark, [])).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    tok, path = library("byte_bpe_50k.json"), f"file://{tmp_path}/t"
    op1.write_tokens(docs_of(spark, ODD).repartition(3), path)
    rows = sorted(op1.read_tokens(spark, path).collect(), key=lambda r: r.start)
    ids = [r.doc_id for r in rows]
    assert ids == sorted(ids, key=lambda i: -1 if i is None else i)
    at = 0
    texts = {i: t for i, t in ODD}
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.tokens)
        assert r.tokens == tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [0]
        at += r.n_tokens
    some = op1.read_tokens(spark, path, [7]).collect()
    assert [(r.doc_id, r.start) for r in some] == [(r.doc_id, r.start) for r in rows if r.doc_id == 7]


def test_token_files_have_the_encodings_and_page_indexes(spark, tmp_path):
    op1.write_tokens(common.read(spark, SF, "documents"), f"file://{tmp_path}/t")
    group = pq.ParquetFile(next((tmp_path / "t").rglob("*.parquet"))).metadata.row_group(0)
    columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
    tokens = next(c for p, c in columns.items() if p.startswith("tokens"))
    assert {"RLE_DICTIONARY", "DELTA_BINARY_PACKED"} & set(tokens.encodings)
    assert columns["doc_id"].has_column_index and columns["doc_id"].has_offset_index


def test_token_files_of_no_documents(spark, tmp_path):
    op1.write_tokens(docs_of(spark, []), f"file://{tmp_path}/t")
    assert op1.read_tokens(spark, f"file://{tmp_path}/t").count() == 0


def test_lower_bound_holds_for_best_fit():
    rng = np.random.RandomState(2)
    for capacity in (7, 10, 64):
        for _ in range(60):
            lengths = -np.sort(-rng.randint(1, capacity + 1, rng.randint(1, 12)))
            bins, offsets, loads = op3.best_fit(lengths, capacity)
            assert (loads <= capacity).all() and np.bincount(bins, lengths).tolist() == loads.tolist()
            bound = op3.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
            assert bound <= optimum(lengths.tolist(), capacity) <= len(loads)


def optimum(lengths, capacity):
    best = len(lengths)

    def place(i, loads):
        nonlocal best
        if len(loads) >= best:
            return
        if i == len(lengths):
            best = len(loads)
            return
        for k in {load: k for k, load in enumerate(loads) if load + lengths[i] <= capacity}.values():
            loads[k] += lengths[i]
            place(i + 1, loads)
            loads[k] -= lengths[i]
        place(i + 1, [*loads, lengths[i]])

    place(0, [])
    return best


@pytest.mark.parametrize("rows_per_task", [40, 50_000])
def test_packing(spark, rows_per_task):
    pieces = common.stored(op3.token_pieces(common.read(spark, SF, "documents")), "pieces")
    packed = op3.pack(pieces, rows_per_task=rows_per_task)
    rows = packed.toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(zip(rows.doc_id, rows.piece)) == sorted((r.doc_id, r.piece) for r in pieces.collect())
    total = rows.groupby("sequence_id").length
    assert total.sum().max() <= 2048 and (rows.offset == total.cumsum() - rows.length).all()
    sure = op3.certificate(packed)
    assert sure["lower_bound"] <= sure["sequences"] <= sure["lower_bound"] + 2


def test_rounding_bounds():
    assert op3.lower_bound(np.bincount([700, 800, 900, 1000] * 50, minlength=2049), 2048) == 100
    assert op3.lower_bound(np.bincount([1024] * 9, minlength=2049), 2048) == 5


@pytest.mark.parametrize("kind", ["two a bin", "third copies", "small"])
def test_no_task_gets_more_than_its_rows(spark, monkeypatch, kind):
    rng = np.random.RandomState(6)
    lengths = {"two a bin": rng.randint(700, 1001, 3000),
               "third copies": np.where(np.arange(3000) % 3 == 0, 700, rng.randint(300, 1001, 3000)),
               "small": rng.randint(1, 60, 3000)}[kind]
    frame = spark.createDataFrame([(i, int(k)) for i, k in enumerate(lengths)], "doc_id long, length long")
    sizes = []
    keep = common.stored
    monkeypatch.setattr(op3.common, "stored", lambda df, name: sizes.append((df.groupBy(F.spark_partition_id()).count().agg(
        F.max("count")).first()[0])) or keep(df, name))
    rows = op3.pack(frame, rows_per_task=200).toPandas().sort_values(["sequence_id", "offset"])
    assert sorted(rows.doc_id) == list(range(3000))
    total = rows.groupby("sequence_id").length
    assert total.sum().max() <= 2048 and (rows.offset == total.cumsum() - rows.length).all()
    assert max(sizes) <= 240  # dealt in turn by each source partition, so not to the row
    assert total.ngroups <= len(op3.best_fit(np.sort(lengths)[::-1], 2048)[2]) * 1.02 + 1


def test_pieces_and_sequences_of_odd_texts(spark):
    tok = library("word_bpe_49k.json")
    pieces = common.stored(op3.token_pieces(docs_of(spark, ODD), with_ids=True), "pieces")
    rows = pieces.collect()
    texts = {i: tok.encode(t or "", add_special_tokens=False).ids + [0] for i, t in ODD}
    assert sum(r.length for r in rows) == sum(len(texts[i]) for i, _ in ODD)
    for r in rows:
        ids = texts[r.doc_id][r.start:r.start + r.length]
        assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.start == 2048 * r.piece
    whole = op3.sequences(op3.pack(pieces)).collect()
    assert sum(len(s.ids) for s in whole) == sum(r.length for r in rows)
    assert all(len(s.ids) == sum(s.lengths) <= 2048 for s in whole)
    assert op3.pack(pieces.limit(0)).count() == 0
