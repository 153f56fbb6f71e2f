"""Memory of Python workers that go from step to step (the pipeline's stages)."""

import tracemalloc

import numpy as np
import pyarrow as pa

from kipmart.llm import common, textvec, wordcoder


def test_memory_of_hashing_does_not_grow_with_the_block():
    rng = np.random.RandomState(3)
    buffer = rng.randint(97, 123, 6 << 20).astype(np.uint8)
    start = np.flatnonzero(rng.rand(len(buffer)) < 0.1)
    start = start[(start < 1 << 20) | (start > 3 << 20)]  # one range longer than a part
    end = np.append(start[1:], len(buffer))
    kept = [len(p) for p in textvec._powers]
    tracemalloc.start()
    got = textvec.range_hash(buffer, start, end, exact=True)
    peak = tracemalloc.get_traced_memory()[1] - got.nbytes
    tracemalloc.stop()
    assert peak < 16 * len(buffer)
    assert max(len(p) for p in textvec._powers) <= max(1 << 22, *kept)
    for i in [0, 1, 5000, len(start) - 1, *np.flatnonzero(end - start > 1 << 20)]:
        one = buffer[start[i]:end[i]]
        assert textvec.range_hash(one, np.array([0]), np.array([len(one)]), exact=True)[0] == got[i]
    again = np.concatenate([buffer, buffer])
    assert (textvec.range_hash(again, np.append(start, start + len(buffer)), np.append(end, end + len(buffer)), exact=True)
            == np.append(got, got)).all()


def test_a_worker_drops_its_coder_for_another_step():
    path = common.vocabulary("word_bpe_49k.json")
    kept = wordcoder.coder(path)
    batch = pa.RecordBatch.from_pydict({"text": ["a b", None]})
    assert list(common.blocks([batch], "text", common.TOKEN_BLOCK_BYTES)) and wordcoder.coder(path) is kept
    assert list(common.blocks([batch], "text")) and not common.coders
