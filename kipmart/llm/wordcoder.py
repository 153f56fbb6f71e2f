"""Tokenizing whole texts with a public tokenizer, one distinct piece at a time.

The library is exact but slow (about 1 MB a second and core). Texts repeat their
words, so a block of texts is cut where no token can span the cut, each
distinct piece is encoded by the library once per block at most, and the
pieces' ids are put together again as arrays. Cuts are

* before ASCII white space that follows a character which is no white space (in
  neither the library's nor Python's sense);
* before ASCII punctuation that follows an ASCII letter, unless the block holds
  the beginning of a special token's string.

Both are safe for both kinds of vocabulary file: their splitting patterns end a
match at such places, and matching from there on does not look back.

A piece of Latin letters with at most one space before it is one word to the
splitting pattern, punctuation alone another; such words are given to the
library's model one by one, which skips its normalizer and splitter. All other
pieces go through the whole library.
"""

from __future__ import annotations

import json
import os
import re
import struct

import numpy as np
import pandas as pd

from kipmart.llm import common, textvec

#: Pieces a worker keeps (about 150 bytes each); a quarter more wait for a
#: second block that holds them.
KEEP = 600_000
#: Longer pieces (no white space for so long) are encoded but not kept.
KEEP_BYTES = 48

_WORD = re.compile(r"( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)")
_MARKS = re.compile(r"[!-&(-/:-@\[-`{-~]+")
_SPACE = textvec.kind_of([9, 10, 11, 12, 13, 32])
_INK = textvec.kind_of([*range(33, 127), *range(128, 256)])
_LETTER = textvec.kind_of([*range(65, 91), *range(97, 123)])
_MARK = textvec.kind_of([*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)])


def _ends_in_wide_space(buffer: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space beyond ASCII."""
    b1, b2, b3 = (buffer[np.maximum(at - k, 0)] for k in (1, 2, 3))
    return ((b2 == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0)) | (b3 == 0xE1) & (b2 == 0x9A) & (b1 == 0x80)
            | (b3 == 0xE2) & (b2 == 0x80) & ((b1 <= 0x8A) | (b1 == 0xA8) | (b1 == 0xA9) | (b1 == 0xAF))
            | (b3 == 0xE2) & (b2 == 0x81) & (b1 == 0x9F) | (b3 == 0xE3) & (b2 == 0x80) & (b1 == 0x80))


def cuts(buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """First byte of every piece of the block, in order."""
    n = len(buffer)
    begins = np.zeros(n, bool)
    if n > 1:
        begins[1:] = _SPACE[buffer[1:]] & _INK[buffer[:-1]]
        at = np.flatnonzero(begins)
        at = at[buffer[at - 1] >= 128]
        begins[at[_ends_in_wide_space(buffer, at)]] = False
        if not ((buffer[:-1] == 60) & (buffer[1:] == 124)).any():  # "<|"
            begins[1:] |= _MARK[buffer[1:]] & _LETTER[buffer[:-1]]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    return np.flatnonzero(begins)


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return {b: chr(b) if b in own else chr(next(other)) for b in range(256)}


class WordCoder:
    """Encodes blocks of texts (bytes of all texts, offsets of each)."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self._tok = Tokenizer.from_file(path)
        self._model = self._tok.model
        #: vocabularies with an end-of-word mark drop white space and take lower case
        self._marked = bool(model.get("end_of_word_suffix"))
        self._letters = _byte_letters()
        self._young: dict[int, bytes] = {}
        self._old: dict[int, bytes] = {}

    def _word_ids(self, word: str) -> bytes:
        if word.isascii():
            word = word.replace(" ", self._letters[32])
        else:
            word = word.encode().decode("latin-1").translate(self._letters)
        ids = [t.id for t in self._model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _piece_ids(self, piece: str) -> bytes:
        m = _WORD.fullmatch(piece)
        if m is not None:
            return self._word_ids(m[2].lower() if self._marked else piece)
        if _MARKS.fullmatch(piece) is not None:
            return self._word_ids(piece)
        ids = self._tok.encode(piece, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _pieces(self, buffer: np.ndarray, offsets: np.ndarray):
        """(bounds of the texts in pieces, distinct piece of each piece, ids of
        each distinct piece)."""
        start = cuts(buffer, offsets)
        end = np.append(start[1:], len(buffer))
        hashes = textvec.range_hash(buffer, start, end, exact=True)
        long = np.flatnonzero(end - start > KEEP_BYTES)
        hashes[long] = long.astype(np.uint64)  # each by itself
        which, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(start))[::-1]
        keys = distinct.tolist()
        old, young = self._old, self._young
        if len(old) > KEEP:
            old.clear()
        if len(young) > KEEP // 4:
            young.clear()
        ids = list(map(old.get, keys))
        data = buffer.tobytes()
        for i, v in enumerate(ids):
            if v is None:
                h, a, z = keys[i], start[first[i]], end[first[i]]
                v = young.pop(h, None)
                if v is not None:
                    old[h] = v
                else:
                    v = self._piece_ids(data[a:z].decode())
                    if z - a <= KEEP_BYTES:
                        young[h] = v
                ids[i] = v
        return np.searchsorted(start, offsets), which, ids

    def encode(self, buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, offsets of the texts in them)."""
        first, which, ids = self._pieces(buffer, offsets)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table, begin = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        lengths = size[which]
        at = np.concatenate([[0], np.cumsum(lengths)])
        return table[np.repeat(begin[which] - at[:-1], lengths) + np.arange(at[-1])], at[first]

    def lengths(self, buffer: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each text."""
        first, which, ids = self._pieces(buffer, offsets)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.diff(np.concatenate([[0], np.cumsum(size[which])])[first])


def coder(path: str) -> WordCoder:
    """The worker's coder of a vocabulary file, made once for tasks that follow
    each other: a worker that goes on to another step drops it."""
    if path not in common.coders:
        common.coders[path] = WordCoder(path)
    return common.coders[path]
