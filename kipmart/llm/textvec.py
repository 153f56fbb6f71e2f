"""Words and letter groups of many texts at once, as numpy arrays.

The texts of a block lie one after the other in one byte buffer; word bounds,
word hashes and letter-group hashes are computed for the whole buffer without a
Python loop over words. ASCII letters are lower-cased, other bytes stay.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_ODD = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_ODD, -1, 1 << 64)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: word bytes: digits, letters and everything beyond ASCII
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
#: bytes that are not white space
INK = np.ones(256, bool)
INK[[9, 10, 11, 12, 13, 32]] = False
_EXACT_BYTE = np.random.RandomState(17).randint(1, 1 << 62, 256).astype(np.uint64)
_BYTE = _EXACT_BYTE[LOWER]
KEEP_POWERS = 1 << 22
#: Bytes that :func:`range_hash` works on at a time (8 bytes of memory for each, several times).
HASHED_AT_ONCE = 1 << 19
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int, which: int) -> np.ndarray:
    """Powers 0 to n of the odd multiplier, or of its inverse, modulo 2**64; kept
    for blocks of usual size, not for a single very long text."""
    powers = _powers[which]
    if len(powers) <= n:
        step = np.full(n + (n >> 3) + 1, (_ODD, _INVERSE)[which], np.uint64)
        step[0] = 1
        powers = np.cumprod(step, dtype=np.uint64)
        if n <= KEEP_POWERS:
            _powers[which] = powers
    return powers[:n + 1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def kind_of(values: list[int]) -> np.ndarray:
    """A table of the bytes with these values."""
    k = np.zeros(256, bool)
    k[values] = True
    return k


def range_hash(buffer: np.ndarray, start: np.ndarray, end: np.ndarray, exact: bool = False) -> np.ndarray:
    """64-bit hashes of byte ranges in ascending order; ASCII letters in lower case
    unless ``exact``. A hash does not depend on the range's place, so a large
    block is hashed a part at a time."""
    out, values = np.empty(len(start), np.uint64), _EXACT_BYTE if exact else _BYTE
    first = np.searchsorted(start, np.arange(0, len(buffer) + 1 + HASHED_AT_ONCE, HASHED_AT_ONCE))
    for a, z in zip(first, first[1:]):
        if z > a:
            low = start[a]
            part, begin = buffer[low:end[z - 1]], start[a:z] - low
            n = len(part)
            total = np.zeros(n + 1, np.uint64)
            np.cumsum(values[part] * _power(n, 0)[:n], out=total[1:])
            out[a:z] = mix((total[end[a:z] - low] - total[begin]) * _power(n, 1)[begin])
    return out


@dataclass
class Words:
    """The words of a block: byte bounds, hashes, and each text's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # of each text, and one past the last word at the end

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def _edges(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(inside)
    begins, ends = inside.copy(), inside.copy()
    if n:
        cut = offsets[1:-1]
        cut = cut[(cut > 0) & (cut < n)]
        begins[1:] &= ~inside[:-1]
        begins[cut] = inside[cut]
        ends[:-1] &= ~inside[1:]
        ends[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def words(buffer: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> Words:
    """The words (runs of bytes of this kind) of every text of the block."""
    start, end = _edges(kind[buffer], offsets)
    return Words(start, end, range_hash(buffer, start, end), np.searchsorted(start, offsets))


def bounds(buffer: np.ndarray, offsets: np.ndarray, kind: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the words of every text, without hashes."""
    start, end = _edges(kind[buffer], offsets)
    return start, end, np.searchsorted(start, offsets)


def letter_groups(buffer: np.ndarray, offsets: np.ndarray, size: int,
                  bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the ``size`` bytes from each place, in ``bits`` bits; whether
    they lie inside one text)."""
    low = LOWER[buffer].astype(np.uint32)
    n = len(low)
    h = np.zeros(n, np.uint32)
    for k in range(size):
        h[:n - k] = h[:n - k] * np.uint32(0x01000193) ^ low[k:]
    h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits)
    inside = np.ones(n, bool)
    for k in range(1, size):
        at = offsets[1:] - k
        inside[at[at >= 0]] = False
    return h, inside


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each text (``first``: bounds, one more than texts)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, 0, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
