"""Words, word hashes and hashes of word sequences, for many texts at once.

A text is its UTF-8 bytes.  Sequence hashes are polynomials over mixed word
hashes, modulo 2**64, taken from one running sum, so that a hash of any length
costs the same.
"""

from __future__ import annotations

import numpy as np
import xxhash

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**64, 256, dtype=np.uint64)
_P, _Q = (np.uint64(int(x) | 1) for x in _random.integers(1, 2**64, 2, dtype=np.uint64))


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    """A table that is true for the bytes in the ranges, ends included."""
    table = np.zeros(256, bool)
    for lo, hi in ranges:
        table[lo:hi + 1] = True
    return table


#: What separates words: white space, or everything but letters and digits (bytes
#: over 0x7F belong to words).
WHITE = byte_set((0x20, 0x20), (0x09, 0x0D))
NOT_ALNUM = byte_set((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each text's words begin."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~separator[data]
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    before[offsets[:-1][offsets[:-1] < len(data)]] = False
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    return starts, np.flatnonzero(inside & ~after) + 1, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i for i below n at least."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        both = []
        for b in (int(base), pow(int(base), -1, 2**64)):
            table = np.full(size, np.uint64(b))
            table[0] = 1
            both.append(np.multiply.accumulate(table))
        have = _powers[int(base)] = (both[0], both[1])
        if size > 1 << 20:  # a very long text: its tables are not kept
            del _powers[int(base)]
    return have


class Sequence:
    """Hashes of slices of ``values``."""

    def __init__(self, values: np.ndarray, base: np.uint64 = _Q):
        power, self._inverse = _power_tables(base, len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * power[:len(values)], out=self._sum[1:])

    def hash(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        length = (hi - lo).astype(np.uint64)
        return mix((self._sum[hi] - self._sum[lo]) * self._inverse[lo] + length * np.uint64(0x9E3779B97F4A7C15))


#: Bytes of the longest words that are hashed together; a longer one is hashed alone.
LONG_WORD = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word; words are taken to differ if these do.

    Eight bytes at a time are mixed in, so that words of eight bytes or fewer and equal
    length never share a hash; longer ones have no pattern (such as sums of powers
    have) that makes two of them meet."""
    length = (ends - starts).astype(np.uint64)
    out = mix(length * np.uint64(0x9E3779B97F4A7C15))
    # The eight bytes from every place on, without a copy per place.
    eight = np.ndarray(len(data) + 1, "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    at = np.flatnonzero(length <= LONG_WORD)
    for begin in range(0, LONG_WORD, 8):
        at = at[length[at] > begin]
        if not len(at):
            break
        over = (np.uint64(8) - np.minimum(length[at] - np.uint64(begin), np.uint64(8))) * np.uint64(8)
        lane = eight[starts[at] + begin] & (np.uint64(2**64 - 1) >> over)
        out[at] = mix(out[at] ^ lane)
    for k in np.flatnonzero(length > LONG_WORD).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k]:ends[k]].tobytes())
    return out


def text_hashes(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every text."""
    ends = zip(offsets[:-1].tolist(), offsets[1:].tolist())
    return np.fromiter((xxhash.xxh3_64_intdigest(data[lo:hi].tobytes()) for lo, hi in ends), np.uint64, len(offsets) - 1)


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """For each window of ``width`` values, the position of its first minimum."""
    if len(values) < width:
        return np.zeros(0, np.int64)
    best = np.arange(len(values) - width + 1)
    least = values[:len(best)].copy()
    for step in range(1, width):
        later = values[step:step + len(best)]
        less = later < least
        least[less] = later[less]
        best[less] = np.flatnonzero(less) + step
    return best
