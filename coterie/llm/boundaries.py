"""Sorted sets of whole numbers in containers, with rank and select.

Numbers are grouped by their high bits.  A container holds the low 16 bits of one
group as a sorted array, a bitmap or a list of runs, whichever is smallest; numbers
of members before each container lead a select to its container by one search.
"""

from __future__ import annotations

import numpy as np

LOW_BITS = 16
_SPAN = 1 << LOW_BITS


class ArrayContainer:
    """Few members, one number each."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def __len__(self) -> int:
        return len(self.low)

    def select(self, k: int) -> int:
        return int(self.low[k])

    def rank(self, x: int) -> int:
        """Members below x."""
        return int(np.searchsorted(self.low, x))

    @staticmethod
    def size(n: int, runs: int) -> int:
        return 2 * n


class BitmapContainer:
    """Many members: a bit per number, and the members before each word of 64 bits."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(_SPAN, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    def __len__(self) -> int:
        return int(self.before[-1])

    def _bits(self, word: int) -> np.ndarray:
        return np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        return 64 * word + int(np.flatnonzero(self._bits(word))[k - self.before[word]])

    def rank(self, x: int) -> int:
        word, bit = divmod(x, 64)
        return int(self.before[word]) + (int(self._bits(word)[:bit].sum()) if bit else 0)

    @staticmethod
    def size(n: int, runs: int) -> int:
        return _SPAN // 8


class RunContainer:
    """Members in unbroken runs: the first of each run, and the members before it."""

    def __init__(self, low: np.ndarray):
        new = np.flatnonzero(np.diff(low, prepend=-2) != 1)
        self.first = low[new].astype(np.int64)
        self.before = np.append(new, len(low))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.first[run] + k - self.before[run])

    def rank(self, x: int) -> int:
        run = int(np.searchsorted(self.first, x)) - 1
        if run < 0:
            return 0
        return int(min(self.before[run] + x - self.first[run], self.before[run + 1]))

    @staticmethod
    def size(n: int, runs: int) -> int:
        return 4 * runs


_KINDS = (ArrayContainer, RunContainer, BitmapContainer)


class BoundarySet:
    """A set of numbers, given in ascending order without repeats."""

    def __init__(self, values: np.ndarray):
        values = np.asarray(values, np.int64)
        self.keys, first = np.unique(values >> LOW_BITS, return_index=True)
        #: Members before each container, and all of them.
        self.before = np.append(first, len(values))
        self.containers = []
        for lo, hi in zip(self.before[:-1], self.before[1:]):
            low = values[lo:hi] & _SPAN - 1
            runs = 1 + int(np.count_nonzero(np.diff(low) != 1))
            kind = min(_KINDS, key=lambda c: c.size(len(low), runs))
            self.containers.append(kind(low))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The member that has k members before it."""
        if not 0 <= k < len(self):
            raise IndexError(k)
        at = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[at]) << LOW_BITS) + self.containers[at].select(k - int(self.before[at]))

    def rank(self, x: int) -> int:
        """Members below x."""
        key = x >> LOW_BITS
        at = int(np.searchsorted(self.keys, key))
        inside = at < len(self.keys) and self.keys[at] == key
        return int(self.before[at]) + (self.containers[at].rank(x & _SPAN - 1) if inside else 0)
