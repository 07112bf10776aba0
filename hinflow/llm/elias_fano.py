"""Elias-Fano sequences and a two-level trie of n-grams over them, in memory-mapped files.

A monotone sequence of n values below u keeps the lower log2(u / n) bits of
each value as they are and the upper ones in unary, some 2 + log2(u / n) bits a
value. All reads are vectorised: a batch of positions or of keys goes through
the same few array operations.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

import numpy as np

#: Set bits between two entries of the select directory.
EVERY = 64
_U = np.uint64
_COUNT = np.array([bin(b).count("1") for b in range(256)], np.uint8)
#: For each byte and each rank, the place of the set bit of that rank.
_SELECT = np.array([([i for i in range(8) if b >> i & 1] + [0] * 8)[:8] for b in range(256)], np.uint8)


class Files:
    """Arrays in a file of their own that has no name any more, so that nothing stays behind whichever way a task ends."""

    def __init__(self, folder: str | None = None):
        self.folder = folder

    def mapped(self, values: np.ndarray) -> np.ndarray:
        if not len(values):
            return values
        handle, path = tempfile.mkstemp(dir=self.folder)
        try:
            with os.fdopen(handle, "wb") as out:
                values.tofile(out)
            return np.memmap(path, values.dtype, "r", shape=values.shape)
        finally:
            os.unlink(path)


class Monotone:
    """A sequence that never falls."""

    def __init__(self, values: np.ndarray, keep: Callable[[np.ndarray], np.ndarray] = lambda x: x):
        v = np.asarray(values, np.uint64)
        self.n = len(v)
        top = int(v[-1]) + 1 if self.n else 1
        self.width = max(0, (top // max(self.n, 1)).bit_length() - 1)
        high = (v >> _U(self.width)).astype(np.int64) + np.arange(self.n)
        bits = np.zeros((int(high[-1]) // 8 + 1 if self.n else 0) + 8, np.uint8)
        np.bitwise_or.at(bits, high // 8, (1 << (high % 8)).astype(np.uint8))
        self.high = keep(bits)
        #: Byte with every EVERY-th set bit, and how many set bits lie before that byte.
        at = high[::EVERY] // 8
        before = np.concatenate([[0], np.cumsum(_COUNT[bits], dtype=np.int64)])[at]
        self.byte, self.before = keep(at.astype(np.int64)), keep(before)
        self.low = keep(_packed(v & _U((1 << self.width) - 1), self.width))

    def __len__(self) -> int:
        return self.n

    def nbytes(self) -> int:
        return sum(x.nbytes for x in (self.high, self.byte, self.before, self.low))

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """Values at the positions ``i``."""
        i = np.asarray(i, np.int64)
        k = i // EVERY
        byte, rank = self.byte[k].copy(), i - self.before[k]
        todo = np.arange(len(i))
        while len(todo):
            ones = _COUNT[self.high[byte[todo]]]
            on = rank[todo] >= ones
            todo = todo[on]
            rank[todo] -= ones[on]
            byte[todo] += 1
        place = byte * 8 + _SELECT[self.high[byte], rank]
        return ((place - i).astype(np.uint64) << _U(self.width)) | _unpacked(self.low, self.width, i)

    def successor(self, keys: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """For each key the first position in [lo, hi) whose value is at least the key; hi if there is none."""
        lo, hi = np.array(lo, np.int64), np.array(hi, np.int64)
        open_ = np.flatnonzero(lo < hi)
        while len(open_):
            mid = (lo[open_] + hi[open_]) // 2
            less = self[mid] < keys[open_]
            lo[open_[less]] = mid[less] + 1
            hi[open_[~less]] = mid[~less]
            open_ = open_[lo[open_] < hi[open_]]
        return lo


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` bits of each value, one after the other, in 64-bit words."""
    if width == 0:
        return np.zeros(2, np.uint64)
    at = np.arange(len(values), dtype=np.uint64) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    out = np.zeros(len(values) * width // 64 + 2, np.uint64)
    np.bitwise_or.at(out, word, values << shift)
    over = np.flatnonzero(shift + _U(width) > 64)
    np.bitwise_or.at(out, word[over] + 1, values[over] >> (_U(64) - shift[over]))
    return out


def _unpacked(words: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if width == 0:
        return np.zeros(len(i), np.uint64)
    at = i.astype(np.uint64) * _U(width)
    word, shift = (at >> _U(6)).astype(np.int64), at & _U(63)
    out = words[word] >> shift
    over = np.flatnonzero(shift + _U(width) > 64)
    out[over] |= words[word[over] + 1] << (_U(64) - shift[over])
    return out & _U((1 << width) - 1)


class Trie:
    """Pairs (context, word), each with a quantised value.

    The level of contexts holds their numbers and monotone pointers to their
    words; the level of words holds, for each context, the numbers of its words
    on top of the largest sum of the contexts before, so that the whole level
    is one monotone sequence of small steps.
    """

    def __init__(self, context: np.ndarray, word: np.ndarray, value: np.ndarray, folder: str | None = None):
        """``context`` and ``word``: sorted and distinct as pairs; ``value``: unsigned whole numbers."""
        keep = Files(folder).mapped
        first = np.flatnonzero(np.diff(context, prepend=-1)) if len(context) else np.zeros(0, np.int64)
        ends = np.append(first[1:], len(context)) if len(context) else first
        self.contexts = Monotone(context[first], keep)
        self.pointers = Monotone(np.append(first, len(context)), keep)
        #: What is added to the words of a context: the last word of the one before, plus what was added to that.
        last = word[ends - 1] + 1 if len(context) else first
        added = np.concatenate([[0], np.cumsum(last)[:-1]]) if len(context) else first
        self.added = Monotone(added, keep)
        self.words = Monotone(word + np.repeat(added, ends - first), keep)
        self.values = keep(value)

    def nbytes(self) -> int:
        return sum(x.nbytes() for x in (self.contexts, self.pointers, self.added, self.words)) + self.values.nbytes

    def find(self, context: np.ndarray, word: np.ndarray, none: int) -> np.ndarray:
        """The value of each pair; ``none`` for pairs that are not there."""
        out = np.full(len(context), none, np.int64)
        n = len(self.contexts)
        if not n:
            return out
        # Contexts repeat, so each is searched once, and its words within its own range.
        asked, of = np.unique(context, return_inverse=True)
        at = self.contexts.successor(asked.astype(np.uint64), np.zeros(len(asked), np.int64), np.full(len(asked), n))
        known = at < n
        known[known] = self.contexts[at[known]] == asked[known].astype(np.uint64)
        at = np.where(known, at, 0)
        lo, hi, added = self.pointers[at].astype(np.int64), self.pointers[at + 1].astype(np.int64), self.added[at]
        rows = np.flatnonzero(known[of])
        of = of[rows]
        keys = word[rows].astype(np.uint64) + added[of]
        place = self.words.successor(keys, lo[of], hi[of])
        there = place < hi[of]
        there[there] = self.words[place[there]] == keys[there]
        out[rows[there]] = self.values[place[there]]
        return out
