"""Elias-Fano coded monotone sequences that are searched as they are, and an n-gram trie made of them."""

from __future__ import annotations

import mmap
import os

import numpy as np

_U = np.uint64
#: Words of 64 bits for each entry of a directory, and queries worked on at a time.
SPAN, CHUNK = 8, 1 << 15
#: The place of each set bit of a byte.
_PLACE = np.array([[([i for i in range(8) if b >> i & 1] + [0] * 8)[k] for k in range(8)] for b in range(256)], np.uint8)


def _pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, one after another, lowest first, in whole words and one more."""
    out = []
    for at in range(0, len(values) if width else 0, 1 << 16):
        bits = np.unpackbits(values[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, count=width, bitorder="little")
        out.append(np.packbits(bits.reshape(-1), bitorder="little"))
    data = np.concatenate(out) if out else np.zeros(0, np.uint8)
    return data.tobytes() + bytes(8 - len(data) % 8 + 8)


def encode(values: np.ndarray) -> bytes:
    """A sorted sequence of uint64 (repeats allowed): low bits as they are, high bits as unary steps, and counts of those."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // max(1, n)).bit_length() - 1)
    high = (values >> _U(width)).astype(np.int64) + np.arange(n)
    marks = np.zeros((int(high[-1]) + 1 if n else 0) + 64, np.uint8)
    marks[high] = 1
    steps = np.packbits(marks, bitorder="little")
    steps = np.concatenate([steps, np.zeros(-len(steps) % (8 * SPAN), np.uint8)])
    counts = np.bitwise_count(steps.view("<u8")).reshape(-1, SPAN).sum(axis=1)
    before = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u8")
    low = _pack(values & _U((1 << width) - 1), width)
    return np.array([n, width, len(low) // 8, len(steps) // 8, top], "<u8").tobytes() + low + steps.tobytes() + before.tobytes()


def _in_word(word: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit of each word."""
    parts = word.astype("<u8").view(np.uint8).reshape(-1, 8)
    upto = np.cumsum(np.bitwise_count(parts), axis=1, dtype=np.int64)
    byte = (upto <= k[:, None]).sum(axis=1)
    rows = np.arange(len(word))
    k = k - np.where(byte > 0, upto[rows, np.maximum(byte, 1) - 1], 0)
    return byte * 8 + _PLACE[parts[rows, byte], k]


class EliasFano:
    """A coded sequence, read where it lies: nothing is decoded but what a query looks at."""

    def __init__(self, data: np.ndarray):
        head = data[:40].view("<u8")
        self.n, self.width, a, b, self.top = (int(x) for x in head)
        words = data[40:].view("<u8")
        self.low, self.high, self.before = words[:a], words[a : a + b], words[a + b : a + b + b // SPAN]
        self.size = 40 + 8 * (a + b + b // SPAN)

    def _select(self, k: np.ndarray, bit: int) -> np.ndarray:
        """The place of the k-th set (or unset) bit of the high part."""
        out = np.empty(len(k), np.int64)
        before = self.before.astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * 64 * SPAN - before
        for at in range(0, len(k), CHUNK):
            want = k[at : at + CHUNK].astype(np.int64)
            span = np.searchsorted(before, want, "right") - 1
            words = self.high[(span * SPAN)[:, None] + np.arange(SPAN)]
            if not bit:
                words = ~words
            upto, left, rows = np.cumsum(np.bitwise_count(words), axis=1, dtype=np.int64), want - before[span], np.arange(len(want))
            word = (upto <= left[:, None]).sum(axis=1)
            left -= np.where(word > 0, upto[rows, np.maximum(word, 1) - 1], 0)
            out[at : at + CHUNK] = (span * SPAN + word) * 64 + _in_word(words[rows, word], left)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        bit = i.astype(np.int64) * self.width
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
        both = (self.low[word] >> shift) | np.where(shift > 0, self.low[word + 1] << ((_U(64) - shift) & _U(63)), _U(0))
        return both & _U((1 << self.width) - 1)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        """The values at places ``i``."""
        i = np.asarray(i, np.int64)
        return ((self._select(i, 1) - i).astype(np.uint64) << _U(self.width)) | self._low(i)

    def find(self, x: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
        """The place of each ``x``, or -1; only places from ``first`` on and before ``last`` are looked at, if given.

        Values with the same high part lie together, between two unset bits; the low parts are searched by halving.
        """
        x = np.asarray(x, np.uint64)
        out = np.full(len(x), -1, np.int64)
        rows = np.flatnonzero(x <= _U(self.top)) if self.n else np.zeros(0, np.int64)
        high, low = (x[rows] >> _U(self.width)).astype(np.int64), x[rows] & _U((1 << self.width) - 1)
        a = np.where(high > 0, self._select(np.maximum(high, 1) - 1, 0) + 1, 0) - high
        b = self._select(high, 0) - high
        if first is not None:
            a, b = np.maximum(a, first[rows]), np.minimum(b, last[rows])
        open_ = np.flatnonzero(a < b)
        end = b.copy()
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]], b[open_[~less]] = mid[less] + 1, mid[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = np.flatnonzero(a < end)
        hit = hit[self._low(a[hit]) == low[hit]]
        out[rows[hit]] = a[hit]
        return out


def decode(data: bytes | np.ndarray) -> np.ndarray:
    """The whole sequence that :func:`encode` was given: for messages, which are read once from end to end."""
    e = EliasFano(np.frombuffer(data, np.uint8) if isinstance(data, (bytes, bytearray)) else data)
    at = np.flatnonzero(np.unpackbits(e.high.view(np.uint8), bitorder="little"))[: e.n]
    return ((at - np.arange(e.n)).astype(np.uint64) << _U(e.width)) | e._low(np.arange(e.n))


#: A probability code is its negative decimal logarithm times this, plus one; zero says that there is none.
STEPS = 32


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities as one byte each; zero as code 0."""
    codes = np.clip(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEPS) + 1, 1, 255)
    return np.where(p > 0, codes, 0).astype(np.uint8)


#: What the bytes of :func:`quantise` stand for.
VALUE = np.concatenate([[0.0], 10.0 ** (-np.arange(255) / STEPS)])
#: Bits of a successor's key.
KEY_BITS = 40


class Trie:
    """Two levels: contexts with quantised weights, and under each its successors with quantised probabilities.

    contexts: sorted 64-bit keys; pointers: where each context's successors start (monotone); successors: keys of
    ``KEY_BITS`` bits, sorted under each context, made monotone by adding the context's number above those bits.  All
    levels stay coded in one run of bytes that is mapped into memory; a query finds the context, then its two pointers,
    and searches for the successor between them.
    """

    def __init__(self, data: bytes | np.ndarray | mmap.mmap):
        self.data = np.frombuffer(data, np.uint8) if not isinstance(data, np.ndarray) else data
        at, levels = 0, []
        for _ in range(3):
            levels.append(EliasFano(self.data[at:][: len(self.data[at:]) // 8 * 8]))
            at += levels[-1].size
        self.contexts, self.pointers, self.successors = levels
        self.weights = self.data[at : at + self.contexts.n]
        self.codes = self.data[at + self.contexts.n : at + self.contexts.n + self.successors.n]

    @classmethod
    def open(cls, path: str) -> Trie:
        """The trie in a file, mapped."""
        return cls(np.memmap(path, np.uint8, "r"))

    @classmethod
    def mapped(cls, data: bytes) -> Trie:
        """The trie in a nameless file of this process's own, mapped; it goes with the trie."""
        fd = os.memfd_create("trie")
        try:
            with os.fdopen(os.dup(fd), "wb") as f:
                f.write(data)
            return cls(mmap.mmap(fd, len(data), prot=mmap.PROT_READ))
        finally:
            os.close(fd)

    @staticmethod
    def build(contexts: np.ndarray, pointers: np.ndarray, successors: np.ndarray, probabilities: np.ndarray, weights: np.ndarray) -> bytes:
        """``successors`` are in the order of contexts; ``pointers`` has an entry more than ``contexts``."""
        own = np.repeat(np.arange(len(contexts), dtype=np.uint64), np.diff(pointers))
        levels = [encode(contexts), encode(pointers.astype(np.uint64)), encode((own << _U(KEY_BITS)) | successors.astype(np.uint64))]
        return b"".join(levels) + quantise(weights).tobytes() + quantise(probabilities).tobytes()

    def find(self, contexts: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, weights) of n-grams: 0 for n-grams, and for contexts, that aren't there."""
        codes, weights = np.zeros(len(contexts), np.uint8), np.zeros(len(contexts), np.uint8)
        keys, each = np.unique(contexts, return_inverse=True)
        place = self.contexts.find(keys)
        known = place >= 0
        first, last = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], last[known] = self.pointers[place[known]].astype(np.int64), self.pointers[place[known] + 1].astype(np.int64)
        rows = np.flatnonzero(known[each])
        c = place[each[rows]]
        weights[rows] = self.weights[c]
        s = self.successors.find((c.astype(np.uint64) << _U(KEY_BITS)) | successors[rows].astype(np.uint64), first[each[rows]], last[each[rows]])
        codes[rows[s >= 0]] = self.codes[s[s >= 0]]
        return codes, weights
