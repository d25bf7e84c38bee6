"""Elias-Fano coded n-gram tries with quantised log probabilities, in one block of bytes that is read in place.

A level holds its nodes' words in order, context by context. To make the level one monotone sequence, the words of a
context are counted from the value at which the context before it ends. So are the pointers to each node's first
child, which are monotone by themselves. Both are Elias-Fano coded: low bits packed, high bits in unary, with counts of
ones by block to select in. A query goes down the levels; in each it looks, among the children of its context only, for
the successor of its word counted from where the context before ends.

`to_bytes` gives the whole trie as one block; `view` reads such a block where it lies, and `open` maps a file of it.
"""

from __future__ import annotations

import json

import numpy as np

_WORDS = 8  # of 64 bits, in a block of a bit vector


class Bits:
    """A bit vector with the number of ones before each block."""

    def __init__(self, words: np.ndarray, ones: np.ndarray):
        self.words, self.ones = words, ones

    @classmethod
    def of(cls, places: np.ndarray, size: int) -> Bits:
        """`size` bits, of which those at the places are one; the places ascend."""
        words = np.zeros((size // (64 * _WORDS) + 1) * _WORDS, np.uint64)
        if len(places):
            word = places >> 6
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), first)
        per = np.bitwise_count(words).astype(np.int64).reshape(-1, _WORDS).sum(1)
        return cls(words, (np.cumsum(per) - per).astype(np.uint32))

    def select(self, k: np.ndarray, one: bool = True) -> np.ndarray:
        """Places of the ones, or zeros, with these numbers, from 0 on."""
        before = self.ones.astype(np.int64) if one else np.arange(len(self.ones)) * (64 * _WORDS) - self.ones
        block = np.searchsorted(before, k, "right") - 1
        left = k - before[block]
        words = self.words.reshape(-1, _WORDS)[block]
        words = words if one else ~words
        upto = np.cumsum(np.bitwise_count(words), 1, dtype=np.int64)
        at = np.minimum((upto <= left[:, None]).sum(1), _WORDS - 1)
        row = np.arange(len(k))
        left = (left - np.where(at > 0, upto[row, at - 1], 0)).astype(np.int64)
        word, place = words[row, at], (block * _WORDS + at) * 64
        for width in (32, 16, 8, 4, 2, 1):
            low = np.bitwise_count(word & np.uint64((1 << width) - 1)).astype(np.int64)
            up = left >= low
            left = left - np.where(up, low, 0)
            word = np.where(up, word >> np.uint64(width), word)
            place = place + np.where(up, width, 0)
        return place


class EliasFano:
    """A monotone sequence of integers below 2^63."""

    def __init__(self, low: np.ndarray, high: Bits, bits: int, n: int, buckets: int):
        self.low, self.high, self.bits, self.n, self.buckets = low, high, bits, n, buckets

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if not n:
            return cls(np.zeros(1, np.uint64), Bits.of(values, 0), 0, 0, 0)
        bits = max(0, int(values[-1] // n).bit_length() - 1)
        words = np.zeros(n * bits // 64 + 2, np.uint64)
        if bits:
            low = (values & ((1 << bits) - 1)).astype(np.uint64)
            at = np.arange(n, dtype=np.int64) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            # values with one word number lie together, so their parts can be joined by segment
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] |= np.bitwise_or.reduceat(low << shift, first)
            over = np.flatnonzero((at & 63) + bits > 64)  # at most one value crosses each border
            words[word[over] + 1] |= low[over] >> (np.uint64(64) - shift[over])
        high = values >> bits
        buckets = int(high[-1]) + 1
        return cls(words, Bits.of(high + np.arange(n), n + buckets), bits, n, buckets)

    def _low(self, k: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(k), np.int64)
        at = k * self.bits
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = self.low[word] >> shift
        cross = shift > 0
        out[cross] |= self.low[word[cross] + 1] << (np.uint64(64) - shift[cross])
        return (out & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def access(self, k: np.ndarray) -> np.ndarray:
        k = np.asarray(k, np.int64)
        return (self.high.select(k) - k << self.bits) | self._low(k)

    def successor(self, x: np.ndarray, lo=0, hi=None) -> np.ndarray:
        """The place of the first value >= x in [lo, hi), or hi."""
        x = np.asarray(x, np.int64)
        lo, hi = np.broadcast_to(lo, x.shape), np.broadcast_to(self.n if hi is None else hi, x.shape)
        if not self.n:
            return hi.copy()
        bucket = np.minimum(x >> self.bits, self.buckets - 1)
        beyond = x >> self.bits > bucket
        end = np.where(beyond, self.n, self.high.select(bucket, one=False) - bucket)
        start = np.where(beyond, self.n, np.where(bucket > 0, self.high.select(np.maximum(bucket - 1, 0), one=False) - bucket + 1, 0))
        a, z, low = np.clip(start, lo, hi), np.clip(end, lo, hi), x & ((1 << self.bits) - 1)
        while True:  # binary search within the bucket's part of the range
            open_ = np.flatnonzero(a < z)
            if not len(open_):
                return a
            mid = (a[open_] + z[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            z[open_[~less]] = mid[~less]

    def arrays(self) -> list[np.ndarray]:
        return [self.low, self.high.words, self.high.ones]

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in self.arrays())


class NgramTrie:
    def __init__(self, levels: list[EliasFano], pointers: list[EliasFano], codes: np.ndarray, book: np.ndarray):
        self.levels, self.pointers, self.codes, self.book = levels, pointers, codes, book

    @classmethod
    def build(cls, grams: np.ndarray, log_prob: np.ndarray, bins: int = 256) -> NgramTrie:
        """grams: distinct rows of word ids in lexicographic order."""
        levels, pointers = [], []
        n, order = grams.shape
        rank, parents, new = np.zeros(n, np.int64), 1, np.zeros(n, bool)
        for k in range(order):
            new = new | np.r_[True, grams[1:, k] != grams[:-1, k]][:n]
            at = np.flatnonzero(new)
            first = np.searchsorted(rank[at], np.arange(parents + 1))
            words = grams[at, k]
            # where each context's words end, counted from where those of the one before end
            ends = np.cumsum(words[first[1:] - 1]) if n else np.zeros(parents, np.int64)
            levels.append(EliasFano.of(words + np.r_[0, ends[:-1]][rank[at]]))
            if k:
                pointers.append(EliasFano.of(first))
            rank, parents = np.cumsum(new) - 1, len(at)
        # half of the bins follow the density, half bound the error everywhere
        inner = np.linspace(0, 1, bins // 2)[1:-1]
        edges = np.unique(np.r_[np.quantile(log_prob, inner), log_prob.min() + inner * np.ptp(log_prob)]) if n else np.zeros(0)
        codes = np.searchsorted(edges, log_prob, "right")
        size = np.bincount(codes, minlength=len(edges) + 1)
        book = np.bincount(codes, log_prob, minlength=len(edges) + 1) / np.maximum(size, 1)
        return cls(levels, pointers, codes.astype(np.uint8), book)

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of the n-grams at the last level, or -1."""
        rank, ok = np.zeros(len(grams), np.int64), np.full(len(grams), bool(self.levels[0].n))
        if not self.levels[0].n:
            return np.full(len(grams), -1)
        for k, level in enumerate(self.levels):
            lo, hi = (np.zeros_like(rank), np.full_like(rank, level.n)) if not k else (self.pointers[k - 1].access(rank), self.pointers[k - 1].access(rank + 1))
            x = grams[:, k] + np.where(lo > 0, level.access(np.maximum(lo - 1, 0)), 0)
            place = level.successor(x, lo, hi)
            inside = np.minimum(place, level.n - 1)
            ok &= (place < hi) & (level.access(inside) == x)
            rank = np.where(ok, inside, 0)
        return np.where(ok, rank, -1)

    def log_prob(self, grams: np.ndarray) -> np.ndarray:
        """Quantised log probabilities; NaN where an n-gram is not there."""
        at = self.find(grams)
        return np.where(at >= 0, self.book[self.codes[np.maximum(at, 0)]] if len(self.codes) else np.nan, np.nan)

    def to_bytes(self) -> bytes:
        parts = [a for x in (*self.levels, *self.pointers) for a in x.arrays()] + [self.codes, self.book]
        about = {"levels": len(self.levels), "shapes": [[x.bits, x.n, x.buckets] for x in (*self.levels, *self.pointers)], "arrays": [[a.dtype.str, len(a)] for a in parts]}
        head = json.dumps(about).encode()
        head += b" " * (-len(head) % 8)
        return b"".join((len(head).to_bytes(8, "little"), head, *(a.tobytes() + bytes(-a.nbytes % 8) for a in parts)))

    @classmethod
    def view(cls, block) -> NgramTrie:
        """The trie in a block of bytes, which is read where it lies."""
        size = int.from_bytes(block[:8], "little")
        about, at, parts = json.loads(bytes(block[8 : 8 + size])), 8 + size, []
        for kind, n in about["arrays"]:
            parts.append(np.frombuffer(block, kind, n, at))
            at += parts[-1].nbytes + -parts[-1].nbytes % 8
        each = [EliasFano(parts[3 * k], Bits(parts[3 * k + 1], parts[3 * k + 2]), *x) for k, x in enumerate(about["shapes"])]
        return cls(each[: about["levels"]], each[about["levels"] :], parts[-2], parts[-1])

    def write(self, path: str) -> None:
        with open(path, "wb") as f:
            f.write(self.to_bytes())

    @classmethod
    def open(cls, path: str) -> NgramTrie:
        """Memory-mapped."""
        import mmap

        with open(path, "rb") as f:
            return cls.view(memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)))
