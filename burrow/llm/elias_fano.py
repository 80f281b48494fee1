"""Elias-Fano coded monotone sequences over memory-mapped words, and a two-level n-gram trie made of them."""

from __future__ import annotations

import math
from pathlib import Path

import numpy as np

#: Steps of a quantised logarithm.
STEPS = 1 << 16


def pack_low(values: np.ndarray, bits: int) -> np.ndarray:
    """The low ``bits`` of each value, one after the other, in 64-bit words."""
    words = np.zeros((len(values) * bits + 127) // 64, np.uint64)
    if not bits or not len(values):
        return words
    at = np.arange(len(values), dtype=np.uint64) * np.uint64(bits)
    low = values & np.uint64((1 << bits) - 1)
    word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
    np.bitwise_or.at(words, word, low << shift)
    over = (shift + np.uint64(bits)) > np.uint64(64)
    np.bitwise_or.at(words, word[over] + 1, low[over] >> (np.uint64(64) - shift[over]))
    return words


class EliasFano:
    """``n`` values in increasing order: low bits packed, high bits in unary, and a running count of ones per word."""

    PARTS = ("low", "high", "before")

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray, before: np.ndarray):
        self.n, self.bits, self.low, self.high, self.before = n, bits, low, high, before
        self.zeros_before = None

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, int(math.log2(top / n))) if n and top > n else 0
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype=np.uint64)
        flags = np.zeros((int(ones[-1]) // 64 + 2) * 64 if n else 64, np.uint8)
        flags[ones.astype(np.int64)] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(high).astype(np.int64)
        return cls(n, bits, pack_low(values, bits), high, np.cumsum(counts) - counts)

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i.astype(np.uint64) * np.uint64(self.bits)
        word, shift = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
        upper = np.where(shift > 0, self.low[word + 1] << ((np.uint64(64) - shift) & np.uint64(63)), np.uint64(0))
        return ((self.low[word] >> shift) | upper) & np.uint64((1 << self.bits) - 1)

    def select(self, k: np.ndarray, *, zero: bool = False) -> np.ndarray:
        """The place of the k-th (from 0) one, or zero, of the high bits."""
        before = self.before
        if zero:
            if self.zeros_before is None:
                self.zeros_before = np.arange(len(self.before), dtype=np.int64) * 64 - self.before
            before = self.zeros_before
        word = np.searchsorted(before, k, side="right") - 1
        bits = ~self.high[word] if zero else self.high[word]
        rest = (k - before[word]).astype(np.uint64)
        place = np.zeros(len(k), np.uint64)
        for width in (32, 16, 8, 4, 2, 1):
            part = np.bitwise_count((bits >> place) & np.uint64((1 << width) - 1)).astype(np.uint64)
            skip = part <= rest
            rest = np.where(skip, rest - part, rest)
            place = np.where(skip, place + np.uint64(width), place)
        return word * 64 + place.astype(np.int64)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = np.asarray(i, dtype=np.int64)
        if not len(i):
            return np.zeros(0, np.uint64)
        return ((self.select(i) - i).astype(np.uint64) << np.uint64(self.bits)) | self.low_of(i)

    def successor(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each x the first index in [begin, end) whose value is not below x, else ``end``."""
        x = np.asarray(x, dtype=np.uint64)
        high, low = (x >> np.uint64(self.bits)).astype(np.int64), x & np.uint64((1 << self.bits) - 1)
        zeros = len(self.high) * 64 - int(self.before[-1]) - int(np.bitwise_count(self.high[-1])) if len(self.high) else 0
        inside = high <= zeros - 1
        first, after = np.full(len(x), self.n, np.int64), np.full(len(x), self.n, np.int64)
        some = inside & (high > 0)
        first[some] = self.select(high[some] - 1, zero=True) + 1 - high[some]
        first[high == 0] = 0
        # the values from first to after have the same high bits as x; all later ones are larger
        after[inside] = self.select(high[inside], zero=True) - high[inside]
        # binary search among them by the low bits
        i, after = np.clip(first, begin, end), np.clip(after, begin, end)
        live = np.flatnonzero(i < after)
        left, right, wanted = i[live], after[live], low[live]
        while len(live):
            middle = (left + right) >> 1
            less = self.low_of(middle) < wanted
            left, right = np.where(less, middle + 1, left), np.where(less, right, middle)
            done = left >= right
            if done.any():
                i[live[done]] = left[done]
                live, left, right, wanted = live[~done], left[~done], right[~done], wanted[~done]
        return i


class Trie:
    """Contexts and their successors, with a quantised probability for each pair.

    ``contexts`` holds the contexts' ids, ``pointers`` where each one's successors begin. Successors increase within
    a context; across contexts each range is shifted by the last value of the range before, so that the level is one
    monotone sequence and a lookup is a successor search relative to its context.
    """

    LEVELS = ("contexts", "pointers", "successors")

    def __init__(self, levels: dict[str, EliasFano], codes: np.ndarray, scale: np.ndarray):
        self.levels, self.codes, self.scale = levels, codes, scale

    @classmethod
    def build(cls, context: np.ndarray, word: np.ndarray, log_p: np.ndarray) -> Trie:
        """From pairs sorted by context and word, each once."""
        starts = np.flatnonzero(np.diff(context.astype(np.int64), prepend=-1)) if len(context) else np.zeros(0, np.int64)
        ends = np.append(starts[1:], len(context))[: len(starts)]
        lasts = word[ends - 1].astype(np.uint64)
        shift = np.cumsum(lasts) - lasts
        shifted = word.astype(np.uint64) + np.repeat(shift, ends - starts)
        least = float(log_p.min()) if len(log_p) else 0.0
        step = (float(log_p.max()) - least) / (STEPS - 1) or 1.0 if len(log_p) else 1.0
        codes = np.rint((log_p - least) / step).astype(np.uint16)
        levels = {"contexts": EliasFano.build(context[starts]), "pointers": EliasFano.build(np.append(starts, len(context))), "successors": EliasFano.build(shifted)}
        return cls(levels, codes, np.array([least, step]))

    def save(self, folder: str) -> None:
        for name, level in self.levels.items():
            np.array([level.n, level.bits], np.int64).tofile(f"{folder}/{name}.shape")
            for part in EliasFano.PARTS:
                getattr(level, part).tofile(f"{folder}/{name}.{part}")
        self.codes.tofile(f"{folder}/codes")
        self.scale.tofile(f"{folder}/scale")

    @classmethod
    def load(cls, folder: str) -> Trie:
        """The levels memory-mapped from their files."""

        def mapped(name: str, kind: type) -> np.ndarray:
            path = Path(folder, name)
            return np.asarray(np.memmap(path, kind, "r")) if path.stat().st_size else np.zeros(0, kind)

        levels = {}
        for name in cls.LEVELS:
            n, bits = (int(x) for x in np.fromfile(f"{folder}/{name}.shape", np.int64))
            levels[name] = EliasFano(n, bits, mapped(f"{name}.low", np.uint64), mapped(f"{name}.high", np.uint64), mapped(f"{name}.before", np.int64))
        return cls(levels, mapped("codes", np.uint16), np.fromfile(f"{folder}/scale", np.float64))

    def lookup(self, contexts: np.ndarray, counts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """For contexts, each with the next ``counts`` of ``words``: log10 of the pair's stored probability, or -inf."""
        level = self.levels["contexts"]
        whole = np.zeros(len(contexts), np.int64), np.full(len(contexts), level.n, np.int64)
        at = level.successor(contexts, *whole)
        known = at < level.n
        known[known] = level.get(at[known]) == contexts[known].astype(np.uint64)
        begin, end, shift = np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.int64), np.zeros(len(contexts), np.uint64)
        begin[known], end[known] = (self.levels["pointers"].get(at[known] + d).astype(np.int64) for d in (0, 1))
        later = known & (begin > 0)
        shift[later] = self.levels["successors"].get(begin[later] - 1)
        out = np.full(len(words), -np.inf)
        begin, end, shift = (np.repeat(x, counts) for x in (begin, end, shift))
        open_ = np.flatnonzero(begin < end)
        x = words[open_].astype(np.uint64) + shift[open_]
        found = self.levels["successors"].successor(x, begin[open_], end[open_])
        hit = found < end[open_]
        hit[hit] = self.levels["successors"].get(found[hit]) == x[hit]
        out[open_[hit]] = self.scale[0] + self.scale[1] * self.codes[found[hit]]
        return out
