"""A full-text index of one shard of symbols: suffix order, wavelet matrix, backward search, sampled positions.

All steps are whole-array numpy work: many patterns are searched at once.
"""

from __future__ import annotations

import numpy as np

#: Shards hold fewer symbols than this: a position fits in POSITION_BITS, two ranks (one with a bit more) and a position in 64.
POSITION_BITS = 21
LIMIT = 1 << POSITION_BITS
LEVELS = 5
SAMPLE = 4


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Positions of ``text`` in the order of the suffixes that start there.

    Suffixes are sorted by as many first symbols as fit a word beside the position, then, where still tied, by pairs of
    ranks: each round doubles the depth and touches only what is tied.
    """
    n = len(text)
    depth = 1
    while symbols ** (depth + 1) < 1 << (63 - POSITION_BITS):
        depth += 1
    padded = np.zeros(n + depth, np.uint64)
    padded[:n] = text
    key = np.zeros(n, np.uint64)
    for k in range(depth):
        key *= np.uint64(symbols)
        key += padded[k : k + n]
    key = (key << np.uint64(POSITION_BITS)) | np.arange(n, dtype=np.uint64)
    key.sort()
    mask = np.uint64(LIMIT - 1)
    order = (key & mask).astype(np.int64)
    head = np.ones(n, bool)
    head[1:] = (key[1:] >> np.uint64(POSITION_BITS)) != (key[:-1] >> np.uint64(POSITION_BITS))
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied = np.flatnonzero(~(head & np.r_[head[1:], True]))
    while len(tied):
        p = order[tied]
        after = p + depth
        # Where the text ends before that, the shorter suffix comes first, and before all others.
        second = np.where(after < n, rank[np.minimum(after, n - 1)] + n, n - p)
        key = (rank[p].astype(np.uint64) << np.uint64(2 * POSITION_BITS + 1)) | (second.astype(np.uint64) << np.uint64(POSITION_BITS)) | p.astype(np.uint64)
        key.sort()
        p = (key & mask).astype(np.int64)
        order[tied] = p
        new = np.ones(len(p), bool)
        new[1:] = (key[1:] >> np.uint64(POSITION_BITS)) != (key[:-1] >> np.uint64(POSITION_BITS))
        rank[p] = np.maximum.accumulate(np.where(new, tied, 0))
        tied = tied[~(new & np.r_[new[1:], True])]
        depth *= 2
    return order


class FMIndex:
    """Index of ``text`` (symbols from 0, fewer than ``symbols``); its last symbol should be a separator."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        order = suffix_order(text, symbols)
        n = self.n = len(text)
        self.last = text[order - 1]  # the symbol before each suffix
        self.last[order == 0] = (1 << LEVELS) - 1  # none is before the whole text
        counts = np.bincount(text, minlength=symbols)
        self.first = np.r_[0, np.cumsum(counts)]
        self.first[text[-1]] += 1  # the last symbol's own suffix follows from no other and is the least of its symbol
        self.words: list[np.ndarray] = []
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        level = self.last
        for b in range(LEVELS - 1, -1, -1):
            bits = ((level >> b) & 1).astype(bool)
            packed = np.packbits(bits, bitorder="little")
            words = np.zeros(n // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.r_[0, np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.zeros.append(int(n - bits.sum()))
            level = np.concatenate([level[~bits], level[bits]])
        symbol = np.arange(symbols)
        self.base = self._down(symbol, np.zeros(symbols, np.int64))
        sampled = order % SAMPLE == 0
        packed = np.packbits(sampled, bitorder="little")
        self.marks = np.zeros(n // 64 + 1, np.uint64)
        self.marks.view(np.uint8)[: len(packed)] = packed
        self.mark_ones = np.r_[0, np.cumsum(np.bitwise_count(self.marks), dtype=np.int64)]
        self.samples = order[sampled].astype(np.int32)

    def _rank(self, words: np.ndarray, ones: np.ndarray, at: np.ndarray) -> np.ndarray:
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return ones[word] + np.bitwise_count(words[word] & below)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where ``at`` lands when it follows the bits of ``symbol`` through the levels."""
        for i, b in enumerate(range(LEVELS - 1, -1, -1)):
            r = self._rank(self.words[i], self.ones[i], at)
            at = np.where((symbol >> b) & 1 == 1, self.zeros[i] + r, at - r)
        return at

    def before(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Row of the suffixes that start with ``symbol`` and go on with the suffixes above row ``at``."""
        return self.first[symbol] + self._down(symbol, at) - self.base[symbol]

    def longest(self, patterns: np.ndarray, ends: np.ndarray, least: int, most: int, few: int, dropped: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Backward search from each of ``ends`` in ``patterns``, all at once.

        A match grows to the left until it has at most ``few`` occurrences and ``least`` symbols, or ``most`` symbols, or
        until one symbol more would have none. Returns, for matches of at least ``least`` symbols, the index of the end,
        the length, and the first and last + 1 row. A symbol more leaves behind the occurrences that differ there; with
        ``dropped`` they are returned too, one row each, so every occurrence of ``least`` symbols is in the result.
        """
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        alive = np.arange(len(ends))
        found: list[tuple[np.ndarray, int, np.ndarray, np.ndarray]] = []
        for length in range(1, most + 1):
            at = ends[alive] - length
            symbol = np.where(at >= 0, patterns[np.maximum(at, 0)], 0).astype(np.int64)
            new_lo, new_hi = self.before(symbol, lo), self.before(symbol, hi)
            on = (new_hi > new_lo) & (symbol > 0)
            if length > least:
                out = ~on
                found.append((alive[out], length - 1, lo[out], hi[out]))
                if dropped:
                    left = np.flatnonzero(on & (new_hi - new_lo < hi - lo))
                    many = hi[left] - lo[left]
                    rows = np.repeat(lo[left], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                    differ = self.last[rows] != np.repeat(symbol[left], many)
                    found.append((np.repeat(alive[left], many)[differ], length - 1, rows[differ], rows[differ] + 1))
            alive, lo, hi = alive[on], new_lo[on], new_hi[on]
            if length >= least:
                enough = (hi - lo <= few) if length < most else np.ones(len(alive), bool)
                found.append((alive[enough], length, lo[enough], hi[enough]))
                alive, lo, hi = alive[~enough], lo[~enough], hi[~enough]
            if not len(alive):
                break
        which = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        length = np.concatenate([np.full(len(f[0]), f[1]) for f in found]) if found else np.zeros(0, np.int64)
        first = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        last = np.concatenate([f[3] for f in found]) if found else np.zeros(0, np.int64)
        return which, length, first, last

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step to the suffix one symbol longer until a sampled one is met."""
        out = np.empty(len(rows), np.int64)
        todo = np.arange(len(rows))
        at = rows.copy()
        for steps in range(SAMPLE + 1):
            word = at >> 6
            hit = (self.marks[word] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            out[todo[hit]] = self.samples[self._rank(self.marks, self.mark_ones, at[hit])] + steps
            todo, at = todo[~hit], at[~hit]
            if not len(todo):
                break
            at = self.before(self.last[at].astype(np.int64), at)
        return out
