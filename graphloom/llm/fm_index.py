"""A full-text index in numpy: suffix array, BWT wavelet matrix, backward search, sampled locate.

Texts are arrays of symbols where 0 ends a run. Every 0 counts as its own, smallest symbol in order of position, so
suffix comparisons end at it and equal runs sort by position.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes sorted by prefix doubling; after the first packed key only unsettled groups are sorted again."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    run_end = ends[np.searchsorted(ends, np.arange(n))]
    left = (run_end - np.arange(n)).astype(np.int64)
    bits = max(1, int(text.max()).bit_length())
    width = max(1, 62 // bits)
    key = text.astype(np.int64)
    padded = np.concatenate([key, np.zeros(width, np.int64)])
    alive = left > 0
    key = np.zeros(n, np.int64)
    for k in range(width):
        alive = left >= k
        key = (key << bits) | np.where(alive, padded[k : k + n], 0)
    key[ends] = 0
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    sorted_key = key[order]
    first = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank[order] = start
    rank[order[: len(ends)]] = np.arange(len(ends))  # stable sort: separators come first, by position
    last = np.concatenate([first[1:], [True]])
    todo = order[~(first & last)]
    todo = todo[left[todo] > 0]
    h = width
    while len(todo):
        nxt = rank[todo + np.minimum(h, left[todo])]
        by = np.lexsort((nxt, rank[todo]))
        todo, nxt = todo[by], nxt[by]
        own = rank[todo]
        new_group = np.concatenate([[True], own[1:] != own[:-1]])
        new_key = new_group | np.concatenate([[True], nxt[1:] != nxt[:-1]])
        at = np.arange(len(todo))
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        key_at = np.maximum.accumulate(np.where(new_key, at, 0))
        rank[todo] = own + (key_at - group_at)
        ends_key = np.concatenate([new_key[1:], [True]])
        todo = todo[~(new_key & ends_key)]
        h *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank] = np.arange(n)
    return suffixes


class Bits:
    """A bitmap with constant-time rank."""

    def __init__(self, flags: np.ndarray):
        self.n = len(flags)
        raw = np.zeros(((self.n >> 6) + 1) * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        raw[: len(packed)] = packed
        self.blocks = raw.view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Set bits before i."""
        block = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.blocks[block] & mask)

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.blocks[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1


class WaveletMatrix:
    """Ranks of any symbol over a sequence, one bitmap a bit of the alphabet."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for shift in range(bits - 1, -1, -1):
            flags = (symbols >> shift) & 1 == 1
            zeros = len(flags) - int(flags.sum())
            self.levels.append((shift, Bits(flags), zeros))
            symbols = np.concatenate([symbols[~flags], symbols[flags]])

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before i."""
        start, i = np.zeros_like(i), i.copy()
        for shift, flags, zeros in self.levels:
            one = (symbol >> shift) & 1 == 1
            s1, i1 = flags.rank(start), flags.rank(i)
            start = np.where(one, zeros + s1, start - s1)
            i = np.where(one, zeros + i1, i - i1)
        return i - start

    def access_rank(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and how often it stands before i."""
        start, i, symbol = np.zeros_like(i), i.copy(), np.zeros_like(i)
        for shift, flags, zeros in self.levels:
            one = flags.get(i)
            s1, i1 = flags.rank(start), flags.rank(i)
            start = np.where(one, zeros + s1, start - s1)
            i = np.where(one, zeros + i1, i - i1)
            symbol |= one.astype(np.int64) << shift
        return symbol, i - start


class FMIndex:
    """Counts and locates symbol strings (without 0) in a text that ends with 0."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        suffixes = suffix_array(text)
        before = text[suffixes - 1]  # position 0 follows the closing 0
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols + 1))])
        self.tree = WaveletMatrix(before.astype(np.int64), max(1, symbols.bit_length()))
        kept = (suffixes % sample == 0) | (before == 0)
        self.kept, self.positions = Bits(kept), suffixes[kept]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of equally long patterns, by backward search; empty where a pattern does not occur."""
        c = patterns[:, -1]
        low, high = self.starts[c], self.starts[c + 1]
        for k in range(patterns.shape[1] - 2, -1, -1):
            live = np.flatnonzero(low < high)
            if not len(live):
                break
            c = patterns[live, k]
            low[live] = self.starts[c] + self.tree.rank(c, low[live])
            high[live] = self.starts[c] + self.tree.rank(c, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: step back by LF to a sampled suffix."""
        rows, found = rows.copy(), np.empty(len(rows), np.int64)
        todo, steps = np.arange(len(rows)), 0
        while len(todo):
            done = self.kept.get(rows[todo])
            at = todo[done]
            found[at] = self.positions[self.kept.rank(rows[at])] + steps
            todo = todo[~done]
            symbol, before = self.tree.access_rank(rows[todo])
            rows[todo] = self.starts[symbol] + before
            steps += 1
        return found
