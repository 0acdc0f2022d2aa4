"""Weighted acyclic automata over words: a path spells a phrase, each transition carries the count of the phrase so far.

Built from sorted phrases: states are registered in that order from the deepest on, and states whose transitions agree in
label, count and target are one state, so the many contexts that go on alike share what follows.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import zstandard

#: Of each depth the phrases, a row of word numbers each, and their counts.
Levels = list[tuple[np.ndarray, np.ndarray]]


def _tree(levels: Levels) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each depth the sorted nodes: parent's place, label, count. Equal phrases are one and their counts are summed."""
    rows = [(ids, w, np.zeros(len(ids), np.int64)) for ids, w in levels if len(ids)]
    out = []
    for d in range(max((ids.shape[1] for ids, _, _ in rows), default=0)):
        keys = np.concatenate([up << np.int64(32) | ids[:, d] for ids, _, up in rows])
        found, at = np.unique(keys, return_inverse=True)
        counts, first, deeper = np.zeros(len(found), np.int64), 0, []
        for ids, w, _ in rows:
            own = at[first : first + len(ids)]
            first += len(ids)
            if ids.shape[1] == d + 1:
                np.add.at(counts, own, w)
            else:
                deeper.append((ids, w, own.astype(np.int64)))
        out.append((found >> np.int64(32), (found & np.int64(0xFFFFFFFF)), counts))
        rows = deeper
    return out


class CountAutomaton:
    """``words`` in byte order; state s has the transitions offsets[s] .. offsets[s + 1], the last state being the root."""

    def __init__(self, words: list[bytes], offsets: np.ndarray, labels: np.ndarray, weights: np.ndarray, targets: np.ndarray):
        self.words, self.offsets, self.labels, self.weights, self.targets = words, offsets, labels, weights, targets

    @staticmethod
    def build(words: list[bytes], levels: Levels) -> CountAutomaton:
        """Word numbers are places in ``words``, which are sorted."""
        tree = _tree(levels)
        offsets, labels, weights, targets = [0], [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.int32)]
        next_of = np.empty(0, np.int32)
        for d in range(len(tree) - 1, -1, -1):
            up, label, weight = tree[d]
            label = label.astype(np.int32)
            target = next_of if d < len(tree) - 1 else np.full(len(label), -1, np.int32)
            parents, starts = np.unique(up, return_index=True)
            ends = np.append(starts[1:], len(up))
            register: dict[tuple[bytes, bytes, bytes], int] = {}
            next_of = np.full(len(tree[d - 1][0]) if d else 1, -1, np.int32)
            for p, s, e in zip(parents.tolist(), starts.tolist(), ends.tolist()):
                state = label[s:e].tobytes(), weight[s:e].tobytes(), target[s:e].tobytes()
                known = register.get(state)
                if known is None:
                    known = register[state] = len(offsets) - 1
                    offsets.append(offsets[-1] + e - s)
                    labels.append(label[s:e])
                    weights.append(weight[s:e])
                    targets.append(target[s:e])
                next_of[p] = known
        return CountAutomaton(words, np.array(offsets, np.int64), *(np.concatenate(x) for x in (labels, weights, targets)))

    def levels(self) -> Levels:
        """All phrases that have a count, in order."""
        out: Levels = []
        states, ids = np.array([len(self.offsets) - 2], np.int64), np.empty((1, 0), np.int32)
        while len(states) and states[0] >= 0:
            n = self.offsets[states + 1] - self.offsets[states]
            of = np.repeat(np.arange(len(states)), n)
            at = np.arange(len(of)) + np.repeat(self.offsets[states] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            ids = np.column_stack([ids[of], self.labels[at]])
            counted = self.weights[at] > 0
            out.append((ids[counted], self.weights[at][counted]))
            on = self.targets[at] >= 0
            states, ids = self.targets[at][on].astype(np.int64), ids[on]
        return out

    def dumps(self) -> bytes:
        sizes = np.array([len(w) for w in self.words], np.int32)
        wide = self.weights.size and int(self.weights.max()) >= 1 << 31
        weights = self.weights if wide else self.weights.astype(np.int32)
        head = struct.pack("<qqq?", len(self.words), len(self.offsets), len(self.labels), bool(wide))
        parts = [head, sizes.tobytes(), np.diff(self.offsets).astype(np.int32).tobytes(), self.labels.tobytes(), weights.tobytes(), self.targets.tobytes(), b"".join(self.words)]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @staticmethod
    def loads(blob: bytes) -> CountAutomaton:
        data = zstandard.ZstdDecompressor().decompress(blob)
        n, m, t, wide = struct.unpack_from("<qqq?", data)
        at = struct.calcsize("<qqq?")

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        ends = at + 4 * (n + m - 1) + t * (16 if wide else 12) + np.cumsum(take(n, np.int32), dtype=np.int64)
        offsets = np.concatenate([[0], np.cumsum(take(m - 1, np.int32), dtype=np.int64)])
        labels, weights, targets = take(t, np.int32), take(t, np.int64 if wide else np.int32).astype(np.int64), take(t, np.int32)
        stops = ends.tolist()
        words = [data[a:b] for a, b in zip([at, *stops[:-1]], stops)]
        return CountAutomaton(words, offsets, labels, weights, targets)

    def compose(self, counts: CountAutomaton) -> Iterator[tuple[tuple[int, ...], int]]:
        """(phrase in own word numbers, its count there) for each own phrase that ``counts`` has too: both are walked side by side."""
        number = {w: i for i, w in enumerate(counts.words)}
        there = np.array([number.get(w, -1) for w in self.words], np.int64)
        todo = [(len(self.offsets) - 2, len(counts.offsets) - 2, ())]
        while todo:
            a, b, path = todo.pop()
            own, theirs = (slice(x.offsets[s], x.offsets[s + 1]) for x, s in ((self, a), (counts, b)))
            labels = counts.labels[theirs]
            if not len(labels):
                continue
            want = there[self.labels[own]]
            at = np.minimum(np.searchsorted(labels, want), len(labels) - 1)
            for i in np.flatnonzero(labels[at] == want).tolist():
                here, k = own.start + i, theirs.start + int(at[i])
                phrase = (*path, int(self.labels[here]))
                if self.weights[here] > 0 and counts.weights[k] > 0:
                    yield phrase, int(counts.weights[k])
                if self.targets[here] >= 0 and counts.targets[k] >= 0:
                    todo.append((int(self.targets[here]), int(counts.targets[k]), phrase))


class Union:
    """Sums automata as they come; ``least`` drops phrases below a count at the end."""

    def __init__(self, most: int = 4_000_000):
        self.words: dict[bytes, int] = {}
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.most, self.held, self.bound = most, 0, most

    def add(self, automaton: CountAutomaton) -> None:
        own = np.array([self.words.setdefault(w, len(self.words)) for w in automaton.words], np.int32)
        for ids, w in automaton.levels():
            if len(ids):
                self.rows.setdefault(ids.shape[1], []).append((own[ids], w))
                self.held += len(ids)
        if self.held > self.bound:
            self._fold()

    def _fold(self) -> None:
        folded = self._sorted()[1]
        self.rows = {ids.shape[1]: [(ids, w)] for ids, w in folded if len(ids)}
        self.held = sum(len(ids) for ids, _ in folded)
        self.bound = max(self.most, 2 * self.held)

    def _sorted(self, rank: np.ndarray | None = None) -> tuple[None, Levels]:
        levels: Levels = []
        for ids, w in (pair for pairs in self.rows.values() for pair in pairs):
            levels.append((ids if rank is None else rank[ids], w))
        tree, out = _tree(levels), []
        ids = np.empty((1, 0), np.int32)
        for up, label, w in tree:
            ids = np.column_stack([ids[up], label.astype(np.int32)])
            out.append((ids[w > 0], w[w > 0]))
        return None, out

    def result(self, least: int = 1) -> CountAutomaton:
        names = sorted(self.words)
        rank = np.empty(len(names), np.int32)
        rank[[self.words[w] for w in names]] = np.arange(len(names), dtype=np.int32)
        levels = [(ids[w >= least], w[w >= least]) for ids, w in self._sorted(rank)[1]]
        used = np.zeros(len(names), bool)
        for ids, _ in levels:
            used[ids.ravel()] = True
        place = np.cumsum(used).astype(np.int32) - 1
        return CountAutomaton.build([w for w, u in zip(names, used.tolist()) if u], [(place[ids], w) for ids, w in levels])
