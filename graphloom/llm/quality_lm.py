"""Quality classifier: an interpolated modified Kneser-Ney bigram model of trusted text.

Counts, contexts and discounts come from all trusted text but a held-out tenth; the vocabulary is every word of it.
Words are 48-bit hashes, so nothing hangs on how rows are dealt to tasks. Bigrams are counted in a square grid of cells,
by the hash of the first word and of the second: a frequent word is spread over a row or column of cells, and the
weights of words, which are needed beside each of their bigrams, go to one row and one column only.

The log-probability of a document is a sum over its words and over its bigrams: log p(w|v) = log p1(w) + log gamma(v) +
delta(v, w), where delta is 0 for a bigram never seen. What lies in the model is keyed by hashes as wide as the model
asks for (``SPARE_BITS`` beyond its size, so that an unseen bigram meets another's weight once in 2^16 times). A worker
sends each cell the sorted keys of a block of documents as one packed row, the cell sends back one row of sums for the
block, and sums are whole numbers, so that they do not hang on the order of addition. Only the weights of at most ``HOT``
frequent words go to every worker.

Two limits are quantiles over trusted documents of like language and length: one of the loss a word, over held-out
documents, and one of the share of bigrams that repeat an earlier one of their document, over all trusted documents. To
a bigram model the same word again and again is not unlikely, so perplexity alone lets such texts pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_TABLE, Stored, WordHashes, mix, partitions, words
from .thresholds import units, with_limit
from .trusted import held_out, texts_of, trusted_keys

QUANTILE, LEAST = 0.998, 30
HOT = 1 << 17  #: words whose weights go to every worker
BLOCK_WORDS, KNOWN_WORDS = 500_000, 1 << 18  #: what a worker holds at once: words of a block, hashes it remembers
PARTS = 2  #: parts of the documents that are scored one after another
UNIT = 4096.0
SPARE_BITS = 16
EDGE = 0  # opens and closes a text

ROW, NAMES = "cell int, kind int, block long, a binary, b binary", ["cell", "kind", "block", "a", "b"]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
FIRST, SECOND, PAIRS, WORDS, ASKED_PAIRS, ASKED_WORDS, TOLD, OWN = range(8)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts from the counts of counts 1 to 4; sparse ones fall back to plain values."""
    n1, n2, n3, n4 = n
    if not (n1 and n2):
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.0]
    return tuple(min(max(x, 0.01), k - 0.01) for k, x in enumerate(d, 1))  # type: ignore[return-value]


def _discount(c, d: tuple[float, float, float]):
    return F.when(c == 1, d[0]).when(c == 2, d[1]).otherwise(d[2])


def _pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Byte planes apart, so that compression finds the zeros; of an increasing array, of its differences."""
    d = np.ascontiguousarray(np.diff(x, prepend=0) if rising else x).astype("<i8")
    raw = d.view(np.uint8).reshape(-1, 8).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unpack(b: bytes, rising: bool = False) -> np.ndarray:
    raw = pa.Codec("zstd").decompress(b[8:], int.from_bytes(b[:8], "little"), asbytes=True)
    x = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<i8").ravel()
    return np.cumsum(x) if rising else x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=NAMES)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(batch.column(i).to_pylist() for i in range(len(_KINDS))))


def _hashes(t: bytes | None, known: WordHashes) -> np.ndarray:
    return (known.of(words(t, SPACE_TABLE)) >> np.uint64(16)).astype(np.int64)


def _closed(t: bytes | None, known: WordHashes) -> np.ndarray:
    return np.concatenate([[EDGE], _hashes(t, known), [EDGE]])


def _part(h: np.ndarray, side: int, second: bool = False) -> np.ndarray:
    """The row of the grid that a word takes as a first word, or its column as a second one."""
    return (mix(h.astype(np.uint64) + np.uint64(second)) >> np.uint64(8)).astype(np.int64) % side


def _cell(v: np.ndarray, w: np.ndarray, side: int) -> np.ndarray:
    return _part(v, side) * side + _part(w, side, True)


def _key(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    return (mix(v.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + mix(w.astype(np.uint64))) >> np.uint64(64 - bits)).astype(np.int64)


def _runs(*sorted_arrays: np.ndarray) -> np.ndarray:
    """Where a new value starts in arrays that are sorted together."""
    new = np.ones(len(sorted_arrays[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([a[1:] != a[:-1] for a in sorted_arrays])
    return np.flatnonzero(new)


def _by_cell(cell: np.ndarray, cells: int) -> Iterator[tuple[int, slice]]:
    bounds = np.searchsorted(cell, np.arange(cells + 1))
    return ((c, slice(a, b)) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b)


# The model ----------------------------------------------------------------------------------------------------------


def _summed(v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    by = np.lexsort((w, v))
    v, w, c = v[by], w[by], c[by]
    at = _runs(v, w)
    return v[at], w[at], np.add.reduceat(c, at) if len(at) else c


def _pair_row(cell: int, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> tuple:
    return cell, PAIRS, 0, _pack(v, True), _pack(np.concatenate([w, c]))


def _pairs(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _unpack(a, True), *np.split(_unpack(b), 2)


def _count(side: int):
    """Texts to rows PAIRS: a block's bigrams and their counts, by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size = WordHashes(KNOWN_WORDS), [], 0

        def flush() -> pa.RecordBatch:
            v, w = np.concatenate([s[:-1] for s in held]), np.concatenate([s[1:] for s in held])
            v, w, c = _summed(v, w, np.ones(len(v), np.int64))
            cell = _cell(v, w, side)
            by = np.argsort(cell, kind="stable")
            v, w, c, cell = v[by], w[by], c[by], cell[by]
            return _batch([_pair_row(k, v[s], w[s], c[s]) for k, s in _by_cell(cell, side * side)])

        for batch in batches:
            for t in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(_closed(t, known))
                size += len(held[-1])
                if size >= BLOCK_WORDS:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell's rows PAIRS as one; block holds the number of its bigrams."""
    now, held = None, []

    def flush() -> pa.RecordBatch:
        v, w, c = _summed(*(np.concatenate(x) for x in zip(*held)))
        cell, kind, _, a, b = _pair_row(now, v, w, c)
        return _batch([(cell, kind, len(v), a, b)])

    for batch in batches:
        for cell, _, _, a, b in _rows(batch):
            if cell != now and held:
                yield flush()
                held = []
            now = cell
            held.append(_pairs(a, b))
    if held:
        yield flush()


def _by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a cell knows of its words: as a first word, bigrams met once, twice and more often and all places; as a second one, bigrams.

    Beside them, under the hash -1, how many bigrams the cell has met once to four times."""
    for batch in batches:
        for _, _, _, a, b in _rows(batch):
            v, w, c = _pairs(a, b)
            at = _runs(v)
            once, twice, more, places = (np.add.reduceat(x.astype(np.int64), at) for x in (c == 1, c == 2, c > 2, c))
            seconds, k = np.unique(w, return_counts=True)
            none, zero = np.zeros(len(seconds), np.int64), np.zeros(len(at), np.int64)
            of = [(c == i).sum() for i in (1, 2, 3, 4)]
            columns = [
                np.concatenate([x, y, [z]])
                for x, y, z in zip([v[at], once, twice, more, places, zero], [seconds, none, none, none, none, k], [-1, *of, 0])
            ]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["h", "n1", "n2", "n3", "total", "k"])


def _roles(side: int):
    """Words (h, mass, p) to rows FIRST and SECOND: to a row of cells with mass, to a column of cells with p."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, *weights = (np.concatenate(x) for x in zip(*held))
            by = np.argsort(h)
            for kind, x in zip((FIRST, SECOND), weights):
                part = _part(h[by], side, kind == SECOND)
                for p in range(side):
                    some = by[part == p]
                    if len(some):
                        a, b = _pack(h[some], True), _pack(x[some].astype(np.float32).view(np.int32).astype(np.int64))
                        yield _batch([(p * side + i if kind == FIRST else i * side + p, kind, 0, a, b) for i in range(side)])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            size += batch.num_rows
            if size >= BLOCK_WORDS:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return run


class _Table:
    """Sorted keys with values, from packed parts."""

    def __init__(self, wide: bool = True):
        self.parts, self.wide, self.keys, self.values = [], wide, np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, a: bytes, b: bytes) -> None:
        self.parts.append((_unpack(a, True), _unpack(b)))

    def at(self, asked: np.ndarray) -> np.ndarray:
        """The values of the asked keys, 0 where there is none."""
        if self.parts:
            keys, values = (np.concatenate(x) for x in zip(*self.parts))
            by = np.lexsort((values, keys))  # of two words of one key the smaller value counts, whatever their order
            self.keys, self.values, self.parts = keys[by], values[by], []
        if not len(self.keys):
            return np.zeros(len(asked), np.int64)
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        return np.where(self.keys[at] == asked, self.values[at], 0)


def _floats(bits: np.ndarray) -> np.ndarray:
    return bits.astype(np.int32).view(np.float32).astype(np.float64)


def _deltas(d: tuple[float, float, float], bits: int):
    """A cell's words and bigrams to rows PAIRS of keys and deltas: log(1 + (c - D) / (mass(v) p1(w)))."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, first, second = None, _Table(), _Table()
        for batch in batches:
            for cell, kind, _, a, b in _rows(batch):
                if cell != now:
                    now, first, second = cell, _Table(), _Table()
                if kind != PAIRS:
                    (first if kind == FIRST else second).add(a, b)
                    continue
                v, w, c = _pairs(a, b)
                share = (c - np.array(d)[np.minimum(c, 3) - 1]) / (_floats(first.at(v)) * _floats(second.at(w)))
                keys, weights = _key(v, w, bits), np.rint(UNIT * np.log1p(share)).astype(np.int64)
                by = np.argsort(keys, kind="stable")
                yield _batch([(cell, PAIRS, 0, _pack(keys[by], True), _pack(weights[by]))])

    return run


class Model:
    """rows: the stored rows PAIRS and the rows WORDS of the cells; hot, heavy: hashes of frequent words, ascending, and
    their log p1 + log gamma beyond that of an unseen word, ``unseen``, all in units."""

    def __init__(self, docs: DataFrame, trusted: DataFrame, hot: int):
        spark = docs.sparkSession
        self.side = side = max(1, math.isqrt(partitions(spark)))
        self.cells = cells = side * side
        counted = texts_of(docs, trusted).mapInArrow(_count(side), ROW)
        grid = Stored(counted.repartition(cells, "cell").sortWithinPartitions("cell").mapInArrow(_merge, ROW), "bigrams")
        each = grid.df.mapInArrow(_by_word, "h long, n1 long, n2 long, n3 long, total long, k long")
        known = Stored(each.groupBy("h").agg(*(F.sum(c).alias(c) for c in ("n1", "n2", "n3", "total", "k"))), "words")
        said = known.df.where("h = -1").first()
        d2 = discounts([said[c] for c in ("n1", "n2", "n3", "total")] if said else [0] * 4)
        found, k = known.df.where("h >= 0"), F.col("k")
        r = found.agg(*(F.count(F.when(k == i, 1)).alias(f"k{i}") for i in (1, 2, 3, 4)), F.sum("k").alias("every"), F.count("*").alias("types"), F.max("total").alias("most")).first()
        d1, every, types = discounts([r[f"k{i}"] for i in (1, 2, 3, 4)]), r["every"] or 0, r["types"]
        cut = found.select(F.sum(F.when(k == 1, 1).otherwise(0)), F.sum(F.when(k == 2, 1).otherwise(0)), F.sum(F.when(k > 2, 1).otherwise(0))).first()
        rest = sum(n * x for n, x in zip(cut, d1)) / every if every else 1.0
        p = (k - _discount(k, d1)) / float(every or 1) + F.lit(rest / (types + 1))
        mass = F.col("n1") * d2[0] + F.col("n2") * d2[1] + F.col("n3") * d2[2]
        gamma = F.least(F.lit(1.0), mass / F.col("total"))
        self.unseen = round(UNIT * math.log(rest / (types + 1)))
        unit = lambda x: F.rint(UNIT * x).cast("long")
        found = found.select("h", "total", mass.alias("mass"), p.alias("p"), (unit(F.log(p)) + unit(F.log(gamma)) - self.unseen).alias("weight"))
        # as many of the most frequent words as surely are no more than hot: all of some sizes on
        size = F.floor(16 * F.log2("total")).cast("int")
        sizes = found.groupBy(size.alias("s")).agg(F.count("*").alias("n")).orderBy(F.col("s").desc()).collect()
        least, room = None, hot
        for row in sizes:
            room -= row["n"]
            if room < 0:
                break
            least = row["s"]
        top = found.where(size >= least).select("h", "weight").toPandas() if least is not None else None
        self.hot, self.heavy = (top[c].to_numpy(np.int64) for c in ("h", "weight")) if top is not None else (np.empty(0, np.int64),) * 2
        by = np.argsort(self.hot)
        self.hot, self.heavy = self.hot[by], self.heavy[by]
        most = grid.df.agg(F.max("block")).first()[0] or 0
        self.bits = min(48, int(most).bit_length() + SPARE_BITS)
        self.word_bits = min(48, (int(types) // cells).bit_length() + SPARE_BITS)
        roles = found.select("h", "mass", "p").mapInArrow(_roles(side), ROW)
        meet = roles.union(grid.df).repartition(cells, "cell").sortWithinPartitions("cell", "kind")
        self.deltas = Stored(meet.mapInArrow(_deltas(d2, self.bits), ROW), "deltas")
        grid.drop()
        rare = found.where(size < least) if least is not None else found
        self.known = known
        self.rows = self.deltas.df.union(rare.select("h", "weight").mapInArrow(_words(cells, self.word_bits), ROW))

    def drop(self) -> None:
        self.deltas.drop()
        self.known.drop()

    def __getstate__(self) -> dict:
        """What workers need: bounded arrays and numbers."""
        return {k: getattr(self, k) for k in ("side", "cells", "bits", "word_bits", "unseen", "hot", "heavy")}

    def heavy_of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words are hot, and the sum of weights up to each."""
        if not len(self.hot):
            return np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.hot, h), len(self.hot) - 1)
        hot = self.hot[at] == h
        return hot, np.where(hot, self.heavy[at], 0)


def _word_place(h: np.ndarray, cells: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return _part(h, cells), _key(h, h, bits)


def _words(cells: int, bits: int):
    """Words (h, weight) to rows WORDS of their cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            h, weight = (np.concatenate(x) for x in zip(*held))
            cell, key = _word_place(h, cells, bits)
            by = np.lexsort((key, cell))
            cell, key, weight = cell[by], key[by], weight[by]
            return _batch([(c, WORDS, 0, _pack(key[s], True), _pack(weight[s])) for c, s in _by_cell(cell, cells)])

        for batch in batches:
            held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)])
            size += batch.num_rows
            if size >= BLOCK_WORDS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


# Documents ----------------------------------------------------------------------------------------------------------


def _asked(kind: int, block: int, cell: np.ndarray, key: np.ndarray, doc: np.ndarray, cells: int, bits: int) -> list[tuple]:
    """Rows of the keys asked of each cell, with the document and how often it has the key."""
    k, d = bits, max(1, int(doc.max(initial=0)).bit_length())
    if k + d + cells.bit_length() > 63:
        by = np.lexsort((doc, key, cell))
        cell, key, doc = cell[by], key[by], doc[by]
    else:
        packed = np.sort((cell << (k + d)) | (key << d) | doc)
        cell, key, doc = packed >> (k + d), (packed >> d) & ((1 << k) - 1), packed & ((1 << d) - 1)
    at = _runs(cell, key, doc)
    times = np.diff(at, append=len(cell))
    cell, key, doc = cell[at], key[at], doc[at]
    return [(c, kind, block, _pack(key[s], True), _pack(np.concatenate([doc[s], times[s]]))) for c, s in _by_cell(cell, cells)]


def _ask(model: Model):
    """Documents to rows ASKED, the keys asked of a cell, and OWN, a block's keys, sizes, repeats and scores so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, held, docs, size = WordHashes(KNOWN_WORDS), [], [], 0
        block = TaskContext.get().partitionId() << 32

        def flush() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(s) - 1 for s in held])
            doc = np.repeat(np.arange(len(held)), sizes)
            v, w = np.concatenate([s[:-1] for s in held]), np.concatenate([s[1:] for s in held])
            hot, heavy = model.heavy_of(w)
            starts = np.cumsum(sizes) - sizes
            base = np.add.reduceat(heavy, starts) + model.unseen * sizes
            cell, rare = _cell(v, w, model.side), ~hot
            rows = _asked(ASKED_PAIRS, block, cell, _key(v, w, model.bits), doc, model.cells, model.bits)
            fresh = np.zeros(len(held), np.int64)
            for *_, b in rows:
                fresh += np.bincount(np.split(_unpack(b), 2)[0], minlength=len(held))
            if rare.any():
                cell, key = _word_place(w[rare], model.cells, model.word_bits)
                rows += _asked(ASKED_WORDS, block, cell, key, doc[rare], model.cells, model.word_bits)
            rows.append((block % model.cells, OWN, block, _pack(np.array(docs)), _pack(np.concatenate([base, sizes - 1, fresh]))))
            for r in rows:
                yield _batch([r])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.append(_closed(t, known))
                docs.append(i)
                size += len(held[-1])
                if size >= BLOCK_WORDS:
                    yield from flush()
                    held, docs, size, block = [], [], 0, block + 1
        if held:
            yield from flush()

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A cell's model rows come first; then each block's keys are looked up and added by document: rows TOLD. OWN pass."""
    now, tables = None, {}
    for batch in batches:
        for cell, kind, block, a, b in _rows(batch):
            if cell != now:
                now, tables = cell, {PAIRS: _Table(), WORDS: _Table()}
            if kind in tables:
                tables[kind].add(a, b)
            elif kind == OWN:
                yield _batch([(cell, kind, block, a, b)])
            else:
                doc, times = np.split(_unpack(b), 2)
                values = tables[PAIRS if kind == ASKED_PAIRS else WORDS].at(_unpack(a, True)) * times
                total = np.bincount(doc, values.astype(np.float64))
                some = np.flatnonzero(total)
                if len(some):
                    yield _batch([(cell, TOLD, block, _pack(some, True), _pack(np.rint(total[some]).astype(np.int64)))])


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a block together, TOLD and then OWN: a row a document."""
    now, told = None, []
    for batch in batches:
        for _, kind, block, a, b in _rows(batch):
            if block != now:
                now, told = block, []
            if kind == TOLD:
                told.append((_unpack(a, True), _unpack(b)))
                continue
            ids, (base, sizes, fresh) = _unpack(a), _unpack(b).reshape(3, -1)
            total = base.copy()
            for at, more in told:
                total[at] += more
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, sizes, fresh, total)], names=["id", "n", "fresh", "units"])


def score(docs: DataFrame, trusted: DataFrame, *, hot: int = HOT, parts: int = PARTS) -> DataFrame:
    """(id, n, nats, fresh), stored: words, log-probability and distinct bigrams of each document of docs (id, t).

    ids are not null, trusted has distinct ids g. The bigrams of a text are one more than its words: its edges count.
    Documents are dealt by id to ``parts`` that are scored one after another, so that only one part's keys are on disk."""
    model = Model(docs, trusted, hot)
    scored: DataFrame | None = None
    for p in range(parts):
        some = docs.select("id", "t").where(F.pmod(F.xxhash64("id"), F.lit(parts)) == p)
        # in the order of keys, so that a task that is run again gives the same blocks
        asked = some.sortWithinPartitions("id", F.xxhash64("t")).mapInArrow(_ask(model), ROW)
        met = model.rows.union(asked).repartition(model.cells, "cell").sortWithinPartitions("cell", "kind").mapInArrow(_meet, ROW)
        blocks = met.repartition(model.cells, "block").sortWithinPartitions("block", "kind")
        sums = blocks.mapInArrow(_add, "id long, n long, fresh long, units long").groupBy("id")
        found = Stored(sums.agg(F.sum("n").alias("n"), (F.sum("units") / F.lit(UNIT)).alias("nats"), F.sum("fresh").alias("fresh")), "scores").df
        scored = found if scored is None else scored.union(found)
    model.drop()
    assert scored is not None
    return scored


def classify(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, hot: int = HOT, parts: int = PARTS
) -> DataFrame:
    """(key, n_words, perplexity, threshold, repeats, most_repeats, kept) of each document that has a key; keys are whole numbers.

    Trusted are the documents labelled of quality 1 and not toxic. A class is a language (null being one) and the
    binary order of magnitude of the number of words; one with fewer than ``LEAST`` trusted documents takes the
    limit of its language, then of its length, then of all. kept: perplexity is at most ``threshold``, the quantile of
    held-out trusted documents, and repeats, the share of bigrams met before in the document, at most ``most_repeats``,
    that of all trusted documents. A null, empty or blank text has no words, perplexity null, and is not kept. Without
    trusted documents there are no limits and every document with words is kept. Rows that repeat a key are judged
    together, as one text of their largest language; rows with a null key are left out; an empty table gives an empty
    result. hot, the most words whose weights are sent to every
    worker, and parts, one after another in which documents are scored, change no result. docs is read once for the model
    and once for each part.
    """
    rows = docs.select(docs[f"`{key}`"].cast("long").alias("id"), docs[f"`{text}`"].alias("t"), docs[f"`{lang}`"].alias("lang")).where("id is not null")
    good, held = trusted_keys(labels, "long"), held_out("g")
    scored = score(rows.select("id", "t"), good.where(~held), hot=hot, parts=parts)
    judged = rows.groupBy("id").agg(F.max("lang").alias("lang")).join(scored.hint("merge"), "id")
    some = F.col("n") > 0
    judged = judged.withColumns({"loss": F.when(some, -F.col("nats") / (F.col("n") + 1)), "repeats": F.when(some, 1 - F.col("fresh") / (F.col("n") + 1))})
    trusted = judged.join(good.hint("merge"), F.col("id") == F.col("g"), "left").withColumn("role", F.when(F.col("g").isNull(), 0).when(held, 2).otherwise(1))
    judged = Stored(trusted.select("id", "lang", "n", "loss", "repeats", "role"), "losses").df
    judged = with_limit(judged, judged.where("role = 2 and n > 0"), "loss", quantile, LEAST, "limit")
    judged = with_limit(judged, judged.where("role > 0 and n > 0"), "repeats", quantile, LEAST, "most", tail=False)
    within = lambda x, most: F.coalesce(units(x) <= units(most), F.lit(True))
    return judged.select(
        F.col("id").alias(key), F.col("n").alias("n_words"), F.round(F.exp("loss"), 6).alias("perplexity"), F.round(F.exp("limit"), 6).alias("threshold"),
        F.round("repeats", 6).alias("repeats"), F.round("most", 6).alias("most_repeats"), (some & within("loss", "limit") & within("repeats", "most")).alias("kept"),
    )
