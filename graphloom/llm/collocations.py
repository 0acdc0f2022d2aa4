"""Phrase collocations by count automata of shards, united by prefix range.

Words are counted first. A phrase that occurs often has often only parts that do, so bigrams are counted among frequent
words and trigrams among frequent bigrams; what is frequent is known to the tasks by a table of bits of a fixed size,
which may let through more but never less. A shard's phrases, sorted, become one automaton for each range of prefixes
(language, first word, and second word where the first is very frequent); the automata of a range meet in one task and
are united. Parts of a candidate that begin another range's phrases are looked up there by composing the automaton of
all asked parts with that range's.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.durable import Stored
from .common import mix
from .count_automata import CountAutomaton, Union

#: Bounds that are fixed whatever the input: bits of a sieve, ranges, bytes of a word in a range's bound.
SIEVE_BITS, MOST_RANGES, BOUND_BYTES = 26, 1 << 14, 64
#: Counted words a range should have; words, phrases or characters that a task holds before it sends them on.
RANGE_WORDS, HELD_WORDS, HELD_PHRASES = 1_000_000, 300_000, 3_000_000
_STEP, _BREAK = np.uint64(0x9E3779B97F4A7C15), b"\n"
_TABLE = bytes(10 if 10 <= c <= 13 or c in b".,;:!?" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
_BLOCK = 1 << 16


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, a line feed between pieces, and empty strings between neighbouring spaces."""
    return text.translate(_TABLE).replace(b"\n", b" \n ").split(b" ") if text else []


def _seed(lang: bytes) -> int:
    return xxhash.xxh3_64_intdigest(lang)


# ---- sieves -------------------------------------------------------------------------------------------------------


def _bits(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            h = batch.column(0).to_numpy().view(np.uint64) & np.uint64((1 << width) - 1)
            block = h // np.uint64(_BLOCK)
            for b in np.unique(block).tolist():
                bits = held.setdefault(b, np.zeros(_BLOCK, bool))
                bits[(h[block == np.uint64(b)] % np.uint64(_BLOCK)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], names=["block", "bits"])

    return run


def sieve(hashes: DataFrame, width: int = SIEVE_BITS) -> bytes:
    """2 ** width bits, one set for each of hashes (h); blocks of bits are made by tasks."""
    block = F.col("h").bitwiseAND((1 << width) - 1) / _BLOCK
    made = hashes.repartition(F.floor(block)).mapInArrow(_bits(width), "block long, bits binary")
    out = np.zeros((1 << width) // _BLOCK * (_BLOCK // 8), np.uint8).reshape(-1, _BLOCK // 8)
    for r in made.collect():  # 2 ** width bits in all
        out[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return out.tobytes()


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bits) * 8 - 1)
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


# ---- words --------------------------------------------------------------------------------------------------------


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n): counts of a task, sent on when it holds many different words."""
    held: dict[str, Counter] = {}

    def send() -> pa.RecordBatch:
        langs, found, n = [], [], []
        for lang, counts in held.items():
            counts.pop(b"", None)
            counts.pop(_BREAK, None)
            langs += [lang] * len(counts)
            found += counts.keys()
            n += counts.values()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, pa.binary()), pa.array(n, pa.int64())], names=["lang", "word", "n"])

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            held.setdefault(lang, Counter()).update(tokens(text.as_buffer().to_pybytes() if text.is_valid else None))
            if sum(map(len, held.values())) > HELD_WORDS:
                yield send()
    yield send()


def _word_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, found = (batch.column(i).cast(pa.binary()).to_pylist() for i in (0, 1))
        h = np.array([xxhash.xxh3_64_intdigest(w, _seed(lang)) for lang, w in zip(langs, found)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])


# ---- ranges -------------------------------------------------------------------------------------------------------


def _cuts(target: int):
    """Of sorted (lang, word, n), the words at which another ``target`` of counts is full, with what they fill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        full = 0
        for batch in batches:
            at = []
            for i, n in enumerate(batch.column(2).to_pylist()):
                full += n
                if full >= target:
                    at.append(i)
                    full = 0
            yield batch.take(pa.array(at, pa.int64()))

    return run


class Ranges:
    """Ranges of prefixes (language, first word, second word), by their lower bounds."""

    def __init__(self, bounds: list[tuple[bytes, bytes, bytes]]):
        self.bounds = bounds

    @staticmethod
    def of(words: DataFrame, size: int = RANGE_WORDS) -> Ranges:
        """From (lang, word, n). A word that would fill several ranges alone is cut by its second words, where other words of the language are cut."""
        total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        target = max(size, -(-total // MOST_RANGES))
        cuts = words.repartitionByRange("lang", "word").sortWithinPartitions("lang", "word").mapInArrow(_cuts(target), words.schema).collect()  # a row a range at most
        found = sorted((bytes(r["lang"].encode()), bytes(r["word"])[:BOUND_BYTES], r["n"]) for r in cuts)
        bounds = set()
        for lang, word, n in found:
            bounds.add((lang, word, b""))
            parts = n // target
            if parts > 1:
                inner = [w for other, w, _ in found if other == lang]
                bounds.update((lang, word, inner[i * len(inner) // parts]) for i in range(1, parts))
                bounds.add((lang, word + b"\x00", b""))
        return Ranges(sorted(bounds))

    def at(self, lang: bytes, first: bytes, second: bytes) -> int:
        return bisect_right(self.bounds, (lang, first, second))

    def all_of(self, lang: bytes, first: bytes) -> range:
        """The ranges that phrases with this first word are in."""
        return range(self.at(lang, first, b""), bisect_left(self.bounds, (lang, first + b"\x00", b"")) + 1)


# ---- shards -------------------------------------------------------------------------------------------------------


_END = np.array([-1], np.int64)


class _Numbers(dict):
    """Words of one language by the order in which they were met; -1 for rare words and breaks, -2 for nothing."""

    def __init__(self, bits: np.ndarray, seed: int):
        super().__init__({b"": -2, _BREAK: -1})
        self.bits, self.seed, self.top = bits, seed, len(bits) * 8 - 1
        self.names: list[bytes] = []
        self.hashes: list[int] = []

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        k = -1
        if self.bits[(h & self.top) >> 3] >> (h & 7) & 1:
            k = len(self.names)
            self.names.append(word)
            self.hashes.append(h)
        self[word] = k
        return k


class _Shard:
    """Phrases of one task, by language, as numbers of the words met so far."""

    def __init__(self, size: int, ranges: Ranges, word_bits: np.ndarray, pair_bits: np.ndarray | None):
        self.size, self.ranges, self.word_bits, self.pair_bits = size, ranges, word_bits, pair_bits
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, _Numbers] = {}
        self.runs: dict[bytes, list[np.ndarray]] = {}
        self.found: dict[bytes, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = self.waiting = 0

    def add(self, lang: bytes, text: bytes | None) -> None:
        number = self.number.get(lang)
        if number is None:
            number = self.number[lang] = _Numbers(self.word_bits, _seed(lang))
        found = tokens(text)
        run = np.fromiter(map(number.__getitem__, found), np.int64, len(found))
        self.runs.setdefault(lang, []).extend((run[run != -2], _END))
        self.waiting += len(run)
        if self.waiting > 1_000_000:
            self._count()

    def _count(self) -> None:
        for lang, runs in self.runs.items():
            a = np.concatenate(runs)
            both = (a[:-1] >= 0) & (a[1:] >= 0)
            if self.size == 3:
                h = np.array(self.number[lang].hashes or [0], np.uint64)
                at = np.flatnonzero(both)
                both[at] = _passes(self.pair_bits, mix(h[a[at]] * _STEP + h[a[at + 1]]))
                both = both[:-1] & both[1:]
            at = np.flatnonzero(both)
            keys = a[at] << np.int64(32) | a[at + 1]
            if self.size == 3:  # phrases of three: pairs are numbered within the block
                pairs, of = np.unique(keys, return_inverse=True)
                found, n = np.unique(of << np.int64(32) | a[at + 2], return_counts=True)
                ids = np.column_stack([pairs[found >> np.int64(32)] >> np.int64(32), pairs[found >> np.int64(32)] & np.int64(0xFFFFFFFF), found & np.int64(0xFFFFFFFF)])
            else:
                found, n = np.unique(keys, return_counts=True)
                ids = np.column_stack([found >> np.int64(32), found & np.int64(0xFFFFFFFF)])
            if len(ids):
                self.found.setdefault(lang, []).append((ids.astype(np.int32), n.astype(np.int64)))
                self.held += len(ids)
        self.runs.clear()
        self.waiting = 0

    def full(self) -> bool:
        return self.held > HELD_PHRASES or sum(map(len, self.number.values())) > 4 * HELD_WORDS

    def automata(self) -> Iterator[tuple[int, bytes]]:
        """(range, automaton) of all phrases held, in order; then nothing is held."""
        self._count()
        for lang, parts in sorted(self.found.items()):
            names = self.number[lang].names
            order = sorted(range(len(names)), key=names.__getitem__)
            words = [names[i] for i in order]
            rank = np.empty(len(names), np.int64)
            rank[order] = np.arange(len(names))
            ids, n = rank[np.concatenate([p[0] for p in parts])], np.concatenate([p[1] for p in parts])
            bounds = self.ranges.bounds
            lo, hi = bisect_left(bounds, (lang, b"", b"")), bisect_left(bounds, (lang + b"\x00", b"", b""))
            prefix = ids[:, 0] << np.int64(32) | ids[:, 1]
            cuts = np.array([self._place(words, f, s) for _, f, s in bounds[lo:hi]], np.int64)
            of = lo + np.searchsorted(cuts, prefix, "right")
            by = np.argsort(of, kind="stable")
            starts = np.flatnonzero(np.diff(of[by], prepend=-1))
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(by)]):
                own, counts = ids[by[s:e]], n[by[s:e]]
                used, place = np.unique(own, return_inverse=True)
                yield int(of[by[s]]), _with_lang(lang, [words[i] for i in used.tolist()], [(place.reshape(own.shape), counts)]).dumps()
        self.clear()

    @staticmethod
    def _place(words: list[bytes], first: bytes, second: bytes) -> int:
        """The least prefix, in word numbers, that is not below a bound."""
        i = bisect_left(words, first)
        same = i < len(words) and words[i] == first
        return i << 32 | (bisect_left(words, second) if same else 0)


def _with_lang(lang: bytes, words: list[bytes], levels) -> CountAutomaton:
    """The automaton whose phrases all begin with the language, as a label of its own."""
    label = b"\x00" + lang
    names = sorted([label, *words])
    at = names.index(label)
    shifted = [(np.column_stack([np.full(len(ids), at), ids + (ids >= at)]).astype(np.int32), w) for ids, w in levels]
    return CountAutomaton.build(names, shifted)


def _shard(size: int, ranges: Ranges, word_bits, pair_bits=None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard(size, ranges, np.frombuffer(word_bits.value, np.uint8), None if pair_bits is None else np.frombuffer(pair_bits.value, np.uint8))

        def send() -> Iterator[pa.RecordBatch]:
            for at, blob in shard.automata():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([blob], pa.binary())], names=["range", "automaton"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard.add(lang.encode(), text.as_buffer().to_pybytes() if text.is_valid else None)
                if shard.full():
                    yield from send()
        yield from send()

    return run


def _single_words(ranges: Ranges):
    """Automata of single words (lang, word, n) for every range that phrases beginning with them are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: dict[tuple[int, bytes], list[tuple[bytes, int]]] = {}
            for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for at in ranges.all_of(lang.encode(), word):
                    held.setdefault((at, lang.encode()), []).append((word, n))
            blobs = []
            for (at, lang), own in held.items():
                own.sort()
                blobs.append((at, _with_lang(lang, [w for w, _ in own], [(np.arange(len(own)).reshape(-1, 1), np.array([n for _, n in own], np.int64))]).dumps()))
            yield pa.RecordBatch.from_arrays([pa.array([b[0] for b in blobs], pa.int64()), pa.array([b[1] for b in blobs], pa.binary())], names=["range", "automaton"])

    return run


def _unite(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, union = None, Union()

        def record() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([union.result(least).dumps()], pa.binary())], names=["range", "automaton"])

        for batch in batches:
            for at, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                if at != now:
                    if now is not None:
                        yield record()
                    now, union = at, Union()
                union.add(CountAutomaton.loads(blob.as_py()))
        if now is not None:
            yield record()

    return run


def united(automata: DataFrame, least: int) -> DataFrame:
    """One automaton a range, with the phrases counted ``least`` times or more."""
    return automata.repartition("range").sortWithinPartitions("range").mapInArrow(_unite(least), "range long, automaton binary")


def _pair_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(1):
            x = CountAutomaton.loads(blob.as_py())
            for ids, _ in x.levels():
                if ids.shape[1] == 3:
                    out = []
                    for lang in np.unique(ids[:, 0]).tolist():
                        seed = _seed(x.words[lang][1:])
                        own = ids[ids[:, 0] == lang]
                        h = np.zeros(len(x.words), np.uint64)
                        for i in np.unique(own[:, 1:]).tolist():
                            h[i] = xxhash.xxh3_64_intdigest(x.words[i], seed)
                        out.append(mix(h[own[:, 1]] * _STEP + h[own[:, 2]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["h"])


# ---- candidates ---------------------------------------------------------------------------------------------------


def _phrases(least: int):
    """(lang, words, a, parts): candidates of a range's automaton. parts has what each cut's first part counts; that is in the same range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                x = CountAutomaton.loads(blob.as_py())
                names = [w.decode("utf-8") for w in x.words]
                levels = x.levels()
                counts: dict[tuple[int, ...], int] = {}
                langs, found, a, parts = [], [], [], []
                for ids, w in levels:
                    for phrase, n in zip(map(tuple, ids.tolist()), w.tolist()):
                        counts[phrase] = n
                        if len(phrase) > 2 and n >= least:
                            langs.append(names[phrase[0]][1:])
                            found.append([names[i] for i in phrase[1:]])
                            a.append(n)
                            parts.append([counts[phrase[:k]] for k in range(2, len(phrase))])
                kind = pa.list_(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(found, kind), pa.array(a, pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=["lang", "words", "a", "parts"])

    return run


def _ranged(ranges: Ranges):
    """Adds to (lang, part) the range in which the part is counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [ranges.at(lang.encode(), p[0].encode(), p[1].encode() if len(p) > 1 else b"") for lang, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), batch.column(0), batch.column(1)], names=["range", "lang", "part"])

    return run


def _looked_up(counts: pa.Table, asked: pa.Table) -> pa.Table:
    """The counts of the asked phrases of one range, by composing their automaton with the range's."""
    langs, parts = asked.column("lang").to_pylist(), asked.column("part").to_pylist()
    phrases = [("\x00" + lang, *p) for lang, p in zip(langs, parts)]
    names = sorted({w.encode() for p in phrases for w in p})
    number = {w: i for i, w in enumerate(names)}
    by: dict[int, list[list[int]]] = {}
    for p in phrases:
        by.setdefault(len(p), []).append([number[w.encode()] for w in p])
    own = CountAutomaton.build(names, [(np.array(rows, np.int32), np.ones(len(rows), np.int64)) for rows in by.values()])
    found = [hit for blob in counts.column("automaton").to_pylist() for hit in own.compose(CountAutomaton.loads(blob))]
    text = [w.decode("utf-8") for w in names]
    return pa.table({"lang": pa.array([text[p[0]][1:] for p, _ in found], pa.string()), "part": pa.array([[text[i] for i in p[1:]] for p, _ in found], pa.list_(pa.string())), "n": pa.array([n for _, n in found], pa.int64())})


def collocations(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: int = 10, top: int = 2000, share: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the ``top`` phrases of two or three words by score.

    a, l and r count the phrase and the parts of its weakest cut; n counts all words; the score is floor(1000000 a a / (l r)).
    A phrase whose words lie inside a longer candidate that has ``share`` percent of its count is left out. A null text
    is empty, a null language is ``und``; texts of separators alone have no words; repeated rows count each; an empty
    table, or one without a phrase that occurs ``least`` times, gives an empty result. Other columns are not read.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(docs[f"`{lang}`"], F.lit("und")).alias("lang"), docs[f"`{text}`"].cast("binary").alias("t"))
    words = Stored(texts.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    often = words.df.where(F.col("n") >= least)
    ranges = Ranges.of(often)
    word_bits = spark.sparkContext.broadcast(sieve(often.select("lang", "word").mapInArrow(_word_hashes, "h long")))
    kind = "range long, automaton binary"
    pairs = Stored(united(texts.mapInArrow(_shard(2, ranges, word_bits), kind), least), "pairs")
    pair_bits = spark.sparkContext.broadcast(sieve(pairs.df.mapInArrow(_pair_hashes, "h long")))
    shards = Stored(texts.mapInArrow(_shard(3, ranges, word_bits, pair_bits), kind), "shards")
    for b in (word_bits, pair_bits):
        b.destroy()
    counts = Stored(united(shards.df.union(pairs.df).union(often.mapInArrow(_single_words(ranges), kind)), least), "counts")
    shards.drop()
    pairs.drop()

    found = Stored(counts.df.mapInArrow(_phrases(least), "lang string, words array<string>, a long, parts array<long>"), "phrases").df
    cuts = found.select("lang", "words", "a", F.posexplode("parts").alias("k", "l"))
    cuts = cuts.select("lang", "words", "a", "k", "l", F.slice("words", F.col("k") + 2, F.size("words")).alias("part"))
    asked = cuts.select("lang", "part").distinct().mapInArrow(_ranged(ranges), "range long, lang string, part array<string>")
    replies = counts.df.groupBy("range").cogroup(asked.groupBy("range")).applyInArrow(_looked_up, "lang string, part array<string>, n long")
    replies = Stored(replies, "parts").df.select(F.col("lang").alias("g"), F.col("part").alias("p"), F.col("n").alias("r"))
    whole = "decimal(38,0)"
    score = F.expr(f"cast(cast(a as decimal(16,0)) * cast(a as decimal(15,0)) * cast(1000000 as decimal(7,0)) as {whole}) div cast(cast(l as decimal(19,0)) * cast(r as decimal(18,0)) as {whole})")
    scored = cuts.join(replies, (F.col("lang") == F.col("g")) & (F.col("part") == F.col("p"))).withColumn("score", score)
    best = scored.groupBy("lang", "words", "a").agg(F.min_by(F.struct("l", "r", "score"), F.struct("score", "k")).alias("x"))
    longer = found.where(F.size("words") > 2).select("lang", "a", F.explode(F.array(F.slice("words", 1, 2), F.slice("words", 2, 2))).alias("w2"))
    longer = longer.groupBy(F.col("lang").alias("lg"), "w2").agg(F.max("a").alias("most"))
    kept = best.join(longer, (F.col("lang") == F.col("lg")) & (F.col("words") == F.col("w2")), "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("a")))
    rows = kept.select("lang", F.array_join("words", " ").alias("phrase"), "a", "x.l", "x.r", "x.score")
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))).where(F.col("rank") <= top)
    all_words = words.df.groupBy(F.col("lang").alias("lw")).agg(F.sum("n").alias("n"))
    return ranked.join(all_words, F.col("lang") == F.col("lw")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
