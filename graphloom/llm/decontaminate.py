"""Benchmark decontamination: an FM-index per training shard, searched for every window of the benchmark.

A shard is a bounded number of words of whole documents within one partition. Words outside the benchmark's
vocabulary end a run, as does a document's end; runs shorter than the shortest window cannot hold an occurrence and
are left out of the index. Windows are searched backwards through wavelet-tree ranks, occurrences located by sampled
suffix positions, and overlapping occurrences merged to removal spans.

The benchmark is read in blocks of ``BLOCK_WORDS`` words at most (and one item at least); a block is what executors
hold of it. Documents never shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ALNUM_TABLE, free_name, pick, words
from .fm_index import FMIndex

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_WORDS = 2_000_000
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
    ]
)
_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


class Patterns:
    """A block's distinct windows by length, each with the items it comes from."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.ids: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            w = [self.ids.setdefault(x, len(self.ids) + 1) for x in words(text.encode() if text else None, ALNUM_TABLE)]
            for i in range(max(1, len(w) - window + 1) if w else 0):
                found.setdefault(tuple(w[i : i + window]), set()).update([] if item is None else [item])
        by_length: dict[int, list[tuple[int, ...]]] = {}
        for p in found:
            by_length.setdefault(len(p), []).append(p)
        self.shortest = min(by_length, default=0)
        self.groups = []
        for length, group in sorted(by_length.items()):
            owners = [sorted(found[p]) for p in group]
            self.groups.append((length, np.array(group, np.int64), owners))


def _search(shard: list[np.ndarray], patterns: Patterns) -> tuple[list[np.ndarray | None], list[list[str]]]:
    """For each document of a shard: which words are hit, and the items found."""
    lengths = np.array([len(x) for x in shard], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    text = np.zeros(offsets[-1], np.int64)
    for x, o in zip(shard, offsets):
        text[o : o + len(x)] = x
    none: tuple[list, list] = ([None] * len(shard), [[] for _ in shard])
    if not patterns.groups:
        return none
    ends = np.flatnonzero(text == 0)
    begins = np.concatenate([[0], ends[:-1] + 1])
    long = ends - begins >= patterns.shortest
    begins, ends = begins[long], ends[long]
    if not len(begins):
        return none
    sizes = ends - begins + 1
    packed_at = np.concatenate([[0], np.cumsum(sizes)])
    back = np.repeat(begins - packed_at[:-1], sizes) + np.arange(packed_at[-1])
    index = FMIndex(text[back], len(patterns.ids))
    marks = np.zeros(len(text) + 1, np.int32)
    items: list[set[str]] = [set() for _ in shard]
    touched = np.zeros(len(shard), bool)
    any_hit = False
    for length, group, owners in patterns.groups:
        low, high = index.search(group)
        which = np.flatnonzero(low < high)
        if not len(which):
            continue
        any_hit = True
        counts = (high - low)[which]
        step = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = back[index.locate(np.repeat(low[which], counts) + step)]
        np.add.at(marks, at, 1)
        np.add.at(marks, at + length, -1)
        doc = np.searchsorted(offsets, at, side="right") - 1
        pairs = np.unique(doc * np.int64(len(group)) + np.repeat(which, counts))
        touched[doc] = True
        for d, p in zip((pairs // len(group)).tolist(), (pairs % len(group)).tolist()):
            items[d].update(owners[p])
    if not any_hit:
        return none
    hit = np.cumsum(marks[:-1]) > 0
    return [hit[o : o + n] if s else None for o, n, s in zip(offsets, lengths, touched)], [sorted(s) for s in items]


def _spans(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Merged removal spans in code points: from a stretch's first word to its last one's end."""
    spans, open_at = [], None
    for m, h in zip(_WORD.finditer(text), hit.tolist()):
        if h:
            if open_at is None:
                open_at = m.start()
            end = m.end()
        elif open_at is not None:
            spans.append({"start": open_at, "end": end})
            open_at = None
    if open_at is not None:
        spans.append({"start": open_at, "end": end})
    return spans


def _marked(text: str, spans: list[dict[str, int]], n: int) -> np.ndarray:
    """The words that lie in spans found before."""
    inside = np.zeros(n, bool)
    k = 0
    for i, m in enumerate(_WORD.finditer(text)):
        while k < len(spans) and spans[k]["end"] <= m.start():
            k += 1
        inside[i] = k < len(spans) and spans[k]["start"] <= m.start()
    return inside


def _scan(text_at: int, patterns: Patterns, shard_words: int, again: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.RecordBatch, list[bytes | None], list[np.ndarray]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            hits, items = _search([ids for _, _, all_ids in held for ids in all_ids], patterns)
            k = 0
            for batch, texts, all_ids in held:
                n = len(all_ids)
                own, own_items = hits[k : k + n], items[k : k + n]
                k += n
                if again:
                    for i, old in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                        if old["spans"]:
                            before = _marked(texts[i].decode(), old["spans"], len(all_ids[i]))
                            own[i] = before if own[i] is None else own[i] | before
                            own_items[i] = sorted({*own_items[i], *old["items"]})
                columns = [
                    pa.array([len(x) for x in all_ids], pa.int64()),
                    pa.array([0 if h is None else int(h.sum()) for h in own], pa.int64()),
                    pa.array(own_items, pa.list_(pa.string())),
                    pa.array([[] if h is None else _spans(t.decode(), h) for t, h in zip(texts, own)], pa.list_(_SPAN)),
                ]
                struct = pa.StructArray.from_arrays(columns, names=HITS.names)
                kept = batch.num_columns - again
                yield pa.RecordBatch.from_arrays([*batch.columns[:kept], struct], names=[*batch.schema.names[:kept], "_hits"])
            held.clear()

        get = patterns.ids.get
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                texts = part.column(text_at).cast(pa.binary()).to_pylist()
                all_ids = []
                for t in texts:
                    found = words(t, ALNUM_TABLE)
                    all_ids.append(np.fromiter((get(w, 0) for w in found), np.int64, len(found)))
                held.append((part, texts, all_ids))
                size += sum(map(len, all_ids))
                if size >= shard_words:
                    yield from flush()
                    size = 0
        if held:
            yield from flush()

    return run


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark in blocks that fit the driver and a worker."""
    block, size = [], 0
    for item, text in pick(benchmark, i="item_id", t="text").select(F.col("i").cast("string"), "t").toLocalIterator():
        block.append((item, text))
        size += 1 + len(text or "") // 4
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", window: int = WINDOW, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """The documents with a struct column ``hits`` (``hits_`` if taken): n_words, n_hit, items, spans.

    items are the item ids (as sorted strings) with a window of ``window`` words in the text, an item of fewer words
    being one window; spans are merged half-open code point ranges. A null or empty text has no words and no hits, as
    has an item without words; repeated rows are judged alike; an empty benchmark hits nothing; item ids that occur
    twice count once; null item ids are left out of items but their words are hit.
    """
    name = free_name(docs, "hits")
    found: DataFrame | None = None
    for block in _blocks(benchmark, block_words):
        found = _one_block(docs if found is None else found, Patterns(block, window), name, docs.columns.index(text), found is not None, shard_words)
    return _one_block(docs, Patterns([], window), name, docs.columns.index(text), False, shard_words) if found is None else found


def _one_block(df: DataFrame, patterns: Patterns, name: str, text_at: int, again: bool, shard_words: int) -> DataFrame:
    """One more column of finds; for a further block the last column is united with this block's."""
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    fields = plain.schema.fields[: len(plain.columns) - again]
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in fields] + [T.StructField("_hits", HITS)])
    names = [*df.columns[: len(fields)], name]
    return plain.mapInArrow(_scan(text_at, patterns, shard_words, again), schema).toDF(*names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The documents with every removal span cut from their text, a space in its place.

    A text that nothing was found in stays as it is, null and empty ones included; a document of which no word is left
    goes.
    """
    found = find_contamination(docs, benchmark, text=text, **options)
    name = found.columns[-1]
    spans, t = F.col(f"`{name}`")["spans"], F.col(f"`{text}`")
    bounds = F.struct(F.lit(0).alias("at"), F.lit("").alias("kept"))
    walked = F.aggregate(
        spans,
        bounds,
        lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["kept"], F.substring(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(" ")).alias("kept")),
        lambda acc: F.concat(acc["kept"], F.substring(t, acc["at"] + 1, F.length(t) - acc["at"])),
    )
    hit = F.size(spans) > 0
    left = found.where(~hit | (F.col(f"`{name}`")["n_hit"] < F.col(f"`{name}`")["n_words"]))
    return left.withColumn(text, F.when(F.size(spans) > 0, walked).otherwise(t)).select(*(F.col(f"`{c}`") for c in docs.columns))
