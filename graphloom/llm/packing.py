"""Sequence packing: non-negative least squares over shallow length combinations.

One pass tokenises every text and cuts it into full windows and one shorter tail; pieces go to a stored table with
their checksums. The histogram of tail sizes (in bins of ``UNIT`` tokens, so bounded) reaches the driver. There shallow
combinations of bins that fill the window are enumerated, their repeat counts solved against the histogram by
non-negative least squares and rounded down, and what is left over is packed greedily, bin counts at a time. The plan,
bounded by the number of bins, goes back as intervals of ranks: the k-th tail of a bin knows its sequence and slot by
arithmetic, and ranks come from counts for each task and bin. Token ids never shuffle.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stored
from .token_counts import byte_alphabet

WINDOW, UNIT, DEPTH = 2048, 8, 3
MEMO, PIECES = 450_000, 150_000  #: chunks and pieces of chunks that a worker remembers

#: A lower-casing word tokenizer's normaliser and splitter. Chunks of ASCII and precomposed Latin letters
#: (without the added tokens' opening) are split here by the same pattern and merged by the tokenizer's model, pieces
#: being remembered; any other chunk, or tokenizer, goes through the library whole.
_NORMAL = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zà-öø-ÿßœæ]+|[0-9]|[^\\sa-zà-öø-ÿßœæ0-9]+")
_NOT_PLAIN = re.compile("[^\x21-\x7eÀ-ÖØ-öø-ÿŒœ]|<\\|")

_PIECES = "k {key}, start long, length long, ids_crc32 long, doc_tokens long, bin int, task int, nth long"


class Encoder(dict):
    """Token ids as little-endian unsigned 32-bit bytes, by white-space-parted chunk, remembered up to a bound."""

    def __init__(self, config: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; small batches would pay for threads
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(config)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.pieces: dict[str, bytes] = {}
        spec = json.loads(config)
        self.plain = (spec["normalizer"], spec["pre_tokenizer"], spec["model"].get("dropout")) == (_NORMAL, _SPLIT, None)
        self.plain &= not any(t["lstrip"] or t["rstrip"] or t["single_word"] or "<|" not in t["content"] for t in spec["added_tokens"])
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.model, self.alphabet = self.tokenizer.model, byte_alphabet()

    def _piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() else "".join([self.alphabet[b] for b in piece.encode()])
        b = b"".join([self.bytes_of[t.id] for t in self.model.tokenize(mapped)])
        if len(piece) <= 64:
            self.pieces[piece] = b
        return b

    def __missing__(self, chunk: str) -> bytes:
        if self.plain and not _NOT_PLAIN.search(chunk):
            known = self.pieces.get
            b = b"".join([known(p) or self._piece(p) for p in _PIECE.findall(chunk.lower())])
        else:
            b = b"".join([self.bytes_of[i] for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])
        if len(chunk) <= 64:
            self[chunk] = b
        return b

    def encode(self, text: str | None) -> bytes:
        """Exact for tokenizers that drop white space: no token spans a space or line feed."""
        if not text:
            return b""
        if len(self) > MEMO:
            self.clear()
        if len(self.pieces) > PIECES:
            self.pieces.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@lru_cache(maxsize=1)
def _encoder(config: str) -> Encoder:
    """A worker keeps its encoder, and what it remembers, from task to task."""
    return Encoder(config)


def _drops_space(config: str) -> bool:
    """Whether the tokenizer ignores white space, so chunks can be encoded apart."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(config)
    one = lambda x: t.encode(x, add_special_tokens=False).ids
    return all(one(a + s + b) == one(a) + one(b) for a in ("ab", "a.", "é", "1") for b in ("cd", "'s", ".x", "2") for s in (" ", "\n", "  ", " \n"))


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Multisets of at most ``depth`` bins that fill a window of ``bins`` units exactly."""
    found: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int) -> None:
        if left == 0:
            found.append(chosen)
        elif len(chosen) == depth - 1:
            if not chosen or left >= chosen[-1]:
                found.append((*chosen, left))
        else:
            for b in range(chosen[-1] if chosen else 1, left + 1):
                if left - b == 0 or left - b >= b:
                    grow((*chosen, b), left - b)

    grow((), bins)
    return sorted({c for c in found if len(c) > 1})


def solve_counts(combos: list[tuple[int, ...]], histogram: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that bring the combinations' bins nearest to the histogram (accelerated projected gradient)."""
    scale = max(1.0, float(histogram.max()))
    target = histogram / scale
    usable = np.array([all(histogram[b] > 0 for b in c) for c in combos])
    counts = np.zeros(len(combos))
    at = np.flatnonzero(usable)
    if not len(at):
        return counts
    width = max(len(combos[i]) for i in at)
    slots = np.array([[*combos[i], *[0] * (width - len(combos[i]))] for i in at])
    weight = (slots > 0).astype(float)
    n = len(histogram)
    hits = np.bincount(slots.ravel(), weight.ravel(), n)
    step = 1.0 / max(1.0, float((hits * width).max()))
    x = y = np.zeros(len(at))
    t = 1.0
    for _ in range(rounds):
        over = np.bincount(slots.ravel(), (weight * y[:, None]).ravel(), n) - target
        new = np.maximum(0.0, y - step * (over[slots] * weight).sum(1))
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    counts[at] = x * scale
    return counts


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(combination, repeats) that use up the histogram exactly: index b counts tails of b units."""
    bins = len(histogram) - 1
    left = histogram.astype(np.int64).copy()
    done: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        done.append(((bins,), int(left[bins])))
        left[bins] = 0
    combos = combinations(bins, depth)
    solved = solve_counts(combos, left)
    for i in np.argsort(-solved, kind="stable"):
        if solved[i] < 0.5:
            break
        need = np.bincount(combos[i], minlength=bins + 1)
        used = np.flatnonzero(need)
        repeats = min(int(round(solved[i])), int((left[used] // need[used]).min()))
        if repeats:
            done.append((combos[i], repeats))
            left -= repeats * need
    while left.any():  # greedy best fit decreasing, as often as the counts allow at a time; a round empties a bin
        chosen: list[int] = []
        room, rest = bins, left.copy()
        while True:
            fitting = np.flatnonzero(rest[: room + 1])
            if not len(fitting):
                break
            b = int(fitting[-1])
            chosen.append(b)
            rest[b] -= 1
            room -= b
        need = np.bincount(chosen, minlength=bins + 1)
        used = np.flatnonzero(need)
        repeats = int((left[used] // need[used]).min())
        done.append((tuple(sorted(chosen)), repeats))
        left -= repeats * need
    return done


def _cut(config: str, window: int, unit: int, end_id: int):
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        encoder, seen = _encoder(config), np.zeros(-(-window // unit) + 1, np.int64)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                encoded = list(map(encoder.encode, part.column(1).to_pylist()))
                row, start, length, crc, tokens, bins, nth = [], [], [], [], [], [], []
                for i, ids in enumerate(encoded):
                    ids += end
                    n = len(ids) // 4
                    view = memoryview(ids)
                    for s in range(0, n, window):
                        m = min(window, n - s)
                        b = -(-m // unit)
                        row.append(i)
                        start.append(s)
                        length.append(m)
                        crc.append(zlib.crc32(view[4 * s : 4 * (s + m)]))
                        tokens.append(n)
                        bins.append(b)
                        nth.append(int(seen[b]))
                        seen[b] += 1
                keys = part.column(0).take(pa.array(row, pa.int64()))
                columns = [keys, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens)), pa.array(bins, pa.int32()), pa.array([task] * len(row), pa.int32()), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "start", "length", "ids_crc32", "doc_tokens", "bin", "task", "nth"])

    return run


def pack(
    docs: DataFrame, tokenizer_json: str, *, key: str = "doc_id", text: str = "text", window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end_id: int = 1
) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset) of each piece.

    A document's tokens are those of its text (none for a null or empty one) and then ``end_id``, so each row has one
    piece at least; pieces are full windows and a tail. Sequences hold at most ``window`` tokens, gapless from 0.
    Repeated rows and null keys are packed row by row; an empty table gives no pieces; other columns are not read.
    """
    if window % unit:
        raise ValueError("window must be a multiple of unit")
    spark: SparkSession = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as f:
        config = f.read()
    if not _drops_space(config):
        raise ValueError("packing encodes white-space-parted chunks apart; this tokenizer keeps white space")
    rows = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    pieces = Stored(rows.mapInArrow(_cut(config, window, unit, end_id), T._parse_datatype_string(_PIECES.format(key=kind))), "pieces").df
    bins = window // unit
    counts = pieces.groupBy("bin", "task").agg(F.count("*").alias("n"))
    histogram = np.zeros(bins + 1, np.int64)
    for r in counts.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # one row a bin
        histogram[r["bin"]] = r["n"]
    steps = plan(histogram, depth)
    intervals, first_sequence, used = [], 0, np.zeros(bins + 1, np.int64)
    for combo, repeats in steps:
        slot = 0
        for b in sorted(set(combo)):
            m = combo.count(b)
            intervals.append((b, int(used[b]), int(used[b]) + m * repeats, m, first_sequence, slot))
            used[b] += m * repeats
            slot += m
        first_sequence += repeats
    before = W.partitionBy("bin").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(F.col("bin").alias("o_bin"), F.col("task").alias("o_task"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    schema = "p_bin int, p_from long, p_to long, p_each long, p_sequence long, p_slot long"
    planned = F.broadcast(spark.createDataFrame(intervals, schema))  # bounded by bins and depth, whatever the input
    ranked = pieces.join(offsets, (F.col("bin") == F.col("o_bin")) & (F.col("task") == F.col("o_task"))).withColumn("rank", F.col("before") + F.col("nth"))
    placed = ranked.join(planned, (F.col("bin") == F.col("p_bin")) & (F.col("rank") >= F.col("p_from")) & (F.col("rank") < F.col("p_to")))
    within = F.col("rank") - F.col("p_from")
    placed = placed.withColumn("sequence_id", F.col("p_sequence") + F.floor(within / F.col("p_each")).cast("long")).withColumn("slot", F.col("p_slot") + within % F.col("p_each"))
    so_far = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)
    return placed.select(
        F.col("k").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", F.coalesce(F.sum("length").over(so_far), F.lit(0)).cast("long").alias("offset")
    )
