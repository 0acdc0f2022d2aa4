"""Quality rules: a hashed n-gram log-likelihood ratio between trusted-target and raw-corpus multinomials.

Words and word pairs are hashed to 2 ** ``bits`` buckets each (a parameter; few buckets average the weight of rare
words away); the raw multinomial counts every document, the target
one every document labelled of quality 1 and not toxic but a held-out tenth. A document's score is the mean of
log(target / raw) over its n-grams, so normalised by length, and beside it the mean over the worst ``worst_share`` of its
words: a few words that the corpus has and the target never has do not move the whole mean. It is kept when both reach a low quantile of the held-out documents of like language
and length. Counts travel as packed runs of ``PART`` buckets; the weights, one number a bucket, go to every
worker.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE_TABLE, Stored, WordHashes, mix, words
from .thresholds import units, with_limit
from .trusted import held_out, texts_of, trusted_keys

BUCKET_BITS = 20  # up to 32
PART, BLOCK_GRAMS = 4096, 1_000_000
ALPHA, QUANTILE, LEAST = 1.0, 0.002, 30
MIN_WORDS, MOST_REPEATED = 50, 50
WORST_SHARE = 0.05
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_CHARS = np.array([not (b == 32 or 9 <= b <= 13 or b & 0xC0 == 0x80) for b in range(256)], np.int64)
_SYMBOLS = np.array([chr(b) in "#*$%&|<>" for b in range(256)], np.int64)


def _grams(short: np.ndarray, bits: int) -> np.ndarray:
    """Buckets of a text's words, then of its pairs, from its 32-bit word hashes."""
    s = short.astype(np.uint64)
    pairs = mix((s[:-1] << np.uint64(32)) + s[1:] + _P) >> np.uint64(64 - bits)
    return np.concatenate([s >> np.uint64(32 - bits), pairs + np.uint64(1 << bits)]).astype(np.int64)


def _short(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(32)).astype("<u4")


def _packed(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Counts by part, byte planes apart, so that shuffle compression finds the zeros."""
    planes = [np.ascontiguousarray(n.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for n in parts.values()]
    return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array(planes, pa.binary())], names=["part", "n"])


def _unpacked(planes: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _count(bits: int):
    """Bucket counts of a task's texts, block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, held, size = np.zeros(2 << bits, np.int64), [], 0
        hashes = WordHashes()
        for batch in batches:
            for b in batch.column(0).cast(pa.binary()).to_pylist():
                held.append(_grams(_short(hashes.of(words(b, SPACE_TABLE))), bits))
                size += len(held[-1])
                if size >= BLOCK_GRAMS:
                    totals += np.bincount(np.concatenate(held), minlength=2 << bits)
                    held, size = [], 0
        if held:
            totals += np.bincount(np.concatenate(held), minlength=2 << bits)
        width = min(PART, 2 << bits)
        yield _packed({i: n for i, n in enumerate(totals.reshape(-1, width)) if n.any()})

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the packed counts of each part; a partition has all rows of its parts."""
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, planes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = _unpacked(planes)
            sums[part] = sums[part] + n if part in sums else n
    yield _packed(sums)


def repeated_words(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each of several texts the words that lie in 3-word windows found twice or more in it."""
    n, out = len(hashes), np.zeros(len(lengths), np.int64)
    if n < 4:
        return out
    doc = np.repeat(np.arange(len(lengths)), lengths)
    same = doc[2:] == doc[:-2]
    key = mix(mix(hashes[:-2] * _P + hashes[1:-1]) * _Q + hashes[2:] * _P + doc[2:].astype(np.uint64))
    at = np.flatnonzero(same)
    key = key[at]
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    equal = sorted_key[1:] == sorted_key[:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:]] |= equal
    twice[order[:-1]] |= equal
    hit = np.zeros(n, bool)
    starts = at[twice]
    for k in range(3):
        hit[starts + k] = True
    return np.bincount(doc[hit], minlength=len(lengths))


def _by_text(table: np.ndarray, joined: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[joined])])
    return sums[starts + sizes] - sums[starts]


RESULT = {"n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(), "n_repeat_words": T.LongType(), "score": T.DoubleType(), "worst": T.DoubleType()}


def _worst(ratios: np.ndarray, share: float) -> float:
    """The mean ratio of the worst share of a text's words, one at least."""
    k = max(1, math.ceil(len(ratios) * share))
    return float(np.partition(ratios, k - 1)[:k].mean())


def _measure(weights, bits: int, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, weight = WordHashes(), weights.value
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                sizes = np.array([len(t) for t in texts], np.int64)
                starts = np.cumsum(sizes) - sizes
                joined = np.frombuffer(b"".join(texts), np.uint8)
                hashed = [cache.of(words(t, SPACE_TABLE)) for t in texts]
                lengths = np.array([len(h) for h in hashed], np.int64)
                dups = []
                for t in texts:
                    lines = [x for x in t.split(b"\n") if x.strip()]
                    dups.append(len(lines) - len(set(lines)))
                ratios = [weight[_grams(_short(h), bits)] for h in hashed]
                score, worst = [float(r.mean()) if len(r) else None for r in ratios], [_worst(r[:n], share) if n else None for r, n in zip(ratios, lengths)]
                columns = [
                    part.column(0), part.column(2), pa.array(lengths),
                    pa.array(_by_text(_CHARS, joined, starts, sizes)), pa.array(_by_text(_SYMBOLS, joined, starts, sizes)), pa.array(dups, pa.int64()),
                    pa.array(repeated_words(np.concatenate(hashed) if hashed else np.empty(0, np.uint64), lengths)), pa.array(score, pa.float64()), pa.array(worst, pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "lang", *RESULT])

    return run


def apply_rules(
    docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE, min_words: int = MIN_WORDS, most_repeated: int = MOST_REPEATED,
    bits: int = BUCKET_BITS, worst_share: float = WORST_SHARE,
) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, score, threshold, worst, worst_threshold, base_failed, kept), a row a row.

    A null or empty text has no words: score null, base_failed. Without target documents there is no threshold and the
    base measures alone decide. Repeated rows are judged alike; rows with a null key are judged but never target; an
    empty table gives an empty result; labels that repeat or contradict count a document as target once if any of them
    says so; other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("t"), docs[f"`{lang}`"].alias("lang"))
    kind, lang_kind = rows.schema["id"].dataType, rows.schema["lang"].dataType
    good, held = trusted_keys(labels, kind), held_out("g")
    counts = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("n", T.BinaryType())])
    target = texts_of(rows, good.where(~held)).mapInArrow(_count(bits), counts)
    raw = rows.select("t").mapInArrow(_count(bits), counts)
    half, width = 1 << bits, min(PART, 2 << bits)
    logs = []
    for counted in (target, raw):
        c = np.full(2 * half, ALPHA)
        for r in counted.repartition("part").mapInArrow(_merge, counts).collect():  # a row a part of the buckets
            c[r["part"] * width : (r["part"] + 1) * width] += _unpacked(r["n"])
        logs.append(np.log(c) - np.log(np.repeat([c[:half].sum(), c[half:].sum()], half)))
    weights = spark.sparkContext.broadcast(logs[0] - logs[1])
    measured = T.StructType([T.StructField("id", kind), T.StructField("lang", lang_kind), *(T.StructField(k, t) for k, t in RESULT.items())])
    judged = Stored(rows.mapInArrow(_measure(weights, bits, worst_share), measured), "measures").df.withColumn("n", F.col("n_words")).withColumns({"loss": -F.col("score"), "flaw": -F.col("worst")})
    base = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    seen = judged.where(~base).join(good.where(held).hint("merge"), F.col("id") == F.col("g"), "left_semi")
    judged = with_limit(judged, seen, "loss", 1 - quantile, LEAST, "limit")
    judged = with_limit(judged, seen, "flaw", 1 - quantile, LEAST, "most")
    verdict = F.coalesce(units("loss") <= units("limit"), F.lit(True)) & F.coalesce(units("flaw") <= units("most"), F.lit(True))
    return judged.select(
        F.col("id").alias(key), *(c for c in RESULT if c not in ("score", "worst")), F.round("score", 9).alias("score"), F.round(-F.col("limit"), 9).alias("threshold"),
        F.round("worst", 9).alias("worst"), F.round(-F.col("most"), 9).alias("worst_threshold"),
        base.alias("base_failed"), (~base & verdict).alias("kept"),
    )
