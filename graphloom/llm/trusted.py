"""Trusted documents: those labelled of quality 1 and not toxic, and their texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HELD_OUT = 10  #: one in so many trusted documents sets limits and is not learnt from
SIEVE_BITS = 26  #: the sieve has at most 2 ** so many bits


def trusted_keys(labels: DataFrame, kind: str | T.DataType) -> DataFrame:
    """The keys g of trusted documents, each once and not null; one label that says so is enough."""
    good = labels.where((F.col("quality") == 1) & (F.col("toxic") == 0))
    return good.select(F.col("doc_id").cast(kind).alias("g")).where("g is not null").distinct()


def held_out(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(HELD_OUT)) == 0


def _places(key: str, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(bits)) + 1 for seed in (0, 1)]


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bitmap of bounded size that lets all keys g through and few others."""
    bits = 1 << min(SIEVE_BITS, max(15, (16 * keys.count()).bit_length()))
    at = keys.select(F.explode(F.array(*_places("g", bits))).alias("p"))
    maps = at.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("m"))
    sieve = np.zeros(bits // 8, np.uint8)
    for r in maps.collect():  # as many rows as the bits have blocks of 2 ** 15
        sieve[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return sieve


def _sift(sieve: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            let = np.ones(batch.num_rows, bool)
            for i in (2, 3):
                p = batch.column(i).to_numpy(zero_copy_only=False) - 1
                let &= (sieve[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1
            yield batch.select([0, 1]).filter(pa.array(let))

    return run


def texts_of(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The texts t of docs (id, t) whose id is a g of keys. Few other texts are shuffled: a sieve of bounded size goes first."""
    sieve, docs = _sieve(keys), docs.where("id is not null and t is not null").select("id", "t")
    placed = docs.select("id", "t", *(p.alias(f"p{i}") for i, p in enumerate(_places("id", 8 * len(sieve)))))
    return placed.mapInArrow(_sift(sieve), docs.schema).join(keys.hint("merge"), F.col("id") == F.col("g"), "left_semi").select("t")
