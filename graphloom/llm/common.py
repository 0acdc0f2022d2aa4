"""Shared helpers: durable intermediate tables, word splitting, word hashing."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.durable import Stored

__all__ = ["ALNUM_TABLE", "SPACE_LOWER_TABLE", "SPACE_TABLE", "Stored", "WordHashes", "apart", "free_name", "mix", "partitions", "pick", "words"]

#: Words of the contamination and licence operators: after lower-casing A-Z these bytes part words.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Words parted by ASCII white space, case kept.
SPACE_TABLE = bytes(32 if 9 <= c <= 13 else c for c in range(256))
#: Words parted by ASCII white space, A-Z lower-cased.
SPACE_LOWER_TABLE = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words(text: bytes | None, table: bytes) -> list[bytes]:
    """UTF-8 words of a text; a null text has none."""
    if not text:
        return []
    found = text.translate(table).split(b" ")
    return [w for w in found if w] if b"" in found else found


class WordHashes(dict):
    """Stable 64-bit hashes of words, remembered up to a bound."""

    def __init__(self, limit: int = 1 << 20, seed: int = 0):
        super().__init__()
        self.limit, self.seed = limit, seed

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that clashes with none of the frame's, whatever its case."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def apart(key: str, *names: str) -> list[str]:
    """A result's column names beside its key's: one that clashes with the key, whatever its case, gets ``_``."""
    return [n + "_" * (n.lower() == key.lower()) for n in names]


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: extra columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
