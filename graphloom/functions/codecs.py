"""Arrays as text, parted by single spaces: 'null' is no array, the empty text an empty one, one trailing space is dropped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def encode_array(c: Column) -> Column:
    return F.coalesce(F.array_join(F.transform(c, lambda x: x.cast("string")), " "), F.lit("null"))


def decode_array(c: Column, kind: str) -> Column:
    text = F.regexp_replace(c, " $", "")
    return F.when(c == "null", F.lit(None).cast(f"array<{kind}>")).when(text == "", F.array().cast(f"array<{kind}>")).otherwise(F.split(text, " ").cast(f"array<{kind}>"))
