"""Thresholds by class of document: quantiles over trusted documents, by language and length."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored

STEPS = 1024  #: steps of a measure to 1


def units(measure: str) -> Column:
    """A measure as a whole number of steps, as it is held against a limit."""
    return F.rint(F.col(measure) * STEPS).cast("long")


def with_limit(judged: DataFrame, trusted: DataFrame, measure: str, quantile: float, least: int, limit: str, *, tail: bool = True) -> DataFrame:
    """judged (lang, n, measure, ...) with a column ``limit``, from the trusted of like language and length.

    The limit is the least step that a share of ``quantile`` of them does not exceed. In a class of fewer than
    1 / (1 - quantile) documents that is the largest, which one odd document makes. With ``tail`` the limit is then what
    their median and 0.9 quantile let expect of a tail that falls off exponentially, as logarithms of chances do; without
    it such a class has no limit of its own, and if all documents together are so few, the largest of all is taken.
    Length is the binary order of magnitude of n. A class with fewer than ``least`` trusted documents takes the limit of
    its language, then of its length in all languages, then of all; with no trusted documents it is null. Quantiles come
    from counts by step, so a task sees as many rows as a measure has steps, not documents. Classes are bounded by the
    languages and some twenty lengths, so limits are joined by broadcast.
    """
    size = F.floor(F.log2(F.col("n") + 1)).cast("int")
    judged = judged.withColumn("_size", size)
    bins = trusted.where(F.col(measure).isNotNull()).withColumn("_size", size).groupBy("lang", "_size", units(measure).alias("_u")).agg(F.count("*").alias("_c"))
    bins = Stored(bins, "steps").df
    for name, cols in (("_both", ["lang", "_size"]), ("_by_lang", ["lang"]), ("_by_size", ["_size"]), ("_every", [])):
        every = W.partitionBy(*cols, F.lit(0))
        counts = bins.groupBy(*cols, "_u").agg(F.sum("_c").alias("_c"))
        counts = counts.select(*cols, "_u", F.sum("_c").over(every).alias("_all"), F.sum("_c").over(every.orderBy("_u")).alias("_upto"))
        at = lambda q: F.min(F.when(F.col("_upto") >= F.ceil(F.col("_all") * F.lit(q)), F.col("_u")))
        limit_of, few = at(quantile), math.ceil(1 / (1 - quantile) - 1e-9)
        if tail and quantile > 0.9:
            far = F.floor(at(0.9) + (at(0.9) - at(0.5)) * F.lit(math.log(0.1 / (1 - quantile)) / math.log(5)))
            limit_of = F.when(F.max("_all") >= few, limit_of).otherwise(far)
        fewest = (least if tail else max(least, few)) if cols else 1
        limits = counts.where(F.col("_all") >= fewest).groupBy(*(F.col(c).alias(f"{name}{c}") for c in cols)).agg((limit_of / F.lit(STEPS)).alias(name))
        on = F.lit(True)
        for c in cols:
            on &= F.col(c).eqNullSafe(F.col(f"{name}{c}"))
        judged = judged.join(F.broadcast(limits), on, "left").drop(*(f"{name}{c}" for c in cols))
    return judged.withColumn(limit, F.coalesce("_both", "_by_lang", "_by_size", "_every")).drop("_both", "_by_size", "_by_lang", "_every", "_size")
