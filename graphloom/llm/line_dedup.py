"""Line dedup: repeated runs of lines by distributed prefix doubling; later copies are deleted. DataFrame functions only.

Lines get order-preserving ids; ``rank_j`` sorts suffixes of the line sequences by their first 2**j lines, each rank a
pair of the ranks of the level below. Ranks come from a range sort of the distinct pairs, and only pairs that occur
twice go on, so suffixes that are settled leave at once. A run counts when it has ``min_words`` words, and the doubling
stops at the depth where that is settled: suffixes whose longest common prefix reaches m lines are the interval of
one pair of ranks (rank_j of the first and of the last 2**j of the m lines). Every maximal repeated run of
``min_words`` words or more is the union of the shortest windows of so many words that start or end at its lines; an
empty line counts as one word, so a window has ``min_words`` lines at most. Of each interval the first occurrence
stays and the others' lines go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored, free_name

MIN_WORDS = 50


def _ranked(pairs: DataFrame) -> DataFrame:
    """(x, y, r): order-preserving ranks of the distinct (x, y), by a range sort and not by one task."""
    return pairs.repartitionByRange("x", "y").sortWithinPartitions("x", "y").withColumn("r", F.monotonically_increasing_id())


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repeated_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(k, h, pos): the lines to delete, by the document's key, the hash of its text and the line's number from 0."""
    k, t = docs[f"`{key}`"], docs[f"`{text}`"]
    rows = docs.where(k.isNotNull() & t.isNotNull()).select(k.alias("k"), F.xxhash64(t).alias("h"), F.posexplode(_lines(t)).alias("pos", "line"))
    # a line's id: 96 bits of hashes, sorted as (x, y)
    lines = rows.select("k", "h", "pos", F.xxhash64("line").alias("x"), F.hash("line").alias("y"), F.greatest(F.lit(1), F.regexp_count("line", F.lit(r"\S+"))).alias("w"))
    ids = Stored(_ranked(lines.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")), "line-ids")
    named = lines.join(ids.df, ["x", "y"]).dropDuplicates(["k", "h", "pos"])
    doc = W.partitionBy("k", "h").orderBy("pos")
    named = named.withColumn("seg", F.col("pos") - F.row_number().over(doc))
    run = W.partitionBy("k", "h", "seg").orderBy("pos")
    named = named.withColumn("cum", F.sum("w").over(run.rowsBetween(W.unboundedPreceding, 0)).cast("long"))
    whole = W.partitionBy("k", "h", "seg")
    start = W.partitionBy("k", "h", "seg").orderBy("begin")
    end = W.partitionBy("k", "h", "seg").orderBy("cum")
    named = named.withColumn("begin", F.col("cum") - F.col("w")).withColumn("total", F.max("cum").over(whole))
    sized = (
        named.where(F.col("total") >= min_words)
        .withColumn("fwd", F.when(F.col("total") - F.col("begin") >= min_words, F.count("*").over(start.rangeBetween(0, min_words - 1))).cast("int"))
        .withColumn("bwd", F.when(F.col("cum") >= min_words, F.count("*").over(end.rangeBetween(1 - min_words, 0))).cast("int"))
        .withColumn("deep", F.max(F.greatest("fwd", "bwd")).over(whole))
        .select("k", "h", "seg", "pos", "r", "fwd", "bwd", "deep")
    )
    level = Stored(sized, "level")
    base = level.df
    sides = [
        base.where("fwd is not null").select("k", "h", F.col("pos").alias("at"), F.col("fwd").alias("m")),
        base.where("bwd is not null").select("k", "h", (F.col("pos") - F.col("bwd") + 1).alias("at"), F.col("bwd").alias("m")),
    ]
    windows = sides[0].union(sides[1]).distinct()
    known = base.select("k", "h", "pos", F.lit(0).alias("j"), "r")
    now, j, width = base.select("k", "h", "seg", "pos", "r", "deep"), 0, 1
    while 2 * width <= min_words:
        pairs = now.where(F.col("deep") >= 2 * width).withColumn("y", F.lead("r", width).over(run)).withColumnRenamed("r", "x")
        pairs = Stored(pairs.where("x is not null and y is not null"), "pairs")
        if pairs.df.isEmpty():
            break
        names = Stored(_ranked(pairs.df.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y")), "ranks")
        # a suffix whose pair is unique ends here; its place stays, as lead() counts rows
        before = now.where(F.col("deep") >= 2 * width).select("k", "h", "seg", "pos", "deep")
        settled = pairs.df.join(names.df, ["x", "y"]).select("k", "h", "pos", "r")
        now = Stored(before.join(settled, ["k", "h", "pos"], "left").select("k", "h", "seg", "pos", "r", "deep"), "level").df
        j, width = j + 1, 2 * width
        known = known.union(now.where("r is not null").select("k", "h", "pos", F.lit(j).alias("j"), "r"))
    windows = windows.withColumn("j", F.floor(F.log2("m")).cast("int"))
    windows = windows.withColumn("last", F.col("at") + F.col("m") - F.pow(F.lit(2), F.col("j")).cast("int"))
    first = known.select("k", "h", F.col("pos").alias("at"), "j", F.col("r").alias("x"))
    last = known.select("k", "h", F.col("pos").alias("last"), "j", F.col("r").alias("y"))
    found = windows.join(first, ["k", "h", "at", "j"]).join(last, ["k", "h", "last", "j"]).select("k", "h", "at", "m", "x", "y")
    found = Stored(found, "windows").df
    earliest = found.groupBy("m", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("k", "h", "at")).alias("e")).where("n > 1")
    earliest = Stored(earliest.select("m", "x", "y", "e"), "earliest").df  # a join of its own: a run that is very common can be split there
    later = found.join(earliest, ["m", "x", "y"])
    e = F.col("e")
    same = (F.col("k") == e["k"]) & (F.col("h") == e["h"])
    later = later.where(F.when(same, F.col("at") >= e["at"] + F.col("m")).otherwise(F.lit(True)))
    return later.select("k", "h", F.explode(F.sequence(F.col("at"), F.col("at") + F.col("m") - 1)).alias("pos")).distinct()


def dedup_lines(docs: DataFrame, *, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """The documents without later copies of repeated runs, and with columns n_lines and n_deleted (``_`` added if taken).

    Documents count in order of their keys. An earlier occurrence in the same document must end before a copy starts.
    A null text has no lines, stays null and has n_lines 0; an empty text is one empty line. A text all of whose lines
    go is empty. Rows that repeat a key and text count as one document and are cut alike; of rows that share only the
    key, both are documents. Rows with a null key stay as they are and are nobody's first copy.
    """
    gone = repeated_lines(docs, key=key, text=text, min_words=min_words)
    gone = gone.groupBy(F.col("k").alias("_k"), F.col("h").alias("_h")).agg(F.collect_list("pos").alias("_gone"))
    n_lines, n_deleted = free_name(docs, "n_lines"), free_name(docs, "n_deleted")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    k, t = F.col(f"c{names.index(key)}"), F.col(f"c{names.index(text)}")
    met = plain.join(gone, (k == F.col("_k")) & (F.xxhash64(t) == F.col("_h")), "left")
    lines = _lines(t)
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(F.col("_lines"), i))
    met = met.withColumn("_lines", lines)
    new = F.when(F.col("_gone").isNull(), t).otherwise(F.array_join(left, "\n"))
    columns = [new.alias(n) if n == text else F.col(f"c{i}").alias(n) for i, n in enumerate(names)]
    return met.select(
        *columns, F.when(t.isNull(), 0).otherwise(F.size("_lines")).cast("long").alias(n_lines), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long").alias(n_deleted)
    )
