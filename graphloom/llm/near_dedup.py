"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of minhash groups, A and B, stand for all tables: table (i, j) has the key (A_i, B_j), so
``groups ** 2`` tables of ``2 * rows`` minhashes each cost ``2 * groups * rows`` hash functions instead of
``2 * rows * groups ** 2``. Two documents of similarity s share a table with probability (1 - (1 - s**rows)**groups)**2:
0.9991 at 0.75 and above 0.9999 at 0.85 by default.

Documents of equal shingle sets are one class from the start. A table's key enters only where both its halves are
shared by two classes at least. Links are then sought without all pairs of a bucket: in a few pivot rounds a class is
verified against one member of another component that shares its buckets; a last, exact round takes the classes whose
buckets still hold different components and verifies every pair of them whose rarest shingles allow a link, so that no
link that shares a table is lost. Links count only when the full sets agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import linked
from ..plans.durable import replaced
from .common import SPACE_LOWER_TABLE, Stored, WordHashes, apart, mix, words

SHINGLE, PERCENT = 5, 75
GROUPS, ROWS, PIVOT_ROUNDS, LOOK_BACK = 14, 3, 4, 32
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes | None, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit shingle hashes of a text; a shorter text's whole sequence is one shingle."""
    found = words(text, SPACE_LOWER_TABLE)
    if not found:
        return np.empty(0, np.uint64)
    w = hashes.of(found)
    m = max(1, len(w) - size + 1)
    k = min(size, len(w))
    h = np.full(m, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : i + m]
    return np.unique(mix(h))


def _coefficients(groups: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    at = np.arange(2 * groups * rows, dtype=np.uint64)
    return mix(at + np.uint64(1)) | np.uint64(1), mix(at + np.uint64(1_000_003))


def sketch(sets: list[np.ndarray], groups: int, rows: int) -> np.ndarray:
    """For each non-empty set 2 * groups keys: those of A and then those of B."""
    a, b = _coefficients(groups, rows)
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    keys = np.empty((len(sets), 2 * groups), np.uint64)
    buffer = np.empty_like(flat)
    for g in range(2 * groups):
        key = np.full(len(sets), g + 1, np.uint64)
        for r in range(g * rows, (g + 1) * rows):
            np.multiply(flat, a[r], out=buffer)
            np.add(buffer, b[r], out=buffer)
            buffer ^= buffer >> np.uint64(31)
            key = mix(key * _STEP + np.minimum.reduceat(buffer, starts))
        keys[:, g] = key
    return keys


def _sign(groups: int, rows: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [shingles(t, hashes, size) for t in part.column(1).cast(pa.binary()).to_pylist()]
                full = [s for s in sets if len(s)]
                keys = iter(sketch(full, groups, rows).view(np.int64)) if full else iter(())
                columns = [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([int(mix(s).sum().view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([int(mix(s ^ _STEP).sum().view(np.int64)) if len(s) else 0 for s in sets], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "n", "h1", "h2", "keys"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                sets = [shingles(t, hashes, size).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "set"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("set").alias("sb"))
    met = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("common"))
    return met.where(100 * F.col("common") >= percent * (F.col("both") - F.col("common"))).select("a", "b")


def _could_link(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (id, p_id) of different labels that can be similar enough; exact, without a bucket's all pairs.

    Shingles are ordered from rare to frequent. Similar sets share one of their first n - ceil(percent% of n) + 1, and
    what follows the first shared one must still hold enough for the required overlap.
    """
    held = sets.withColumnRenamed("id", "s").join(open_.select("id"), F.col("s") == F.col("id"), "left_semi").select(F.col("s").alias("id"), F.explode("set").alias("token"))
    held = Stored(held, "tokens").df
    often = held.groupBy("token").agg(F.count("*").alias("df"))
    ranked = held.join(often, "token").withColumn("i", F.row_number().over(W.partitionBy("id").orderBy("df", "token")) - 1)
    n, m, i, j = (F.col(c) for c in ("n", "p_n", "i", "j"))
    prefix = ranked.join(open_, "id").where((F.col("df") > 1) & (i <= n - F.ceil(percent * n / 100)))
    # a pair is met at its first shared shingle and not again at the next ones; how far back is looked is bounded
    before = F.collect_list("token").over(W.partitionBy("id").orderBy("i").rowsBetween(-LOOK_BACK, -1))
    prefix = Stored(prefix.select("token", "id", "n", "label", "i", before.alias("before")), "prefixes").df
    other = prefix.select(F.col("token").alias("k"), F.col("id").alias("p_id"), F.col("n").alias("p_n"), F.col("label").alias("p_label"), F.col("i").alias("j"), F.col("before").alias("p_before"))
    met = prefix.join(
        other,
        (F.col("token") == F.col("k")) & ~F.arrays_overlap("before", "p_before") & (F.col("id") < F.col("p_id")) & (F.col("label") != F.col("p_label")) & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m)),
    )
    return met.select("id", "p_id").distinct().withColumn("c", F.lit(1).cast("long"))


def near_duplicates(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", size: int = SHINGLE, percent: int = PERCENT, groups: int = GROUPS, rows: int = ROWS, pivot_rounds: int = PIVOT_ROUNDS
) -> DataFrame:
    """(key, n_shingles, component_id, kept) of each row; kept is true for the smallest key of a component.

    Texts that differ must have keys that differ. A null or empty text, or one of white space, has no shingles and is
    linked with nothing. Rows that repeat a key and text are each returned, with one component. A row with a null key is
    its own component, null, and kept. An empty table gives an empty result; other columns are not read. A result column
    that clashes with the key gets ``_``.
    """
    rows_in = docs.select(docs[f"`{key}`"].alias("id"), docs[f"`{text}`"].alias("t"))
    kind = rows_in.schema["id"].dataType
    signed = T.StructType([T.StructField("id", kind), T.StructField("n", T.LongType()), T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    sigs = Stored(rows_in.mapInArrow(_sign(groups, rows, size), signed), "signatures")
    classes = Stored(sigs.df.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep")), "classes")
    keyed = sigs.df.select("id", "n", "keys").join(classes.df.select("rep"), F.col("id") == F.col("rep"), "left_semi").dropDuplicates(["id"])
    halves = keyed.select("id", "n", F.posexplode("keys").alias("g", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select(F.col("half").alias("h"))
    halves = halves.join(shared, F.col("half") == F.col("h")).groupBy("id", "n")
    halves = halves.agg(F.collect_list(F.when(F.col("g") < groups, F.col("half"))).alias("ha"), F.collect_list(F.when(F.col("g") >= groups, F.col("half"))).alias("hb"))
    tables = halves.select("id", "n", F.explode("ha").alias("x"), "hb").select("id", "n", "x", F.explode("hb").alias("y")).select("id", "n", F.xxhash64("x", "y").alias("bucket"))
    tables = Stored(tables, "tables")
    busy = tables.df.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select(F.col("bucket").alias("k"))
    buckets = Stored(tables.df.join(busy, F.col("bucket") == F.col("k")).select("id", "n", "bucket"), "buckets")
    tables.drop()
    members = buckets.df.select("id").distinct()
    sets = Stored(
        rows_in.join(members.withColumnRenamed("id", "m"), F.col("id") == F.col("m"), "left_semi").dropDuplicates(["id"]).mapInArrow(_sets(size), T.StructType([T.StructField("id", kind), T.StructField("set", T.ArrayType(T.LongType()))])),
        "sets",
    )
    labels = Stored(members.select("id", F.col("id").alias("label")), "members")
    tested: DataFrame | None = None
    close = lambda n, m: 100 * F.least(n, m) >= percent * F.greatest(n, m)

    for turn in range(pivot_rounds + 1):
        own = buckets.df.withColumn("label", F.col("id")) if not turn else buckets.df.select("id", "n", "bucket").join(labels.df.withColumnRenamed("id", "m"), F.col("id") == F.col("m")).drop("m")
        if turn:
            # a bucket whose members share a label has no more links to give; what it held goes
            open_ = own.groupBy("bucket").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 < l1").select(F.col("bucket").alias("k"))
            buckets = replaced(buckets, own.join(open_, F.col("bucket") == F.col("k")).drop("k"), "buckets")
            own = buckets.df
        if turn < pivot_rounds:
            order = F.xxhash64("id", F.lit(turn)) if not turn else F.xxhash64("id", "bucket", F.lit(turn))
            pivot = own.groupBy("bucket").agg(*(F.min_by(c, order).alias(f"p_{c}") for c in ("id", "n", "label"))).withColumnRenamed("bucket", "k")
            met = own.join(pivot, (F.col("bucket") == F.col("k")) & (F.col("label") != F.col("p_label")) & close(F.col("n"), F.col("p_n")))
            met = met.groupBy("id", "p_id").agg(F.count("*").alias("c"))
        else:
            met = _could_link(own.select("id", "n", "label").distinct(), sets.df, percent)
        pairs = met.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"), "id", "p_id", "c")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        if turn < pivot_rounds:
            pairs = pairs.groupBy("id").agg(F.max_by("p_id", F.struct("c", "p_id")).alias("p_id")).select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b"))
        pairs = Stored(pairs.select("a", "b").distinct(), "pairs").df
        if pairs.isEmpty():
            if turn < pivot_rounds:
                continue
            break
        found = Stored(_verified(pairs, sets.df, percent), "found").df
        tested = pairs if tested is None else tested.union(pairs)
        if found.isEmpty():
            continue
        # many links may join the same two components: what is merged are labels
        ends = [labels.df.select(F.col("id").alias(f"_{x}"), F.col("label").alias(f"l{x}")) for x in "ab"]
        between = found.join(ends[0], F.col("a") == F.col("_a")).join(ends[1], F.col("b") == F.col("_b")).select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
        merged = linked(between)
        labels = Stored(labels.df.join(merged.df, F.col("label") == F.col("v"), "left").select("id", F.coalesce("c", "label").alias("label")), "members")
        merged.drop()
    rep = classes.df.join(labels.df, F.col("rep") == F.col("id"), "left").select("n", "h1", "h2", F.coalesce("label", "rep").alias("component_id"))
    classed = sigs.df.where("n > 0 and id is not null").select("id", "n", "h1", "h2").join(rep, ["n", "h1", "h2"]).select("id", "n", "component_id")
    alone = sigs.df.where("n = 0 or id is null").select("id", "n", F.col("id").alias("component_id"))
    found = classed.union(alone).select("id", "n", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
    return found.toDF(key, *apart(key, "n_shingles", "component_id", "kept"))
