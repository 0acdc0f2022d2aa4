"""Spanning forests and ranks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..graph import Graph
from ..plans.durable import Stored, cut, replaced
from .components import labels_of


#: Edges of which a task makes a forest at once, and how many a vertex there must be for that.
_CHUNK, _DENSE = 500_000, 4


def _forest_of(rows: pa.Table) -> pa.Table:
    """The least spanning forest of the rows alone, in the order of Spark's structs (w, ord, edge_id)."""
    w = rows["w"]
    keys = pa.table({"null": pc.is_valid(w), "nan": pc.fill_null(pc.is_nan(w), False), "w": pc.fill_null(w, 0.0), "ord": rows["ord"], "edge_id": rows["edge_id"]})
    rows = rows.take(pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names], null_placement="at_start"))
    ends = pa.chunked_array([*rows["src"].chunks, *rows["dst"].chunks]).combine_chunks().dictionary_encode()
    at = ends.indices.to_numpy()
    top, kept = list(range(len(ends.dictionary))), []
    for k, (a, b) in enumerate(zip(at[: len(rows)].tolist(), at[len(rows) :].tolist())):
        while top[a] != a:
            top[a] = a = top[top[a]]
        while top[b] != b:
            top[b] = b = top[top[b]]
        if a != b:
            top[a] = b
            kept.append(k)
    return rows.take(pa.array(np.array(kept, dtype=np.int64)))


def _thinned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What no circle of lighter edges of the same chunk closes; only that can be in the whole forest."""
    held, n = [], 0

    def forest() -> Iterator[pa.RecordBatch]:
        yield from _forest_of(pa.Table.from_batches(held)).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _CHUNK:
            yield from forest()
            held, n = [], 0
    if held:
        yield from forest()


def minimum_spanning_forest(g: Graph, *, weight=None) -> DataFrame:
    """The edges of the least spanning forest with ``w``; equal weights go by order, so it is unique.

    Where edges are many to a vertex, chunks of them are first thinned to their own forests, side by side. Then, round by
    round, each tree takes its least edge out and trees that meet become one.
    """
    e = g.edges.where("src <> dst").withColumn("w", (F.lit(1.0) if weight is None else weight).cast("double"))
    e = cut(e.select("edge_id", "ord", "src", "dst", "w"), "weighted")
    plain = all(isinstance(e.schema[c].dataType, (T.IntegralType, T.StringType)) for c in ("edge_id", "ord"))
    if plain and e.count() > _DENSE * g.vertices.count():
        e = cut(e.mapInArrow(_thinned, e.schema), "thinned")
    forest = Stored(g.vertices.select("id", F.col("id").alias("label")), "trees")
    chosen: DataFrame | None = None
    while True:
        trees = forest.df
        a, b = (trees.select(F.col("id").alias(f"{x}_i"), F.col("label").alias(f"{x}_l")) for x in "ab")
        out = e.join(a, F.col("src") == F.col("a_i")).join(b, F.col("dst") == F.col("b_i")).where("a_l <> b_l")
        key = F.struct("w", "ord", "edge_id", "a_l", "b_l")
        both = out.select(F.col("a_l").alias("label"), key.alias("k")).union(out.select(F.col("b_l").alias("label"), key.alias("k")))
        picked = cut(both.groupBy("label").agg(F.min("k").alias("k")).select("k.*").distinct(), "picked")
        if picked.isEmpty():
            break
        ids = picked.select("edge_id")
        chosen = ids if chosen is None else chosen.union(ids)
        merged = labels_of(trees.select(F.col("label").alias("id")).distinct(), picked.select(F.col("a_l").alias("a"), F.col("b_l").alias("b")))
        forest = replaced(forest, trees.join(merged.select(F.col("id").alias("_l"), F.col("label").alias("_n")), F.col("label") == F.col("_l")).select("id", F.col("_n").alias("label")), "trees")
    return e.limit(0) if chosen is None else e.join(chosen.distinct(), "edge_id", "left_semi")


def pagerank(g: Graph, *, damping: float = 0.85, tolerance: float = 1e-323, rounds: int = 60) -> DataFrame:
    """(id, rank): (1 - damping) + damping * what in-edges bring, from 1 / n on; unnormalised, sinks leak, parallels count."""
    n = g.vertices.count()
    out = g.edges.groupBy(F.col("src").alias("_s")).agg(F.count("*").alias("_n"))
    arcs = cut(g.edges.join(out, F.col("src") == F.col("_s")).groupBy("src", "dst").agg((F.count("*") / F.first("_n")).alias("p")), "shares")
    now = Stored(g.vertices.select("id", F.lit(1.0 / max(1, n)).alias("rank"), F.lit(0.0).alias("old")), "ranks")
    for _ in range(rounds):
        into = now.df.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.sum(F.col("rank") * F.col("p")).alias("s"))
        nxt = now.df.join(into, F.col("id") == F.col("dst"), "left").select("id", ((1 - damping) + damping * F.coalesce("s", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        now = replaced(now, nxt, "ranks")
        moved = now.df.agg(F.sum(F.abs(F.col("rank") - F.col("old"))).alias("d")).first()["d"] or 0.0
        if moved <= tolerance:
            break
    return now.df.select("id", "rank")


def rank_sums(ranks: DataFrame) -> DataFrame:
    """One row: the sum and mean of ranks."""
    return ranks.agg(F.sum("rank").alias("rank_sum"), F.avg("rank").alias("rank_mean"))
