"""Exact tours by branch and bound, the open states being a stored table.

A state is the start of a tour. Its bound is what it costs and what the rows and columns of the rest of the cost table
must add at least. Each round all tasks search their states depth first, the least bound and then the longest start
first, for a bounded number of steps, and hand on what is still open; the cheapest tour found prunes the next round. No
state is left out but those whose bound is no better than a tour, so the result is exact at any size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GraphError, GraphTooLargeError
from ..graph import Graph
from ..plans.durable import Stored, numbered, replaced

#: Vertices whose table of costs, 8 bytes a pair, may be sent to every task.
MAX_TABLE = 4000
FIRST_STEPS, MOST_STEPS = 64, 20_000


def _bound(cost: np.ndarray, path: list[int], spent: float) -> float:
    """What any tour that begins so costs at least; infinite where it cannot be closed."""
    n = len(cost)
    open_ = np.ones(n, bool)
    open_[path] = False
    left = np.flatnonzero(open_)
    rest = cost[np.ix_([path[-1], *left], [*left, path[0]])]
    if len(left):
        rest = rest.copy()
        rest[0, -1] = np.inf  # not home yet
        rest[np.arange(1, len(left) + 1), np.arange(len(left))] = np.inf
    low = rest.min(axis=1)
    if not np.isfinite(low).all():
        return math.inf
    more = (rest - low[:, None]).min(axis=0)
    return spent + float(low.sum()) + float(more.sum()) if np.isfinite(more).all() else math.inf


def _search(table, best: float, steps: int):
    """Rows (path, spent, bound, done): tours that are better than any before, and what is open after so many steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cost, least, found = table.value, best, None
        stack: list[tuple[float, list[int], float]] = []
        for batch in batches:
            stack += zip(batch.column(2).to_pylist(), batch.column(0).to_pylist(), batch.column(1).to_pylist())
        stack.sort(key=lambda s: (-s[0], len(s[1])))
        n, taken = len(cost), 0
        while stack and taken < steps:
            bound, path, spent = stack.pop()
            taken += 1
            if bound >= least:
                continue
            at = path[-1]
            if len(path) == n:
                total = spent + float(cost[at, path[0]])
                if total < least:
                    least, found = total, path
                continue
            row = cost[at].copy()
            row[path] = np.inf
            next_ = [(_bound(cost, [*path, v], spent + float(row[v])), [*path, v], spent + float(row[v])) for v in np.flatnonzero(np.isfinite(row)).tolist()]
            stack += sorted((s for s in next_ if s[0] < least), key=lambda s: -s[0])
        rows = [(path, spent, bound, False) for bound, path, spent in stack if bound < least]
        if found is not None:
            rows.append((found, least, least, True))
        kinds = pa.list_(pa.int32()), pa.float64(), pa.float64(), pa.bool_()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "spent", "bound", "done"])

    return run


def cheapest_tour(g: Graph) -> DataFrame:
    """(cost, path): one row, a cheapest closed way along the edges (``weight``) through every vertex once, path its edge ids.

    Of parallel edges the cheapest counts, of those the first; undirected edges go both ways; weights may be negative but
    not infinite. Cost is infinite and path null where there is no tour, as in a graph without vertices; a lone vertex
    needs a loop. Of tours that cost the same any may be returned.
    """
    spark = g.vertices.sparkSession
    no = Stored(numbered(g.vertices.select("id", "ord"), ["ord", "id"], "no"), "numbers").df
    n = no.count()
    if n > MAX_TABLE:
        raise GraphTooLargeError(f"the graph has {n} vertices; the table of costs is bounded by {MAX_TABLE}")
    arcs = g.out_edges().select("edge_id", "ord", "src", "dst", "weight")
    if not arcs.where(F.col("weight").isNull() | F.isnan("weight") | (F.abs("weight") == F.lit(float("inf")))).isEmpty():
        raise GraphError("weights of tours must be finite")
    a, b = (no.select(F.col("id").alias(f"{x}_i"), F.col("no").alias(x)) for x in "ab")
    best = F.row_number().over(W.partitionBy("a", "b").orderBy("weight", "ord", "edge_id"))
    arcs = Stored(arcs.join(a, F.col("src") == F.col("a_i")).join(b, F.col("dst") == F.col("b_i")).withColumn("_n", best).where("_n = 1").select("a", "b", "edge_id", "weight"), "arcs").df
    kind = g.edges.schema["edge_id"].dataType.simpleString()
    nothing = spark.range(1).select(F.lit(math.inf).alias("cost"), F.lit(None).cast(f"array<{kind}>").alias("path"))
    if n == 0:
        return nothing
    if n == 1:
        loop = arcs.select(F.col("weight").alias("cost"), F.array("edge_id").alias("path"))
        return nothing if loop.isEmpty() else loop
    cost = np.full((n, n), np.inf)
    for r in arcs.where("a <> b").select("a", "b", "weight").toLocalIterator():  # at most MAX_TABLE squared, a row at a time
        cost[r["a"], r["b"]] = r["weight"]
    table = spark.sparkContext.broadcast(cost)
    frontier = Stored(spark.createDataFrame([([0], 0.0, _bound(cost, [0], 0.0), False)], "path array<int>, spent double, bound double, done boolean"), "frontier")
    least, tour, steps = math.inf, None, FIRST_STEPS
    while True:
        live = frontier.df.where(~F.col("done") & (F.col("bound") < F.lit(least)))
        if live.isEmpty():
            break
        # dealt anew, near bounds apart, so that every task has some of the best
        dealt = live.repartition(spark.sparkContext.defaultParallelism, F.xxhash64("path"))
        frontier = replaced(frontier, dealt.select("path", "spent", "bound").mapInArrow(_search(table, least, steps), frontier.df.schema), "frontier")
        for r in frontier.df.where("done").orderBy("spent", "path").limit(1).collect():
            if r["spent"] < least:
                least, tour = r["spent"], r["path"]
        steps = min(4 * steps, MOST_STEPS)
    table.destroy()
    frontier.drop()
    if tour is None:
        return nothing
    legs = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(zip(tour, [*tour[1:], tour[0]]))], "i int, u long, v long")
    met = legs.join(arcs, (F.col("u") == F.col("a")) & (F.col("v") == F.col("b")))
    return met.agg(F.lit(least).alias("cost"), F.transform(F.array_sort(F.collect_list(F.struct("i", "edge_id"))), lambda s: s["edge_id"]).alias("path"))


def permutations(g: Graph) -> DataFrame:
    """(rank, path): all orders of the vertices, ranks from 0 in the order of insertion order; tasks share the ranks.

    A rank's digits in the factorial system say which of the vertices left comes next. More than 20 vertices have more
    orders than a long has numbers: GraphTooLargeError.
    """
    ids = [r["id"] for r in g.vertices.orderBy("ord", "id").select("id").limit(21).collect()]
    if len(ids) > 20:
        raise GraphTooLargeError("orders of more than 20 vertices cannot be numbered")
    spark, kind = g.vertices.sparkSession, g.vertices.schema["id"].dataType.simpleString()
    rows = spark.range(math.factorial(len(ids))).select(F.col("id").alias("rank"), F.array(*(F.lit(i) for i in ids)).cast(f"array<{kind}>").alias("left"), F.array().cast(f"array<{kind}>").alias("path"))
    for k in range(len(ids), 0, -1):
        f = math.factorial(k - 1)
        at = (F.floor(F.col("rank") / F.lit(f)) % F.lit(k) if f < 2**50 else F.expr(f"(rank div {f}L) % {k}")).cast("int")
        one = F.element_at("left", at + 1)
        rest = F.concat(F.slice("left", F.lit(1), at), F.slice("left", at + 2, F.lit(k)))
        rows = rows.select("rank", rest.alias("left"), F.concat("path", F.array(one)).alias("path"))
    return rows.select("rank", "path")


def hamiltonian_orders(g: Graph) -> DataFrame:
    """(rank, path): the orders of vertices along which neighbours follow each other, the last one leading back to the first."""
    pairs = g.simple_undirected()
    ways = pairs.select(F.struct("a", "b").alias("w")).union(pairs.select(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))))
    every = ways.agg(F.collect_set("w").alias("ways"))  # at most 380 pairs of 20 vertices
    at = permutations(g)
    legs = F.transform(F.sequence(F.lit(1), F.size("path")), lambda i: F.struct(F.element_at("path", i).alias("a"), F.element_at("path", F.when(i < F.size("path"), i + 1).otherwise(F.lit(1))).alias("b")))
    met = at.where(F.size("path") > 0).crossJoin(F.broadcast(every))
    ok = F.when(F.size("path") == 1, F.lit(True)).otherwise(F.forall(legs, lambda w: F.array_contains("ways", w)))
    return met.where(ok).select("rank", "path")
