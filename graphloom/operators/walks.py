"""Many random walks at once, random graphs and implicit exploration, as supersteps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph
from ..plans.durable import cut, numbered
from . import exact


def _uniform(seed: int, *columns) -> Column:
    """A number in [0, 1) that hangs on the columns and seed alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(1 << 53)) / float(1 << 53)


def walks(g: Graph, starts: DataFrame, *, steps: int, seed: int = 0, weight=None) -> DataFrame:
    """(walk, step, edge_id, src, dst) of walks from starts (walk, id); ``weight`` makes choices proportional to it."""
    order = W.partitionBy("src").orderBy("ord", "edge_id")
    whole = W.partitionBy("src")
    e = g.edges.withColumn("w", (F.lit(1.0) if weight is None else weight).cast("double"))
    arcs = e.withColumn("high", F.sum("w").over(order.rowsBetween(W.unboundedPreceding, 0)) / F.sum("w").over(whole))
    arcs = arcs.withColumn("low", F.coalesce(F.lag("high").over(order), F.lit(0.0))).withColumn("last", F.row_number().over(order) == F.count("*").over(whole))
    arcs = cut(arcs.select("edge_id", "src", "dst", "low", F.when(F.col("last"), 1.0).otherwise(F.col("high")).alias("high")), "arcs")
    now = starts.select("walk", F.col("id").alias("at"))
    out: DataFrame | None = None
    for k in range(steps):
        drawn = now.withColumn("u", _uniform(seed, "walk", F.lit(k)))
        taken = drawn.join(arcs, (F.col("at") == F.col("src")) & (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
        taken = cut(taken.select("walk", F.lit(k).alias("step"), "edge_id", "src", "dst"), "walks")
        if taken.isEmpty():
            break
        out = taken if out is None else out.union(taken)
        now = taken.select("walk", F.col("dst").alias("at"))
    return out if out is not None else arcs.limit(0).select(F.lit(0).alias("walk"), F.lit(0).alias("step"), "edge_id", "src", "dst")


def random_graph(spark: SparkSession, n: int, m: int, *, seed: int = 0, self_edges: bool = True, parallel: bool = True, directed: bool = True) -> Graph:
    """n vertices and m edges drawn by hash of the seed; without parallels each pair is at most once."""
    v = spark.range(n).select("id", F.col("id").alias("ord"))
    if n == 0 and m > 0 or n == 1 and m > 0 and not self_edges:
        raise GraphError("no edge is possible")
    pick = lambda salt: F.floor(_uniform(seed, "edge_id", F.lit(salt)) * n).cast("long")
    if parallel:
        e = spark.range(m).select(F.col("id").alias("edge_id"), F.col("id").alias("ord"))
        e = e.withColumn("src", pick(0))
        far = F.floor(_uniform(seed, "edge_id", F.lit(1)) * (n if self_edges else n - 1)).cast("long")
        e = e.withColumn("dst", far if self_edges else (F.col("src") + 1 + far) % n)
        return Graph.of(v, e, directed=directed)
    possible = n * n if directed else n * (n + 1) // 2
    possible -= 0 if self_edges else n
    if m > possible:
        raise GraphError(f"{m} edges without parallels are not possible; {possible} are")
    if 4 * m < possible:  # draw half as many again until enough differ, then cut by hash: no task sees all pairs
        draw = 2 * m + 16
        e = random_graph(spark, n, draw, seed=seed, self_edges=self_edges, directed=directed).edges
        a, b = (F.col("src"), F.col("dst")) if directed else (F.least("src", "dst"), F.greatest("src", "dst"))
        pairs = e.select(a.alias("src"), b.alias("dst")).distinct()
    else:
        pairs = v.select(F.col("id").alias("src")).crossJoin(v.select(F.col("id").alias("dst")))  # a fourth of all pairs is asked for
        pairs = pairs if directed else pairs.where("src <= dst")
        pairs = pairs if self_edges else pairs.where("src <> dst")
    ranked = numbered(pairs.withColumn("_h", F.xxhash64(F.lit(seed), "src", "dst")), ["_h", "src", "dst"], "_r").where(F.col("_r") < m)
    return Graph.of(v, ranked.select(F.xxhash64("src", "dst").alias("edge_id"), F.xxhash64("src", "dst").alias("ord"), "src", "dst"), directed=directed, allow_parallel=False)


def explore(start: DataFrame, expand: Callable[[DataFrame], DataFrame], *, vertex: Column | None = None, edge: Column | None = None, explore_if: Column | None = None, max_vertices: int = 1000, max_edges: int = 1000) -> tuple[DataFrame, DataFrame, bool]:
    """Breadth-first exploration of a graph that ``expand`` makes: from a frontier (id) to transitions (src, dst, ...).

    Predicates say which vertices and edges enter and which vertices are expanded. It stops at the end of the round in
    which a bound is reached. Returns vertices (id, depth), edges (src, dst, kind, depth) with kind tree or back, and
    whether nothing was left to explore.
    """
    seen = cut(start.select("id", F.lit(0).alias("depth")), "seen")
    front, edges, k = seen, None, 0
    while True:
        ready = front if explore_if is None else front.where(explore_if)
        if ready.isEmpty():
            return seen, edges if edges is not None else start.limit(0).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("").alias("kind"), F.lit(0).alias("depth")), True
        if seen.count() >= max_vertices or edges is not None and edges.count() >= max_edges:
            return seen, edges, False
        moves = expand(ready.select("id"))
        if edge is not None:
            moves = moves.where(edge)
        if vertex is not None:
            allowed = moves.select(F.col("dst").alias("id")).distinct().where(vertex)
            moves = moves.join(allowed, F.col("dst") == F.col("id"), "left_semi")
        known = seen.select(F.col("id").alias("_i"), F.lit(True).alias("_k"))
        moves = moves.join(known, F.col("dst") == F.col("_i"), "left")
        first = F.row_number().over(W.partitionBy("dst").orderBy("src"))
        moves = cut(moves.select("src", "dst", F.when(F.col("_k").isNull() & (first == 1), "tree").otherwise("back").alias("kind"), F.lit(k).alias("depth")), "moves")
        edges = moves if edges is None else edges.union(moves)
        front = cut(moves.where("kind = 'tree'").select(F.col("dst").alias("id"), F.lit(k + 1).alias("depth")), "front")
        seen = cut(seen.union(front), "seen")
        k += 1


def implicit_dfs(start: DataFrame, expand: Callable[[DataFrame], DataFrame], root, *, max_depth: int | None = None, order: str = "dst", **options) -> DataFrame:
    """The depth-first trace from root of a graph that ``expand`` makes, as exact.dfs_trace has it.

    What is within reach of start (id), which holds the root, is explored in rounds, breadth first, and then traced; a
    vertex's transitions go by the column ``order``. Raises where the bounds of explore leave something out.
    """
    return exact.dfs_trace(_explored(start, expand, order, **options), root, max_depth=max_depth)


def implicit_edge_dfs(start: DataFrame, expand: Callable[[DataFrame], DataFrame], root, *, max_depth: int | None = None, order: str = "dst", **options) -> DataFrame:
    """As implicit_dfs over edges as states: exact.edge_dfs of what ``expand`` makes, with the ends of each edge."""
    g = _explored(start, expand, order, **options)
    return exact.edge_dfs(g, root, max_depth=max_depth).join(g.edges.select("edge_id", "src", "dst"), "edge_id")


def _explored(start: DataFrame, expand: Callable[[DataFrame], DataFrame], order: str, **options) -> Graph:
    v, e, whole = explore(start, expand, **options)
    if not whole:
        raise GraphError("the exploration was cut off by its bounds")
    e = numbered(e.select("src", "dst"), ["src", order], "edge_id")
    return Graph.of(v.select("id", F.col("id").alias("ord")), e.select("edge_id", F.col("edge_id").alias("ord"), "src", "dst"))
