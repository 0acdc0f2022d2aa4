"""Traces of searches over graphs beyond one task, level by level.

Depth first, where the search meets a forest: preorder is then the order of the ways from the root, each the list of
the edges' places, and times come from the sizes of what hangs below. Breadth first, over any graph: a level is numbered by who
found each vertex first. Each function gives None for what is not so, or is deeper than ``ROUNDS``; a kernel has those.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.durable import Stored, cut, numbered

#: Edges up to which a kernel has the whole graph in one task.
LOCAL_EDGES = 200_000
#: Levels up to which a search goes level by level.
ROUNDS = 32


def _union(frames: list[DataFrame]) -> DataFrame:
    every = frames[0]
    for more in frames[1:]:
        every = every.union(more)
    return every


def _ways(g: Graph, both_ways: bool) -> DataFrame:
    """(u, v, side, o, edge_id): the steps a search may take, in the order (side, o, edge_id) at each u."""
    step = lambda u, v, side: [F.col(u).alias("u"), F.col(v).alias("v"), F.lit(side).alias("side"), F.col("ord").alias("o"), "edge_id"]
    ways = g.edges.select(*step("src", "dst", 0))
    if both_ways or not g.directed:
        ways = ways.union(g.edges.where("src <> dst").select(*step("dst", "src", 1 if both_ways else 0)))
    return cut(ways, "ways")


def _levels(ways: DataFrame, starts: DataFrame, ranks: DataFrame | None, either_way: bool, max_depth: int | None) -> list[Stored] | None:
    """Tables (id, root, r_ord, depth, way, parent, pred_edge_id, above_edge_id) of the levels below starts (id, ord).

    With ``ranks`` (id, ord) a vertex that comes before all vertices above it starts a tree of its own, as a search
    that starts at every vertex in order has been there before. ``either_way`` says that a step may lead back.
    """
    key = F.struct("side", "o", "edge_id")
    kinds, edge = ways.select(key.alias("k")).schema["k"].dataType, ways.schema["edge_id"].dataType
    none = F.lit(None)
    own = [F.col("id").alias("root"), F.col("ord").alias("r_ord"), F.lit(0).alias("depth"), F.array().cast(f"array<{kinds.simpleString()}>").alias("way"), none.cast(starts.schema["id"].dataType).alias("parent"), none.cast(edge).alias("pred_edge_id"), none.cast(edge).alias("above_edge_id")]
    levels = [Stored(starts.select("id", *own), "level")]
    while max_depth is None or len(levels) <= max_depth:
        last = levels[-1].df
        met = last.join(ways, F.col("id") == F.col("u"))
        if either_way:
            met = met.where(~F.col("edge_id").eqNullSafe(F.col("pred_edge_id")))
        met = met.select(F.col("v").alias("id"), "root", "r_ord", (F.col("depth") + 1).alias("depth"), F.concat("way", F.array(key)).alias("way"), F.col("id").alias("parent"), F.col("edge_id").alias("pred_edge_id"), F.col("pred_edge_id").alias("above_edge_id"))
        if ranks is not None:
            names = met.columns
            met = met.join(ranks.select(F.col("id").alias("_i"), F.col("ord").alias("_o")), F.col("id") == F.col("_i"))
            alone = F.struct(F.col("_o").alias("o"), F.col("id").alias("i")) < F.struct(F.col("r_ord").alias("o"), F.col("root").alias("i"))
            fresh = dict(zip(names[1:], [F.col("id"), F.col("_o"), *own[2:]]))
            met = met.select("id", *(F.when(alone, fresh[c]).otherwise(F.col(c)).alias(c) for c in names[1:]))
        new = Stored(met, "level")
        if new.df.isEmpty():
            new.drop()
            return levels
        levels.append(new)
        circle = either_way and not (new.df.groupBy("id").count().where("count > 1").isEmpty() and new.df.join(last.select("id"), "id", "left_semi").isEmpty())
        if circle or len(levels) > ROUNDS:
            _drop(levels)
            return None
    return levels


def _drop(tables: list[Stored]) -> None:
    for table in tables:
        table.drop()


def _found(levels: list[Stored]) -> int:
    return sum(level.df.count() for level in levels)


def depth_first(g: Graph, root=None, *, max_depth: int | None = None, both_ways: bool = False) -> DataFrame | None:
    """The rows of a depth-first trace with ``size`` (vertices below, itself included) and ``above_edge_id``, the parent's edge.

    From root, or without one from every vertex in order. None where what is searched is no forest.
    """
    either_way = both_ways or not g.directed
    v = g.vertices.select("id", "ord")
    if root is not None:
        g.require(root)
    elif max_depth is not None:
        return None
    ways = _ways(g, both_ways)
    if not either_way:
        into = cut(ways.groupBy(F.col("v").alias("id")).agg(F.count("*").alias("n")), "in-degrees")
        if not into.where("n > 1").isEmpty() or (root is not None and not into.where(F.col("id") == F.lit(root)).isEmpty()):
            return None
    if root is not None:
        levels = _levels(ways, v.where(F.col("id") == F.lit(root)), None, either_way, max_depth)
    elif not either_way:
        levels = _levels(ways, v.join(into, "id", "left_anti"), v, False, None)
        if levels is not None and _found(levels) < v.count():  # some are on or behind cycles
            _drop(levels)
            return None
    else:
        levels = _levels(ways, v.orderBy("ord", "id").limit(1), None, True, None)
        if levels is not None and _found(levels) < v.count():
            from .components import labels_of

            _drop(levels)
            labels = labels_of(v, ways.select(F.col("u").alias("a"), F.col("v").alias("b")))
            first = labels.withColumnRenamed("id", "_i").join(v, F.col("_i") == F.col("id")).groupBy("label").agg(F.min(F.struct("ord", "id")).alias("x"))
            levels = _levels(ways, first.select("x.id", "x.ord"), None, True, None)
    if levels is None:
        return None
    sized, below = [], None
    for level in reversed(levels):
        own = level.df
        if below is not None:
            sums = below.where("parent is not null").groupBy(F.col("parent").alias("_p")).agg(F.sum("size").alias("_s"))
            own = own.join(sums, F.col("id") == F.col("_p"), "left").withColumn("size", F.lit(1).cast("long") + F.coalesce("_s", F.lit(0))).drop("_p", "_s")
        else:
            own = own.withColumn("size", F.lit(1).cast("long"))
        sized.append(Stored(own, "sizes"))
        below = sized[-1].df
    _drop(levels)
    at = numbered(_union([table.df for table in sized]), ["r_ord", "root", "way"], "order_no")
    _drop(sized)
    seen = 2 * F.col("order_no") - F.col("depth")
    return at.select("id", "root", "depth", "order_no", "parent", "pred_edge_id", seen.alias("discover_time"), (seen + 2 * F.col("size") - 1).alias("finish_time"), "size", "above_edge_id")


def finished_before(trace: DataFrame) -> DataFrame:
    """(id, rank): how many vertices are finished before each, of what ``depth_first`` gave."""
    return trace.select("id", (F.col("order_no") - F.col("depth") + F.col("size") - 1).alias("rank"))


def breadth_first_edges(g: Graph, root=None) -> DataFrame | None:
    """(edge_id, class, seq) of a breadth-first search: tree, gray or black by what the edge meets. None where it is too deep."""
    if root is not None:
        g.require(root)
    ways = _ways(g, False)
    start = g.vertices.where(F.col("id") == F.lit(root)) if root is not None else g.vertices.join(g.edges.select(F.col("dst").alias("id")), "id", "left_anti")
    none = F.lit(None).cast(ways.schema["edge_id"].dataType)
    levels = [Stored(numbered(start.select("id", "ord"), ["ord", "id"], "no").select("id", "no", none.alias("by")), "level")]
    total = levels[0].df.count()
    while True:
        last, known = levels[-1].df, _union([level.df.select("id") for level in levels])
        met = last.join(ways, F.col("id") == F.col("u")).groupBy(F.col("v").alias("id")).agg(F.min(F.struct("no", "o", "edge_id")).alias("k")).join(known, "id", "left_anti")
        new = Stored(numbered(met, ["k"], "_n").select("id", (F.col("_n") + total).alias("no"), F.col("k.edge_id").alias("by")), "level")
        n = new.df.count()
        levels.append(new)
        if not n:
            break
        total += n
        if len(levels) > ROUNDS:
            _drop(levels)
            return None
    every = _union([level.df for level in levels])
    a, b = every.select(F.col("id").alias("a_i"), F.col("no").alias("a_no")), every.select(F.col("id").alias("b_i"), F.col("no").alias("b_no"), "by")
    met = ways.join(a, F.col("u") == F.col("a_i")).join(b, F.col("v") == F.col("b_i"))
    class_ = F.when(F.col("edge_id").eqNullSafe(F.col("by")) & (F.col("a_no") < F.col("b_no")), "tree").when(F.col("b_no") < F.col("a_no"), "black").otherwise("gray")
    out = numbered(met.select("edge_id", class_.alias("class"), "a_no", "o"), ["a_no", "o", "edge_id"], "seq").select("edge_id", "class", "seq")
    _drop(levels)
    return out
