"""Orders, acyclicity, closure, reduction, common ancestors."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NonAcyclicGraphError
from ..graph import Graph
from ..kernels import run as kernel
from ..kernels import search, structure
from ..plans.durable import Stored, cut, replaced
from ..plans.iterate import fits_one_task
from . import traces


def peel(g: Graph, *, local_edges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, layer) by taking away vertices without in-edges round by round, and the vertices left on or behind cycles.

    Rounds are as many as layers, so graphs within the bound of one task go to a kernel.
    """
    if fits_one_task(g.edges, local_edges):
        found = cut(kernel.run(g, structure.peel, "id {id}, layer int"), "layers")
        return found, g.vertices.select("id").join(found.select("id"), "id", "left_anti")
    arcs = cut(g.edges.select("src", "dst"), "arcs")
    into = cut(arcs.groupBy(F.col("dst").alias("v")).agg(F.count("*").alias("n")), "degrees")
    front = Stored(g.vertices.select("id").join(into, F.col("id") == F.col("v"), "left_anti").select("id", F.lit(0).alias("layer")), "layers")
    layers, taken = [front], []
    k = 0
    while not front.df.isEmpty():
        # only what the round takes away is written; a vertex is free when as many in-edges went as it had
        k += 1
        gone = Stored(front.df.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.count("*").alias("c")), "taken")
        taken = _folded([*taken, gone], lambda every: every.groupBy("dst").agg(F.sum("c").alias("c")))
        met = _union(taken).join(gone.df.select(F.col("dst").alias("t")), F.col("dst") == F.col("t"), "left_semi").groupBy("dst").agg(F.sum("c").alias("c"))
        front = Stored(met.join(into, (F.col("dst") == F.col("v")) & (F.col("c") == F.col("n"))).select(F.col("dst").alias("id"), F.lit(k).alias("layer")), "layers")
        layers = _folded([*layers, front], lambda every: every)
    for table in taken:
        table.drop()
    found = _union(layers)
    return found, g.vertices.select("id").join(found.select("id"), "id", "left_anti")


#: Rounds whose tables are kept apart.
FOLD = 8


def _union(tables: list[Stored]) -> DataFrame:
    every = tables[0].df
    for more in tables[1:]:
        every = every.union(more.df)
    return every


def _folded(tables: list[Stored], merge: Callable[[DataFrame], DataFrame]) -> list[Stored]:
    """The tables, or, if they are too many, all but the last as one; the last is still read apart."""
    if len(tables) <= FOLD:
        return tables
    whole = Stored(merge(_union(tables[:-1])), "folded")
    for old in tables[:-1]:
        old.drop()
    return [whole, tables[-1]]


def is_dag(g: Graph, *, local_edges: int | None = None) -> bool:
    return peel(g, local_edges=local_edges)[1].isEmpty()


def is_forest(g: Graph) -> bool:
    """As undirected: a loop or parallel edge is a cycle."""
    from .components import connected_components

    n = connected_components(g).select("component").distinct().count()
    return g.edges.count() == g.vertices.count() - n


def layers(g: Graph, *, backward: bool = False, local_edges: int | None = None) -> DataFrame:
    """(id, layer): the longest way from a root; sorting by layer and then order is a topological order."""
    found, left = peel(g.reversed() if backward else g, local_edges=local_edges)
    if not left.isEmpty():
        raise NonAcyclicGraphError("the graph has a cycle")
    return found


def topological_order(g: Graph, *, allow_cycles: bool = False, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(id, position) by depth-first search in order of insertion; a kernel, but for forests of few levels beyond ``local_edges``."""
    if not fits_one_task(g.edges, local_edges):
        found = traces.depth_first(g)
        if found is not None:
            return traces.finished_before(found).select("id", (F.lit(g.vertices.count() - 1) - F.col("rank")).alias("position"))
    return kernel.run(g, lambda x: structure.topological(x, allow_cycles=allow_cycles), "id {id}, position long")


def least_degree_order(g: Graph, *, allow_cycles: bool = False, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(id, position) of an undirected graph, least degree first; a kernel, but for forests of more vertices or edges than ``local_edges``."""
    if not (fits_one_task(g.edges, local_edges) and fits_one_task(g.vertices, local_edges)):
        from .leaves import leaf_order

        found = leaf_order(g)
        if found is not None:
            return found
        if not allow_cycles:
            raise NonAcyclicGraphError("the graph has a cycle")
    return kernel.run(g, lambda x: structure.least_degree_order(x, allow_cycles=allow_cycles), "id {id}, position long")


def _reach(g: Graph) -> DataFrame:
    """(src, dst) of all walks of one edge or more, by doubling their length."""
    now = Stored(g.edges.select("src", "dst").distinct(), "reach")
    size = now.df.count()
    while True:
        after = now.df.select(F.col("src").alias("m"), F.col("dst").alias("e"))
        now = replaced(now, now.df.join(after, F.col("dst") == F.col("m")).select("src", F.col("e").alias("dst")).union(now.df).distinct(), "reach")
        more = now.df.count()
        if more == size:
            return now.df
        size = more


def transitive_closure(g: Graph) -> DataFrame:
    """(src, dst): the pairs a directed acyclic graph's walks join."""
    if not is_dag(g):
        raise NonAcyclicGraphError("the closure is for acyclic graphs")
    return _reach(g)


def closure_graph(g: Graph, *, edge_id: Column | None = None) -> Graph:
    """The acyclic graph with all its own edges, parallel ones and attributes included, and one more for each pair that only longer walks join.

    New edges have no attributes; their ``edge_id`` and ``ord`` are made of ``src`` and ``dst`` (a hash of them by default)
    and cast to the types of the others.
    """
    pair = g.edges.select(F.col("src").alias("_s"), F.col("dst").alias("_d")).distinct()
    new = transitive_closure(g).join(pair, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")
    made = F.xxhash64("src", "dst") if edge_id is None else edge_id
    kinds = g.edges.schema
    more = new.select(made.cast(kinds["edge_id"].dataType).alias("edge_id"), made.cast(kinds["ord"].dataType).alias("ord"), "src", "dst")
    return g.with_edges(g.edges.unionByName(more, allowMissingColumns=True))


def transitive_reduction(g: Graph) -> DataFrame:
    """The edges whose pair no longer walk joins; parallel copies of a needed edge stay."""
    far = transitive_closure(g)
    step = g.edges.select(F.col("src").alias("s"), F.col("dst").alias("m")).distinct()
    around = step.join(far, F.col("m") == F.col("src")).select(F.col("s").alias("_s"), F.col("dst").alias("_d")).distinct()
    return g.edges.join(around, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left_anti")


def common_ancestors(g: Graph, root, pairs: DataFrame) -> DataFrame:
    """(source, target, ancestor): the deepest common ancestor in the tree below root; null where an end is not in it.

    Where a vertex has several parents, the tree is the depth-first one, which a kernel finds; the pairs meet it by joins.
    """
    g.require(root)
    tree = g.edges.groupBy("dst").count().where("count > 1").isEmpty() and g.edges.where(F.col("dst") == F.lit(root)).isEmpty()
    if tree:
        from .paths import bfs

        found, below = bfs(g, root), g
    else:
        found = kernel.run(g, lambda x: search.rows(x, search.dfs(x, root)[0]), search.ROWS)
        below = g.with_edges(found.where("parent is not null").select(F.col("pred_edge_id").alias("edge_id"), F.col("order_no").alias("ord"), F.col("parent").alias("src"), F.col("id").alias("dst")))
    up = below.edges.join(found.select(F.col("id").alias("_r")), F.col("src") == F.col("_r"), "left_semi").groupBy(F.col("dst").alias("v")).agg(F.first("src").alias("up"))
    return _lifted(up, Stored(found.select("id", "depth"), "depth").df, pairs)


def _lifted(parent: DataFrame, depth: DataFrame, pairs: DataFrame) -> DataFrame:
    """Deepest common ancestors by tables of the ancestors 1, 2, 4, ... steps up: a join a table for each pair, up and down.

    No table holds more than one ancestor a vertex.
    """
    most = depth.agg(F.max("depth")).first()[0] or 0
    tables = [Stored(parent.select("v", "up"), "up")]
    while 2 ** len(tables) <= most:
        last = tables[-1].df
        tables.append(Stored(last.join(last.select(F.col("v").alias("m"), F.col("up").alias("top")), F.col("up") == F.col("m")).select("v", F.col("top").alias("up")), "up"))
    a, b = (depth.select(F.col("id").alias(f"{x}_i"), F.col("depth").alias(f"{x}_d")) for x in "ab")
    known = pairs.select("source", "target").distinct().join(a, F.col("source") == F.col("a_i")).join(b, F.col("target") == F.col("b_i"))
    deep = F.col("a_d") >= F.col("b_d")
    now = known.select("source", "target", F.when(deep, F.col("source")).otherwise(F.col("target")).alias("x"), F.when(deep, F.col("target")).otherwise(F.col("source")).alias("y"), F.abs(F.col("a_d") - F.col("b_d")).alias("gap"))
    now = Stored(now, "pairs")
    jump = lambda k, of: tables[k].df.select(F.col("v").alias(f"v_{of}"), F.col("up").alias(f"up_{of}"))
    for k in reversed(range(len(tables))):  # the deeper end comes up to the other's depth
        goes = F.col("gap").bitwiseAND(1 << k) > 0
        met = now.df.join(jump(k, "x"), (F.col("x") == F.col("v_x")) & goes, "left")
        now = replaced(now, met.select("source", "target", F.coalesce("up_x", "x").alias("x"), "y", "gap"), "pairs")
    for k in reversed(range(len(tables))):  # both come up as long as they stay apart
        met = now.df.join(jump(k, "x"), F.col("x") == F.col("v_x"), "left").join(jump(k, "y"), F.col("y") == F.col("v_y"), "left")
        apart = F.col("up_x").isNotNull() & F.col("up_y").isNotNull() & (F.col("up_x") != F.col("up_y")) & (F.col("x") != F.col("y"))
        now = replaced(now, met.select("source", "target", F.when(apart, F.col("up_x")).otherwise(F.col("x")).alias("x"), F.when(apart, F.col("up_y")).otherwise(F.col("y")).alias("y"), "gap"), "pairs")
    met = now.df.join(jump(0, "x"), (F.col("x") == F.col("v_x")) & (F.col("x") != F.col("y")), "left")
    found = Stored(pairs.join(met.select("source", "target", F.coalesce("up_x", "x").alias("ancestor")), ["source", "target"], "left").select("source", "target", "ancestor"), "ancestors").df
    for table in (now, *tables):
        table.drop()
    return found
