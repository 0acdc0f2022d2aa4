"""Operators whose answer one task finds for one graph: exact traversals, flow, matching, tours and the like.

All take ``by``, a column on both frames: then each of its values is a graph of its own and all are solved side by side.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, GraphTooLargeError
from ..graph import Graph
from ..kernels import optimise, search, walks
from ..kernels.run import Local, run
from ..plans.iterate import fits_one_task
from . import traces
from .chains import single_walk
from .cliques import peeled_cliques
from .flow import push_relabel
from .tours import cheapest_tour

#: Edges up to which augmenting paths in one task are quicker than supersteps.
FLOW_LOCAL_EDGES = 20_000
#: Edges up to which a single random walk has the whole graph in one task.
WALK_LOCAL_EDGES = 200_000
MAX_TOUR, MAX_HAMILTON, MAX_CLIQUE_VERTICES, MAX_BISECT = 16, 400, 5000, 3000


def _guard(x: Local, most: int, what: str) -> None:
    if x.n > most:
        raise GraphTooLargeError(f"{what} is bounded by {most} vertices; the graph has {x.n}")


def bfs_trace(g: Graph, root=None, *, by: str | None = None) -> DataFrame:
    return run(g, lambda x: search.rows(x, search.bfs(x, root)[0]), search.ROWS, by=by)


def bfs_edge_classes(g: Graph, root=None, *, by: str | None = None, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(edge_id, class, seq); beyond ``local_edges`` level by level, where the levels are few."""
    if by is None and not fits_one_task(g.edges, local_edges) and (found := traces.breadth_first_edges(g, root)) is not None:
        return found
    return run(g, lambda x: search.edge_rows(x, search.bfs(x, root)[1]), search.EDGE_ROWS, by=by)


def dfs_trace(g: Graph, root=None, *, all_components: bool = False, max_depth: int | None = None, both_ways: bool = False, by: str | None = None, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(id, root, depth, order_no, parent, pred_edge_id, discover_time, finish_time).

    Beyond ``local_edges`` a forest of few levels is traced level by level.
    """
    if by is None and not (all_components and root is not None) and not fits_one_task(g.edges, local_edges):
        found = traces.depth_first(g, root, max_depth=max_depth, both_ways=both_ways)
        if found is not None:
            return found.drop("size", "above_edge_id")
    return run(g, lambda x: search.rows(x, search.dfs(x, root, all_components=all_components, max_depth=max_depth, both_ways=both_ways)[0]), search.ROWS, by=by)


def dfs_edge_classes(g: Graph, root=None, *, by: str | None = None, local_edges: int = traces.LOCAL_EDGES, **options) -> DataFrame:
    """(edge_id, class, seq); beyond ``local_edges`` a tree of few levels, all of whose edges are of it, is traced level by level."""
    if by is None and root is not None and set(options) <= {"max_depth"} and not fits_one_task(g.edges, local_edges):
        found = traces.depth_first(g, root, **options)
        if found is not None:
            return found.where("depth > 0").select(F.col("pred_edge_id").alias("edge_id"), F.lit("tree").alias("class"), (F.col("order_no") - 1).alias("seq"))
    return run(g, lambda x: search.edge_rows(x, search.dfs(x, root, **options)[1]), search.EDGE_ROWS, by=by)


def edge_dfs(g: Graph, root=None, *, max_depth: int | None = None, by: str | None = None, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(edge_id, parent_edge_id, depth, order_no); beyond ``local_edges`` a tree of few levels is traced level by level."""
    if by is None and root is not None and not fits_one_task(g.edges, local_edges):
        found = traces.depth_first(replace(g, directed=True), root, max_depth=None if max_depth is None else max_depth + 1)
        if found is not None:
            return found.where("depth > 0").select(F.col("pred_edge_id").alias("edge_id"), F.col("above_edge_id").alias("parent_edge_id"), (F.col("depth") - 1).alias("depth"), (F.col("order_no") - 1).alias("order_no"))
    return run(g, lambda x: search.edge_dfs(x, root, max_depth=max_depth), "edge_id {edge}, parent_edge_id {edge}, depth int, order_no long", by=by)


def tree_leaves(trace: DataFrame) -> DataFrame:
    """(id): the traced vertices that nobody was found from."""
    return trace.join(trace.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti").select("id")


def max_flow(g: Graph, source, sink, *, capacity=None, by: str | None = None, local_edges: int = FLOW_LOCAL_EDGES) -> DataFrame:
    """(edge_id, flow, residual, in_cut): a largest flow, and the edges of the least cut next to the source.

    Graphs beyond ``local_edges`` edges are solved by pushing and relabelling in supersteps. Value and cut are the same
    either way; which of several largest flows is found is not.
    """
    g.require(source, sink)
    c = g.with_edges(g.edges.withColumn("weight", (F.lit(1.0) if capacity is None else capacity).cast("double")))
    if by is None and not fits_one_task(c.edges, local_edges):
        return push_relabel(c, source, sink)
    return run(c, lambda x: optimise.max_flow(x, source, sink), "edge_id {edge}, flow double, residual double, in_cut boolean", by=by)


def flow_value(g: Graph, flows: DataFrame, source) -> DataFrame:
    """One row, the flow out of source less that into it."""
    e = g.edges.join(flows.select("edge_id", "flow"), "edge_id")
    return e.agg(F.coalesce(F.sum(F.when(F.col("src") == F.lit(source), F.col("flow")).otherwise(0.0)) - F.sum(F.when(F.col("dst") == F.lit(source), F.col("flow")).otherwise(0.0)), F.lit(0.0)).alias("value"))


def bipartite_matching(g: Graph, left: Sequence, right: Sequence | None = None, *, by: str | None = None) -> DataFrame:
    """(left, right, edge_id): largest; direction is ignored. The right side is what is not left; one that is given must be disjoint."""
    chosen = set(left)
    if right is not None:
        check_left_right(chosen, set(right))
    return run(g, lambda x: optimise.matching(x, chosen), "left {id}, right {id}, edge_id {edge}", by=by)


def assign(costs: DataFrame, *, by: str = "problem_id") -> DataFrame:
    """(by, agent, task, cost): of each problem's costs (by, agent, task, cost) a cheapest assignment; agents <= tasks."""
    schema = f"{by} {costs.schema[by].dataType.simpleString()}, agent int, task int, cost double"

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="agent", columns="task", values="cost").sort_index().sort_index(axis=1)
        got = optimise.assignment(table.to_numpy(dtype=float).tolist())
        out = [(key[0], int(a), int(table.columns[t]), float(table.iat[i, t])) for i, (a, t) in enumerate(zip(table.index, got))]
        return pd.DataFrame(out, columns=[by, "agent", "task", "cost"])

    return costs.select(by, "agent", "task", "cost").groupBy(by).applyInPandas(solve, schema)


def assign_steps(costs: DataFrame, *, by: str = "problem_id") -> DataFrame:
    """(by, no, step, starred, primed, covered_agents, covered_tasks): how the covering method comes to each assignment, a row a step.

    step is the number of what was done (``optimise.ASSIGNMENT_STEPS``); starred at the last one, ``end``, is a cheapest
    assignment of (agent, task).
    """
    pair = "array<struct<agent: int, task: int>>"
    schema = f"{by} {costs.schema[by].dataType.simpleString()}, no int, step int, starred {pair}, primed {pair}, covered_agents array<int>, covered_tasks array<int>"

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        table = rows.pivot(index="agent", columns="task", values="cost").sort_index().sort_index(axis=1)
        agents, tasks = table.index.tolist(), table.columns.tolist()
        named = lambda at: [{"agent": int(agents[i]), "task": int(tasks[j])} for i, j in at]
        out = [
            (key[0], no, step, named(star), named(prime), [int(agents[i]) for i in down], [int(tasks[j]) for j in across])
            for no, (step, star, prime, down, across, _) in enumerate(optimise.assignment_steps(table.to_numpy(dtype=float).tolist()))
        ]
        return pd.DataFrame(out, columns=[by, "no", "step", "starred", "primed", "covered_agents", "covered_tasks"])

    return costs.select(by, "agent", "task", "cost").groupBy(by).applyInPandas(solve, schema)


def bisect(g: Graph, *, rounds: int = 10, by: str | None = None) -> DataFrame:
    """(id, side, cut): side 0 or 1, cut the weight between them (``weight`` or 1 an edge)."""

    def solve(x: Local):
        _guard(x, MAX_BISECT, "bisection")
        a, b, cut_ = optimise.bisect(x, rounds)
        yield from ((x.ids[v], int(v in b), cut_) for v in sorted(a | b))

    return run(g, solve, "id {id}, side int, cut double", by=by)


def cut_cost(g: Graph, sides: DataFrame) -> DataFrame:
    """One row, the weight of edges between sides (id, side)."""
    a, b = sides.select(F.col("id").alias("_i"), F.col("side").alias("_a")), sides.select(F.col("id").alias("_j"), F.col("side").alias("_b"))
    w = F.col("weight") if "weight" in g.edges.columns else F.lit(1.0)
    return g.edges.join(a, F.col("src") == F.col("_i")).join(b, F.col("dst") == F.col("_j")).where("_a <> _b").agg(F.coalesce(F.sum(w), F.lit(0.0)).alias("cut"))


def best_tour(g: Graph, *, weight=None, by: str | None = None, local_vertices: int = MAX_TOUR) -> DataFrame:
    """(cost, path): one row; cost is infinite and path null where no tour is.

    A graph of more than ``local_vertices`` vertices is searched by branch and bound over a stored frontier.
    """
    w = g.with_edges(g.edges.withColumn("weight", (F.lit(1.0) if weight is None else weight).cast("double")))
    if by is None and g.vertices.limit(local_vertices + 1).count() > local_vertices or local_vertices == 0:
        return cheapest_tour(w)

    def solve(x: Local):
        _guard(x, MAX_TOUR, "a tour of one of many graphs")
        cost, path = optimise.best_tour(x)
        yield cost, None if path is None else [x.edge_id[k] for k in path]

    return run(w, solve, "cost double, path array<{edge}>", by=by)


def is_hamiltonian(g: Graph, *, by: str | None = None) -> DataFrame:
    def solve(x: Local):
        _guard(x, MAX_HAMILTON, "the Hamiltonian test")
        yield (optimise.is_hamiltonian(x),)

    return run(g, solve, "hamiltonian boolean", by=by)


def dirac(g: Graph) -> DataFrame:
    """One row: (n, least_degree, dirac): degrees of the simple undirected graph so high that a Hamiltonian cycle is sure."""
    ends = g.simple_undirected().select(F.explode(F.array("a", "b")).alias("_v")).groupBy("_v").agg(F.count("*").alias("_d"))
    d = g.vertices.join(ends, F.col("id") == F.col("_v"), "left").agg(F.count("*").alias("n"), F.min(F.coalesce("_d", F.lit(0))).alias("least_degree"))
    return d.select("n", "least_degree", (F.col("n") >= 3).__and__(2 * F.col("least_degree") >= F.col("n")).alias("dirac"))


def euler_circuit(g: Graph, start=None, *, by: str | None = None) -> DataFrame:
    """(position, edge_id)."""
    return run(g, lambda x: [(i, x.edge_id[k]) for i, k in enumerate(optimise.circuit(x, start))], "position long, edge_id {edge}", by=by)


def euler_trails(g: Graph, *, by: str | None = None) -> DataFrame:
    """(trail, position, edge_id), every edge once, edges taken either way."""
    return run(g, lambda x: [(t, i, x.edge_id[k]) for t, p in enumerate(optimise.trails(x)) for i, k in enumerate(p)], "trail int, position long, edge_id {edge}", by=by)


def maximal_cliques(g: Graph, *, by: str | None = None, local_vertices: int = MAX_CLIQUE_VERTICES) -> DataFrame:
    """(clique): all maximal cliques of the simple undirected graph, members in order.

    A graph of more than ``local_vertices`` vertices is peeled and solved vertex by vertex.
    """
    if by is None and g.vertices.limit(local_vertices + 1).count() > local_vertices:
        return peeled_cliques(g)

    def solve(x: Local):
        _guard(x, MAX_CLIQUE_VERTICES, "clique search of one of many graphs")
        for c in optimise.maximal_cliques(x):
            yield ([x.ids[v] for v in c],)

    return run(g, solve, "clique array<{id}>", by=by)


def vertex_cover(g: Graph, *, seed: int = 0, by: str | None = None) -> DataFrame:
    """(id): an approximate least vertex cover."""
    return run(g, lambda x: [(x.ids[v],) for v in sorted(optimise.cover(x, seed))], "id {id}", by=by)


def random_walk(g: Graph, root, *, steps: int = 100, chain: str = "uniform", seed: int = 0, factor: float = 0.2, stop_at=None, by: str | None = None, local_edges: int = WALK_LOCAL_EDGES) -> DataFrame:
    """(step, edge_id, src, dst); ``stop_at`` are edge ids before which the walk ends.

    A graph of more than ``local_edges`` edges is sorted once and walked by a lookup a step; the draws are the same.
    """
    g.require(root)
    ends = set(stop_at or ())
    if by is None and not fits_one_task(g.edges, local_edges):
        return single_walk(g, root, steps=steps, chain=chain, seed=seed, factor=factor, stop_at=ends)
    return run(g, lambda x: walks.walk(x, root, steps, walks.Chain(x, chain, seed, factor), ends.__contains__ if ends else None), "step long, edge_id {edge}, src {id}, dst {id}", by=by)


def random_tree(g: Graph, root=None, *, chain: str = "uniform", seed: int = 0, by: str | None = None) -> DataFrame:
    """(id, successor, edge_id): a random spanning tree toward root, or a forest."""
    if root is not None:
        g.require(root)
    return run(g, lambda x: walks.random_tree(x, walks.Chain(x, chain, seed), root), "id {id}, successor {id}, edge_id {edge}", by=by)


def check_left_right(left: set, right: set) -> None:
    if left & right:
        raise GraphError("the sides of a bipartite graph must be disjoint")
