"""Traversal by breadth and shortest paths.

Results are deterministic whatever the strategy: a vertex's parent is the first by (order of the parent, order of the
edge) among those on a path of least distance and then fewest edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError, NegativeCycleError, NegativeWeightError
from ..graph import Graph
from ..kernels import run as kernel
from ..kernels import shortest
from ..plans.durable import Stored, cut, replaced
from ..plans.iterate import fits_one_task, supersteps
from .order import is_dag

ROWS = "id {id}, distance double, hops int, parent {id}, pred_edge_id {edge}"
#: What relaxing an edge makes of a distance, and whether less is better: by name.
RELAXERS = {"shortest": (lambda d, w: d + w, True), "critical": (lambda d, w: d + w, False), "prim": (lambda d, w: w, True)}
#: Rounds whose betterments are kept apart.
FOLD = 8
UNREACHED = {"dijkstra": 1.7976931348623157e308, "bellman_ford": float("inf")}


def _arcs(g: Graph, weight) -> DataFrame:
    """Directed arcs with ``w``; undirected edges go both ways."""
    e = g.edges.withColumn("weight", (F.lit(1.0) if weight is None else weight).cast("double"))
    return Graph(g.vertices, e, g.directed).out_edges().select("edge_id", F.col("ord").alias("e_ord"), "src", "dst", F.col("weight").alias("w"))


def _settle(arcs: DataFrame, roots: DataFrame, relaxer: str, rounds: int, beyond: Exception) -> DataFrame:
    """(id, distance, hops) by relaxing the stored arcs of what the round before has bettered.

    A round writes only what it betters. What is known is one table and the betterments since, which are folded into it
    every ``FOLD`` rounds; so a deep graph costs a scan a round, and a shuffle of all that is known once in so many.
    """
    combine, less = RELAXERS[relaxer]
    sign = 1 if less else -1
    arcs = arcs.where("src <> dst")
    rank = lambda d, h: F.struct((sign * d).alias("d"), h.alias("h"))
    rows = lambda x, i: [F.col(i).alias("id"), (sign * F.col(f"{x}.d")).alias("distance"), F.col(f"{x}.h").alias("hops")]
    known = [Stored(roots.select("id", F.lit(0.0).alias("distance"), F.lit(0).alias("hops")), "paths")]

    def all_known() -> DataFrame:
        every = known[0].df
        for more in known[1:]:
            every = every.union(more.df)
        return every

    def fold() -> None:
        best = all_known().groupBy("id").agg(F.min(rank(F.col("distance"), F.col("hops"))).alias("x"))
        whole, old = Stored(best.select(*rows("x", "id")), "paths"), known[:]
        known[:] = [whole]
        for table in old:
            if table is not front:
                table.drop()

    front = known[0]
    for _ in range(rounds):
        ahead = front.df.join(arcs, F.col("id") == F.col("src"))
        met = ahead.groupBy("dst").agg(F.min(rank(combine(F.col("distance"), F.col("w")), F.col("hops") + 1)).alias("x"))
        old = all_known().join(met.select("dst"), F.col("id") == F.col("dst")).groupBy("id").agg(F.min(rank(F.col("distance"), F.col("hops"))).alias("y"))
        better = met.join(old, F.col("dst") == F.col("id"), "left").where("y is null or x < y")
        now = Stored(better.select(*rows("x", "dst")), "paths")
        if front not in known:
            front.drop()
        front = now
        if front.df.isEmpty():
            fold()
            return known[0].df
        known.append(front)
        if len(known) > FOLD:
            fold()
    raise beyond


def _with_parents(g: Graph, arcs: DataFrame, found: DataFrame, relaxer: str) -> DataFrame:
    combine = RELAXERS[relaxer][0]
    near = found.join(arcs, F.col("id") == F.col("src"))
    ends = found.select(F.col("id").alias("t"), F.col("distance").alias("t_d"), F.col("hops").alias("t_h"))
    tight = near.join(ends, (F.col("dst") == F.col("t")) & (combine(F.col("distance"), F.col("w")) == F.col("t_d")) & (F.col("hops") + 1 == F.col("t_h")))
    ranks = g.vertices.select(F.col("id").alias("p"), F.col("ord").alias("p_ord"))
    first = tight.join(ranks, F.col("src") == F.col("p")).groupBy("t").agg(F.min_by(F.struct("src", "edge_id"), F.struct("p_ord", "e_ord", "edge_id")).alias("x"))
    return found.join(first, F.col("id") == F.col("t"), "left").select("id", "distance", "hops", F.col("x.src").alias("parent"), F.col("x.edge_id").alias("pred_edge_id"))


def _no_farther(found: DataFrame, target) -> DataFrame:
    """The rows within the target's distance, none where it is out of reach; all without a target."""
    if target is None:
        return found
    limit = found.where(F.col("id") == F.lit(target)).select(F.col("distance").alias("_limit"))
    return found.join(F.broadcast(limit), F.col("distance") <= F.col("_limit")).drop("_limit")  # one row


def _root_rows(g: Graph, root) -> DataFrame:
    if root is None:
        raise GraphError("a root is needed")
    g.require(root)
    return g.vertices.where(F.col("id") == F.lit(root)).select("id")


def _weighted(g: Graph, weight) -> Graph:
    return g.with_edges(g.edges.withColumn("weight", (F.lit(1.0) if weight is None else weight).cast("double")))


def shortest_paths(g: Graph, root, *, weight=None, relaxer: str = "shortest", target=None, negative: str = "raise", local_edges: int | None = None) -> DataFrame:
    """(id, distance, hops, parent, pred_edge_id) of the vertices that root reaches.

    ``weight`` is a Column over the edges (default 1 an edge). ``negative="raise"`` refuses a negative weight on any edge
    out of a reached vertex; ``"allow"`` takes any and raises on a negative cycle within reach. Both hold at every size
    and whether or not there is a target. ``relaxer="critical"`` gives longest paths and wants an acyclic graph;
    ``"edge_shortest"`` never leaves the root, as nothing is less than 0. With a target only what is no farther than it
    is returned.
    """
    roots = _root_rows(g, root)
    if relaxer == "edge_shortest":
        kind = g.vertices.schema["id"].dataType, g.edges.schema["edge_id"].dataType
        return roots.select("id", F.lit(0.0).alias("distance"), F.lit(0).alias("hops"), F.lit(None).cast(kind[0]).alias("parent"), F.lit(None).cast(kind[1]).alias("pred_edge_id"))
    # what edges are made of is worked out once: bounds, rounds and parents read the stored edges
    g = g.with_edges(cut(_weighted(g, weight).edges.select("edge_id", "ord", "src", "dst", "weight"), "weighted"))
    arcs = _arcs(g, F.col("weight"))
    if relaxer == "critical" and not is_dag(g):
        raise NegativeCycleError("longest paths want an acyclic graph")
    small = relaxer == "shortest" and fits_one_task(g.edges, local_edges)
    if small:

        def solve(x: kernel.Local):
            found = shortest.dijkstra(x, root) if negative == "raise" else shortest.bellman_ford(x, root)
            return [(x.ids[v], d, h, None if k is None else x.ids[x.other(k, v)], None if k is None else x.edge_id[k]) for v, (d, h, k) in found.items()]

        found = kernel.run(g, solve, ROWS)
    else:
        beyond = NegativeWeightError if negative == "raise" and relaxer == "shortest" else NegativeCycleError
        found = _settle(arcs, roots, relaxer, g.vertices.count() + 1, beyond("a negative cycle is within reach of the root"))
        if relaxer == "shortest":
            below = found.join(arcs.where("w < 0" if negative == "raise" else "w < 0 and src = dst"), F.col("id") == F.col("src"))
            for r in below.limit(1).collect():
                if negative == "raise":
                    raise NegativeWeightError(f"edge {r['edge_id']!r} has weight {r['w']}")
                raise NegativeCycleError("a negative cycle is within reach of the root")
    if target is not None:
        g.require(target)
        found = _no_farther(found, target)
    return found if small else _with_parents(g, arcs, found, relaxer)


def bfs(g: Graph, root, *, local_edges: int | None = None) -> DataFrame:
    """(id, depth, parent, pred_edge_id) of the vertices that root reaches."""
    found = shortest_paths(g, root, local_edges=local_edges)
    return found.select("id", F.col("hops").alias("depth"), "parent", "pred_edge_id")


def bfs_from_roots(g: Graph) -> DataFrame:
    """(id, depth) from all vertices without in-edges together; what only cycles lead to is not there."""
    arcs = cut(_arcs(g, None), "arcs")
    return _settle(arcs, g.roots().select("id"), "shortest", g.vertices.count() + 1, GraphError("unreachable")).select("id", F.col("hops").alias("depth"))


def restarted_paths(g: Graph, *, weight=None) -> DataFrame:
    """(id, root, distance) as a rootless search gives it: in order, each vertex not yet reached starts anew at 0.

    What an earlier root reached is not relaxed again. Sequential by definition, so a kernel.
    """

    def solve(x: kernel.Local):
        done: set[int] = set()
        for s in range(x.n):
            if s in done:
                continue
            found = _from(x, s, done)
            for v, d in found.items():
                yield x.ids[v], x.ids[s], d
            done |= found.keys()

    return kernel.run(_weighted(g, weight), solve, "id {id}, root {id}, distance double")


def _from(x: kernel.Local, s: int, done: set[int]) -> dict[int, float]:
    import heapq

    best, settled, heap = {s: 0.0}, {}, [(0.0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v in settled:
            continue
        settled[v] = d
        for k in x.steps[v]:
            w, u = x.ends[2][k], x.other(k, v)
            if w < 0:
                raise NegativeWeightError(f"edge {x.edge_id[k]!r} has weight {w}")
            if u not in done and d + w < best.get(u, float("inf")):
                best[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return settled


def a_star(g: Graph, root, *, weight=None, heuristic=None, target=None, local_edges: int | None = None) -> DataFrame:
    """As shortest_paths, row by row; ``heuristic`` is a Column over the vertices, an estimate of what lies between each and the target.

    In one task vertices are taken by distance plus estimate and opened again when a shorter way to one is found, until
    none is open; so an estimate that is too high costs time and no way is missed. Graphs beyond the bound of one task,
    and a search without an estimate, are solved by shortest_paths.
    """
    if heuristic is None or not fits_one_task(g.edges, local_edges):
        return shortest_paths(g, root, weight=weight, target=target, local_edges=local_edges)
    g.require(*(root,) if target is None else (root, target))
    guided = Graph(g.vertices.withColumn("value", heuristic.cast("double")), _weighted(g, weight).edges, g.directed)

    def solve(x: kernel.Local):
        for v, (d, h, k) in shortest.a_star(x, root).items():
            yield x.ids[v], d, h, None if k is None else x.ids[x.other(k, v)], None if k is None else x.edge_id[k]

    return _no_farther(kernel.run(guided, solve, ROWS), target)


def best_first(g: Graph, root, target, *, weight=None) -> DataFrame:
    """The row of target as shortest_paths has it; nothing where it is out of reach. Loops and what lies farther do not count."""
    return shortest_paths(g, root, weight=weight, target=target).where(F.col("id") == F.lit(target))


def bellman_ford(g: Graph, root=None, *, weight=None, local_edges: int | None = None) -> DataFrame:
    """Any weights; the default root is the first vertex. Raises NegativeCycleError for a negative cycle within reach."""
    if root is None:
        first = g.vertices.orderBy("ord").limit(1).collect()
        if not first:
            raise GraphError("the graph has no vertices")
        root = first[0]["id"]
    return shortest_paths(g, root, weight=weight, negative="allow", local_edges=local_edges)


def has_negative_cycle(g: Graph, root=None, *, weight=None, local_edges: int | None = None) -> bool:
    """Whether one is within reach of the root."""
    try:
        bellman_ford(g, root, weight=weight, local_edges=local_edges)
    except NegativeCycleError:
        return True
    return False


def dag_shortest_paths(g: Graph, root, *, weight=None, longest: bool = False) -> DataFrame:
    """On acyclic graphs, any weights; raises NonAcyclicGraphError for a cycle anywhere."""
    from ..errors import NonAcyclicGraphError

    if not is_dag(g):
        raise NonAcyclicGraphError("the graph has a cycle")
    return shortest_paths(g, root, weight=weight, relaxer="critical" if longest else "shortest", negative="allow", local_edges=0)


def all_pairs(g: Graph, *, weight=None, relaxer: str = "shortest") -> DataFrame:
    """(src, dst, distance, hops, parent, pred_edge_id) of all pairs that are joined, by squaring; a vertex is at 0 from itself.

    parent and pred_edge_id are the last step of a way of least distance and then fewest edges, null where src is dst.
    ``relaxer="critical"`` gives longest ways and wants an acyclic graph. Raises NegativeCycleError where a vertex gets
    nearer to itself than 0.
    """
    if relaxer not in ("shortest", "critical"):
        raise GraphError(f"all pairs are not found by the relaxer {relaxer!r}")
    if relaxer == "critical" and not is_dag(g):
        raise NegativeCycleError("longest paths want an acyclic graph")
    sign = 1.0 if relaxer == "shortest" else -1.0
    edge, vertex = g.edges.schema["edge_id"].dataType, g.vertices.schema["id"].dataType
    step = F.struct((F.col("w") * sign).alias("d"), F.lit(1).alias("h"), F.col("e_ord").alias("o"), F.col("edge_id").alias("e"), F.col("src").alias("p"))
    arcs = _arcs(g, weight)
    none = F.struct(F.lit(0.0).alias("d"), F.lit(0).alias("h"), F.lit(None).cast(arcs.schema["e_ord"].dataType).alias("o"), F.lit(None).cast(edge).alias("e"), F.lit(None).cast(vertex).alias("p"))
    own = g.vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), none.alias("x"))
    now = Stored(arcs.select("src", "dst", step.alias("x")).union(own).groupBy("src", "dst").agg(F.min("x").alias("x")), "pairs")
    reach, n = 1, g.vertices.count()
    while True:
        if not now.df.where("src = dst and x.d < 0").isEmpty():
            raise NegativeCycleError("the graph has a negative cycle")
        if reach >= n:
            break
        after = now.df.select(F.col("src").alias("mid"), F.col("dst").alias("end"), F.col("x").alias("y"))
        last = F.when(F.col("y.e").isNull(), F.col("x")).otherwise(F.col("y"))
        both = F.struct((F.col("x.d") + F.col("y.d")).alias("d"), (F.col("x.h") + F.col("y.h")).alias("h"), last["o"].alias("o"), last["e"].alias("e"), last["p"].alias("p"))
        joined = now.df.join(after, F.col("dst") == F.col("mid")).groupBy("src", F.col("end").alias("dst")).agg(F.min(both).alias("x"))
        nxt = Stored(joined, "pairs")
        same = nxt.df.count() == now.df.count() and nxt.df.exceptAll(now.df).isEmpty()
        now.drop()
        now = nxt
        if same:
            break
        reach *= 2
    return now.df.select("src", "dst", (F.col("x.d") * sign).alias("distance"), F.col("x.h").alias("hops"), F.col("x.p").alias("parent"), F.col("x.e").alias("pred_edge_id"))


def all_pairs_paths(found: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(src, dst, path) of edge ids for pairs of ``all_pairs``, those of wanted (src, dst) alone if given; no row for a vertex itself."""
    tree = found.select(F.struct("src", "dst").alias("id"), F.when(F.col("parent").isNotNull(), F.struct("src", F.col("parent").alias("dst"))).alias("parent"), "pred_edge_id")
    targets = None if wanted is None else wanted.select(F.struct("src", "dst").alias("id"))
    return paths_to(tree, targets).select("id.src", "id.dst", "path")


def paths_to(found: DataFrame, targets: DataFrame | None = None, *, rounds: int = 64) -> DataFrame:
    """(id, path) of edge ids from the root, by pointer doubling over ``found`` (id, parent, pred_edge_id).

    The root itself has no path. Raises if predecessors form a cycle.
    """
    start = found.where("parent is not null").select("id", F.col("parent").alias("up"), F.array("pred_edge_id").alias("path"), F.lit(True).alias("open"))

    def step(state: DataFrame, _: int) -> DataFrame:
        above = state.select(F.col("id").alias("a"), F.col("up").alias("a_up"), F.col("path").alias("a_path"))
        met = state.join(above, F.col("up") == F.col("a"), "left")
        more = F.col("a").isNotNull()
        return met.select("id", F.coalesce("a_up", "up").alias("up"), F.when(more, F.concat("a_path", "path")).otherwise(F.col("path")).alias("path"), more.alias("open"))

    done = supersteps(start, step, "open", rounds=rounds, name="trails", beyond=GraphError("predecessors form a cycle")).select("id", "path")
    return done if targets is None else done.join(targets.select("id"), "id", "left_semi")


def leaf_paths(trace: DataFrame) -> DataFrame:
    """(id, path) of edge ids from the root to each traced vertex that nobody was found from, by a trace (id, parent, pred_edge_id)."""
    return paths_to(trace, trace.select("id").join(trace.select(F.col("parent").alias("id")).where("id is not null").distinct(), "id", "left_anti"))


def edge_paths(found: DataFrame, *, ends_only: bool = False) -> DataFrame:
    """(edge_id, path): the edges from the first one to each edge of an edge trace (edge_id, parent_edge_id), both included.

    ``ends_only`` keeps the edges from which no edge was found. Raises if predecessors form a cycle.
    """
    tree = found.select(F.col("edge_id").alias("id"), F.col("parent_edge_id").alias("parent"), F.col("parent_edge_id").alias("pred_edge_id"))
    above = paths_to(tree).withColumnRenamed("id", "edge_id")
    own = found.select("edge_id").join(above, "edge_id", "left")
    kind = own.schema["path"].dataType.simpleString()
    whole = own.select("edge_id", F.concat(F.coalesce("path", F.array().cast(kind)), F.array("edge_id")).alias("path"))
    if not ends_only:
        return whole
    return whole.join(found.select(F.col("parent_edge_id").alias("edge_id")).where("edge_id is not null").distinct(), "edge_id", "left_anti")


def merged_edge_paths(found: DataFrame) -> DataFrame:
    """(edge_id, path): as edge_paths of the ends, each path starting where it leaves those of earlier ends (by order_no)."""
    whole = cut(edge_paths(found, ends_only=True), "ways")
    order = found.select("edge_id", "order_no")
    each = whole.join(order, "edge_id").select("edge_id", "order_no", F.posexplode("path").alias("i", "step"))
    first = each.groupBy("step").agg(F.min_by("edge_id", "order_no").alias("owner"))
    own = each.join(first, "step").where(F.col("edge_id") == F.col("owner"))
    return own.groupBy("edge_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "step"))), lambda x: x["step"]).alias("path"))


def predecessor_cost(found: DataFrame, weights: DataFrame) -> DataFrame:
    """(id, cost): the sum of weights (edge_id, w) along each vertex's predecessors; the root costs 0."""
    each = paths_to(found).select("id", F.explode("path").alias("edge_id")).join(weights, "edge_id").groupBy("id").agg(F.sum("w").alias("cost"))
    return found.select("id").join(each, "id", "left").select("id", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def is_predecessor(found: DataFrame, root, v) -> bool:
    """Whether root is met on the way up from v, v itself included; safe on cycles. Steps double from round to round."""
    step = cut(found.where("parent is not null").select("id", "parent"), "step")
    known = cut(found.where(F.col("id") == F.lit(v)).select("id"), "above")
    size = known.count()
    while True:
        more = known.join(step, "id").select(F.col("parent").alias("id"))
        known = cut(known.union(more).distinct(), "above")
        if (n := known.count()) == size:
            return not known.where(F.col("id") == F.lit(root)).isEmpty()
        size = n
        up = step.select(F.col("id").alias("m"), F.col("parent").alias("top"))
        step = cut(step.join(up, F.col("parent") == F.col("m")).select("id", F.col("top").alias("parent")), "step")


def edge_reachable(g: Graph, edge_id) -> DataFrame:
    """(edge_id, depth): edges that can follow one another from the given edge on."""
    e = cut(g.edges.select("edge_id", "src", "dst"), "edges")
    start = e.where(F.col("edge_id") == F.lit(edge_id)).select("edge_id", "dst", F.lit(0).alias("depth"), F.lit(True).alias("open"))

    def step(state: DataFrame, k: int) -> DataFrame:
        ahead = state.where("open").select(F.col("dst").alias("at")).distinct().join(e, F.col("at") == F.col("src"))
        new = ahead.join(state.select("edge_id"), "edge_id", "left_anti").select("edge_id", "dst", F.lit(k + 1).alias("depth"), F.lit(True).alias("open"))
        return state.withColumn("open", F.lit(False)).union(new)

    return supersteps(start, step, "open", rounds=1 << 20, name="edges").select("edge_id", "depth")


def ranked_paths(g: Graph, source, target, k: int = 3, *, weight=None, strict: bool = False, keep=None) -> DataFrame:
    """(rank, cost, path): at most k loopless paths by cost. ``strict`` raises NoPathFoundError where there is none.

    ``keep`` is a Column over (cost, path) that filters what is returned.
    """
    g.require(source, target)
    rows = kernel.run(_weighted(g, weight), lambda x: shortest.ranked_paths(x, source, target, k, strict=strict), "rank int, cost double, path array<{edge}>")
    return rows if keep is None else rows.where(keep)


def k_shortest(g: Graph, source, target, k: int, **options) -> DataFrame:
    """k >= 1 paths; raises NoPathFoundError where there is none, source and target being the same included."""
    if k < 1:
        raise GraphError("k must be at least 1")
    return ranked_paths(g, source, target, k, strict=True, **options)


def ranked_deviations(g: Graph, source, target, count: int = 3, *, weight=None, keep=None) -> DataFrame:
    """(rank, cost, path): count > 1 loopless paths by cost, from the tree of shortest ways to the target; empty where there is none."""
    if count <= 1:
        raise GraphError("count must be over 1")
    g.require(source, target)
    rows = kernel.run(_weighted(g, weight), lambda x: shortest.deviations(x, source, target, count), "rank int, cost double, path array<{edge}>")
    return rows if keep is None else rows.where(keep)
