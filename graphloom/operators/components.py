"""Connected, strongly connected and condensed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..kernels import run as kernel
from ..kernels import structure
from ..plans.durable import Stored, cut, replaced
from ..plans.iterate import fits_one_task, supersteps
from . import traces
from .order import is_dag


#: Links up to which labels are handed on round by round; of more, neighbours are first made one.
ROUNDS_LINKS = 1_000_000


def linked(links: DataFrame, *, rounds_links: int = ROUNDS_LINKS) -> Stored:
    """(v, c): the least vertex of each component, for the vertices of links (a, b).

    Beyond ``rounds_links`` links each vertex goes by the name of the one around it, or itself, whose hash is least; that
    leaves about half of the names, so what is moved in all such steps together is in proportion to the links.

    Every round a vertex takes the least label around it and then its label's label, so long chains take rounds in the
    logarithm of their length. Labels and links stay in tables; only whether any changed reaches the driver.
    """
    half = Stored(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    two_ways = half.df.union(half.df.select("b", "a"))
    if not fits_one_task(half.df, rounds_links):
        found = _named(half, two_ways, rounds_links)
        half.drop()
        return found
    both = replaced(half, two_ways, "links")
    now = Stored(both.df.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("c")), "labels")
    while True:
        around = both.df.join(now.df, F.col("b") == F.col("v")).groupBy("a").agg(F.min("c").alias("m"))
        least = now.df.join(around, F.col("v") == F.col("a"), "left").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        to = now.df.select(F.col("v").alias("w"), F.col("c").alias("d"))
        nxt = Stored(least.join(to, F.col("c") == F.col("w"), "left").select("v", "old", F.coalesce("d", "c").alias("c")), "labels")
        settled = nxt.df.where("c <> old").isEmpty()
        now.drop()
        now = nxt
        if settled:
            both.drop()
            now.df = now.df.select("v", "c")
            return now


def _named(half: Stored, two_ways: DataFrame, rounds_links: int) -> Stored:
    """``linked`` of many links (a, b), a < b, by way of the names that neighbours give each other."""
    name = lambda v: F.struct(F.xxhash64(v).alias("h"), F.col(v).alias("v"))
    up = Stored(two_ways.groupBy(F.col("a").alias("v")).agg(F.min(name("b")).alias("m")).select("v", F.least(name("v"), "m")["v"].alias("up")), "names")
    a, b = (up.df.select(F.col("v").alias(f"{x}_v"), F.col("up").alias(f"{x}_up")) for x in "ab")
    between = half.df.join(a, F.col("a") == F.col("a_v")).select("a_up", "b").join(b, F.col("b") == F.col("b_v")).where("a_up <> b_up")
    tops = linked(between.select(F.col("a_up").alias("a"), F.col("b_up").alias("b")), rounds_links=rounds_links)
    top = tops.df.select(F.col("v").alias("t"), F.col("c").alias("t_c"))
    rooted = replaced(up, up.df.join(top, F.col("up") == F.col("t"), "left").select("v", F.coalesce("t_c", "up").alias("root")), "roots")
    tops.drop()
    least = rooted.df.groupBy(F.col("root").alias("r")).agg(F.min("v").alias("c"))
    return replaced(rooted, rooted.df.join(least, F.col("root") == F.col("r")).select("v", "c"), "labels")


def labels_of(vertices: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least vertex linked with each, over links (a, b)."""
    return vertices.select("id").join(linked(links).df, F.col("id") == F.col("v"), "left").select("id", F.coalesce("c", "id").alias("label"))


def _numbered(g: Graph, labels: DataFrame) -> DataFrame:
    """(id, component): labels numbered from 0 by the first vertex of each in order."""
    from ..plans.durable import numbered

    first = labels.join(g.vertices.select("id", "ord"), "id").groupBy("label").agg(F.min("ord").alias("o"))
    return labels.join(numbered(first, ["o", "label"], "component").select("label", "component"), "label").select("id", "component")


def connected_components(g: Graph) -> DataFrame:
    """(id, component), direction ignored; components are numbered from 0 by their first vertices."""
    return _numbered(g, labels_of(g.vertices, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))))


weakly_connected_components = connected_components


def disjoint_sets(g: Graph) -> DataFrame:
    """(id, label): the partition that joining both ends of each edge gives, by least members."""
    return labels_of(g.vertices, g.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def strong_labels(g: Graph, *, local_edges: int | None = None) -> DataFrame:
    """(id, label): the least vertex of each strong component.

    Graphs within the bound of one task go to a kernel. Rounds otherwise: vertices without live in- or out-edges are components alone; then each vertex takes the least label that
    reaches it, and what reaches a label back within its colour is that label's component.
    """
    if fits_one_task(g.edges, local_edges):
        found = cut(strong_trace(g).select("id", "component"), "strong")
        return found.join(found.groupBy("component").agg(F.min("id").alias("label")), "component").select("id", "label")
    alive = cut(g.vertices.select("id"), "alive")
    arcs = cut(g.edges.where("src <> dst").select("src", "dst").distinct(), "arcs")
    done: DataFrame | None = None

    def add(new: DataFrame) -> None:
        nonlocal done
        done = new if done is None else done.union(new)

    while not alive.isEmpty():
        while True:
            busy = arcs.select(F.col("src").alias("id")).distinct().intersect(arcs.select(F.col("dst").alias("id")).distinct())
            lone = cut(alive.join(busy, "id", "left_anti"), "lone")
            if lone.isEmpty():
                break
            add(lone.select("id", F.col("id").alias("label")))
            alive, arcs = _without(alive, arcs, lone)
        if alive.isEmpty():
            break
        colour = cut(_spread(alive.select("id", F.col("id").alias("label")), arcs), "colour")
        a, b = (colour.select(F.col("id").alias(f"{x}_i"), F.col("label").alias(f"{x}_l")) for x in "ab")
        inside = cut(arcs.join(a, F.col("src") == F.col("a_i")).join(b, (F.col("dst") == F.col("b_i")) & (F.col("a_l") == F.col("b_l"))).select(F.col("dst").alias("src"), F.col("src").alias("dst")), "inside")
        back = colour.where("id = label")
        seen = cut(back, "back")
        front = seen
        while True:
            nxt = front.join(inside, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "label").distinct()
            nxt = cut(nxt.join(seen.select("id"), "id", "left_anti"), "front")
            if nxt.isEmpty():
                break
            seen, front = cut(seen.union(nxt), "back"), nxt
        add(seen.select("id", "label"))
        alive, arcs = _without(alive, arcs, seen)
    return done if done is not None else g.vertices.limit(0).select("id", F.col("id").alias("label"))


def _without(alive: DataFrame, arcs: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = gone.select(F.col("id").alias("_g"))
    left = cut(alive.join(g, F.col("id") == F.col("_g"), "left_anti"), "alive")
    return left, cut(arcs.join(g, F.col("src") == F.col("_g"), "left_anti").join(g.withColumnRenamed("_g", "_h"), F.col("dst") == F.col("_h"), "left_anti"), "arcs")


def _spread(labels: DataFrame, arcs: DataFrame) -> DataFrame:
    """The least label that reaches each vertex along the arcs."""
    now: Stored | None = None
    while True:
        before = labels if now is None else now.df.select("id", "label")
        met = before.join(arcs, F.col("id") == F.col("src")).groupBy("dst").agg(F.min("label").alias("m"))
        now = replaced(now, before.join(met, F.col("id") == F.col("dst"), "left").select("id", F.col("label").alias("old"), F.least("label", "m").alias("label")), "spread")
        if now.df.where("label <> old").isEmpty():
            return now.df.select("id", "label")


def strongly_connected_components(g: Graph, *, local_edges: int | None = None) -> DataFrame:
    """(id, component), numbered from 0 by first vertices."""
    return _numbered(g, strong_labels(g, local_edges=local_edges))


def strong_trace(g: Graph) -> DataFrame:
    """(id, component, root, discover_time), components numbered as a depth-first search completes them; a kernel."""
    return kernel.run(g, structure.strong_components, "id {id}, component long, root {id}, discover_time long")


def strong_steps(g: Graph, *, local_edges: int = traces.LOCAL_EDGES) -> DataFrame:
    """(step, id, component) of the depth-first search for strong components; a kernel, but for forests of few levels beyond ``local_edges``.

    Each vertex comes twice: when it is discovered, with the number of components complete by then, and with its own
    component when that is complete, last discovered first.
    """
    if g.directed and not fits_one_task(g.edges, local_edges):
        found = traces.depth_first(g)  # of a forest each vertex is a component, complete when it is finished
        if found is not None:
            seen = found.select(F.col("discover_time").alias("step"), "id", (F.col("order_no") - F.col("depth")).alias("component"))
            done = found.select(F.col("finish_time").alias("step"), "id", (F.col("order_no") - F.col("depth") + F.col("size") - 1).alias("component"))
            return seen.union(done)
    return kernel.run(g, structure.strong_steps, "step long, id {id}, component long")


def component_graphs(g: Graph, components: DataFrame) -> Graph:
    """The graph with a ``component`` column on vertices and on edges whose ends share one."""
    v = g.vertices.join(components, "id")
    ends = components.select(F.col("id").alias("_i"), "component"), components.select(F.col("id").alias("_j"), F.col("component").alias("_c"))
    e = g.edges.join(ends[0], F.col("src") == F.col("_i")).join(ends[1], (F.col("dst") == F.col("_j")) & (F.col("component") == F.col("_c")))
    return Graph(v, e.drop("_i", "_j", "_c"), g.directed, g.allow_parallel)


def condensation(g: Graph, *, strong: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices (label, n_vertices, n_edges inside) and edges (src, dst, n_edges, edge_ids) between components; no loops."""
    labels = cut(strong_labels(g) if strong else disjoint_sets(g), "labels")
    a, b = (labels.select(F.col("id").alias(f"{x}_i"), F.col("label").alias(f"{x}_l")) for x in "ab")
    e = cut(g.edges.join(a, F.col("src") == F.col("a_i")).join(b, F.col("dst") == F.col("b_i")).select("edge_id", "ord", "a_l", "b_l"), "condensed")
    inner = e.where("a_l = b_l").groupBy(F.col("a_l").alias("_l")).agg(F.count("*").alias("n"))
    v = labels.groupBy("label").agg(F.count("*").alias("n_vertices")).join(inner, F.col("label") == F.col("_l"), "left")
    between = e.where("a_l <> b_l").groupBy(F.col("a_l").alias("src"), F.col("b_l").alias("dst")).agg(F.count("*").alias("n_edges"), F.sort_array(F.collect_list("edge_id")).alias("edge_ids"))
    return v.select("label", "n_vertices", F.coalesce("n", F.lit(0)).alias("n_edges")), between


def edge_merge_condensation(g: Graph, keep) -> DataFrame:
    """(src, dst, edge_ids): edges between kept vertices, those through vertices that fail ``keep`` being merged.

    A merged edge carries the edge ids of its way. Failing vertices are taken out as they come in order: each way in is
    joined with each way out, and a way that comes back to the vertex taken out is dropped, as it is a loop there. On a
    cycle of failing vertices no way therefore passes the vertex that went first on it twice. Where failing vertices
    form no cycle, ways are grown edge by edge, as many rounds as the longest way has edges; else in a kernel.
    """
    kept = cut(g.vertices.where(keep).select("id"), "kept")
    e = g.edges.join(kept.select(F.col("id").alias("_s")), F.col("src") == F.col("_s"), "left")
    e = cut(e.join(kept.select(F.col("id").alias("_d")), F.col("dst") == F.col("_d"), "left").select("edge_id", "ord", "src", "dst", F.col("_s").isNotNull().alias("from_kept"), F.col("_d").isNotNull().alias("to_kept")), "arcs")
    failing = Graph(g.vertices.join(kept, "id", "left_anti"), e.where("not from_kept and not to_kept").select("edge_id", "ord", "src", "dst"))
    if not is_dag(failing):
        flagged = g.vertices.join(kept.withColumn("value", F.lit(1.0)), "id", "left").select("id", "ord", F.coalesce("value", F.lit(0.0)).alias("value"))
        return kernel.run(Graph(flagged, g.edges), structure.merge_edges, "src {id}, dst {id}, edge_ids array<{edge}>")
    start = e.where("from_kept").select("src", "dst", F.array("edge_id").alias("edge_ids"), (~F.col("to_kept")).alias("open"))
    inner = e.where("not from_kept").select(F.col("src").alias("m"), F.col("dst").alias("end"), "edge_id", "to_kept")

    def step(state: DataFrame, _: int) -> DataFrame:
        grown = state.where("open").join(inner, F.col("dst") == F.col("m"))
        return state.where("not open").union(grown.select("src", F.col("end").alias("dst"), F.concat("edge_ids", F.array("edge_id")), ~F.col("to_kept")))

    return supersteps(start, step, "open", rounds=1 << 20, name="merged").select("src", "dst", "edge_ids")


def is_eulerian(g: Graph) -> bool:
    """A closed trail over all edges of the simple undirected graph; a lone vertex has one, none or several have not."""
    pairs = cut(g.simple_undirected(), "pairs")
    if pairs.isEmpty():
        return g.vertices.limit(2).count() == 1
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    if not ends.groupBy("id").count().where("count % 2 = 1").isEmpty():
        return False
    return labels_of(ends.distinct(), pairs).select("label").distinct().limit(2).count() == 1


def components_with_edges(g: Graph) -> str:
    """How many components of the simple undirected graph have edges: ``none``, ``one`` or ``many``."""
    pairs = cut(g.simple_undirected(), "pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    return ("none", "one", "many")[labels_of(ends, pairs).select("label").distinct().limit(2).count()]


def euler_path_count(g: Graph) -> int:
    """0 with fewer edges than vertices; 1 with no odd vertex; 0 with an odd number of them; else half of them."""
    if g.edges.count() < g.vertices.count():
        return 0
    odd = g.odd_vertices().count()
    return 1 if odd == 0 else 0 if odd % 2 else odd // 2


def greedy_colouring(g: Graph, *, local_edges: int | None = None) -> DataFrame:
    """(id, colour): in order of insertion each vertex takes the least colour free among its (out) neighbours so far.

    A round colours the vertices all of whose earlier neighbours have a colour; graphs within the bound of one task go
    to a kernel.
    """
    if fits_one_task(g.edges, local_edges):
        return kernel.run(g, structure.first_fit, "id {id}, colour int")
    v = g.vertices.select("id", "ord")
    near = g.edges.where("src <> dst").select("src", "dst") if g.directed else g.adjacent_vertices().select(F.col("id").alias("src"), F.col("neighbour").alias("dst"))
    ranks = v.select(F.col("id").alias("_i"), F.col("ord").alias("_o"))
    back = near.distinct().join(ranks, F.col("src") == F.col("_i")).withColumnRenamed("_o", "s_ord").drop("_i")
    back = cut(back.join(ranks, F.col("dst") == F.col("_i")).where((F.col("_o") < F.col("s_ord")) | ((F.col("_o") == F.col("s_ord")) & (F.col("dst") < F.col("src")))).select("src", "dst"), "earlier")

    def step(state: DataFrame, _: int) -> DataFrame:
        seen = back.join(state.select(F.col("id").alias("_d"), F.col("colour").alias("_c")), F.col("dst") == F.col("_d"))
        ready = seen.groupBy("src").agg(F.every(F.col("_c").isNotNull()).alias("ok"), F.collect_set("_c").alias("used"))
        met = state.join(ready, F.col("id") == F.col("src"), "left")
        free = F.element_at(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")), 1)
        new = F.when(F.col("src").isNull(), F.lit(0)).when(F.col("ok"), free)
        return met.select("id", F.coalesce("colour", new).alias("colour"))

    return supersteps(v.select("id", F.lit(None).cast("int").alias("colour")), step, "colour is null", rounds=1 << 20, name="colours")
