"""The graph: two DataFrames and two flags; every change gives a new graph.

``vertices`` has ``id`` and ``ord``, ``edges`` has ``edge_id``, ``ord``, ``src`` and ``dst``; both may have attributes,
``weight`` being the usual one. ``ord`` is the order of insertion and breaks every tie; ``edge_id`` is an edge's own
identity, so parallel edges stay apart. Predicates and weights are Columns over the frames' columns.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .errors import GraphError, VertexNotFoundError
from .plans.durable import cut

#: What makes two edges equal, as columns.
IDENTITIES = {
    "id": ("edge_id",),
    "endpoints": ("src", "dst"),
    "endpoints_tag": ("src", "dst", "tag"),
    "endpoints_terminals": ("src", "dst", "src_terminal", "dst_terminal"),
}


def other_end(v: Column) -> Column:
    """The endpoint that is not v; the source where v is not the source."""
    return F.when(F.col("src") == v, F.col("dst")).otherwise(F.col("src"))


@dataclass(frozen=True)
class Graph:
    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    allow_parallel: bool = True
    identity: str = "id"

    # ---- construction -------------------------------------------------------------------------------------------

    @staticmethod
    def of(vertices: DataFrame, edges: DataFrame, *, directed: bool = True, allow_parallel: bool = True, identity: str = "id") -> Graph:
        """From frames with the engine's columns; ``ord`` defaults to id and edge_id. First of parallel edges wins."""
        v = vertices if "ord" in vertices.columns else vertices.withColumn("ord", F.col("id"))
        e = edges if "ord" in edges.columns else edges.withColumn("ord", F.col("edge_id"))
        g = Graph(v, e, directed, allow_parallel, identity)
        return g if allow_parallel else replace(g, edges=g._first_of_parallel(e))

    @staticmethod
    def from_edges(edges: DataFrame, **flags) -> Graph:
        """Vertices are the edges' ends, ordered by first appearance."""
        e = edges if "ord" in edges.columns else edges.withColumn("ord", F.col("edge_id"))
        ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (2 * F.col("ord")).alias("o")), F.struct(F.col("dst").alias("id"), (2 * F.col("ord") + 1).alias("o")))).alias("x"))
        return Graph.of(ends.groupBy(F.col("x.id").alias("id")).agg(F.min("x.o").alias("ord")), e, **flags)

    @staticmethod
    def from_columns(df: DataFrame, sources: str, targets: str, **flags) -> Graph:
        """One row with two arrays of equal length, sources and targets; edges are numbered by position."""
        pairs = df.select(F.posexplode(F.arrays_zip(F.col(sources).alias("src"), F.col(targets).alias("dst"))).alias("edge_id", "x"))
        return Graph.from_edges(pairs.select(F.col("edge_id").cast("long").alias("edge_id"), "x.src", "x.dst"), **flags)

    @staticmethod
    def from_adjacency(df: DataFrame, id_: str, targets: str, *, listed_only: bool = False, **flags) -> Graph:
        """A row a vertex with its array of targets; ``listed_only`` drops edges that leave the listed vertices."""
        v = df.select(F.col(id_).alias("id"), F.col(id_).alias("ord"))
        e = df.select(F.col(id_).alias("src"), F.posexplode(targets).alias("pos", "dst"))
        e = e.select(F.xxhash64("src", "pos").alias("edge_id"), F.struct("src", "pos").alias("ord"), "src", "dst")
        if listed_only:
            e = e.join(v.select(F.col("id").alias("_i")), F.col("dst") == F.col("_i"), "left_semi")
        else:
            more = e.select(F.col("dst").alias("id")).distinct().join(v, "id", "left_anti")
            v = v.unionByName(more.withColumn("ord", F.col("id")))
        return Graph.of(v, e, **flags)

    @staticmethod
    def matrix(n: int, edges: DataFrame) -> Graph:
        """Vertices 0..n-1 and at most one edge of each ordered pair, the first."""
        v = edges.sparkSession.range(n).select("id", F.col("id").alias("ord"))
        return Graph.of(v, edges, allow_parallel=False)

    def checked(self) -> Graph:
        """Raises if an id is null or an edge's end is no vertex."""
        if not self.vertices.where("id is null").isEmpty() or not self.edges.where("src is null or dst is null").isEmpty():
            raise GraphError("vertices and edge ends must not be null")
        ends = self.edges.select("src").union(self.edges.select("dst")).distinct()
        lost = ends.join(self.vertices, ends["src"] == F.col("id"), "left_anti").limit(1).collect()
        if lost:
            raise VertexNotFoundError(f"edge end {lost[0][0]!r} is no vertex")
        return self

    def require(self, *ids) -> None:
        known = {r["id"] for r in self.vertices.where(F.col("id").isin(*ids)).select("id").collect()}
        for i in ids:
            if i not in known:
                raise VertexNotFoundError(f"{i!r} is no vertex of the graph")

    def _pair(self, e: DataFrame) -> list[Column]:
        return [e["src"], e["dst"]] if self.directed else [F.least(e["src"], e["dst"]), F.greatest(e["src"], e["dst"])]

    def _first_of_parallel(self, e: DataFrame) -> DataFrame:
        a, b = self._pair(e)
        first = F.row_number().over(W.partitionBy("_a", "_b").orderBy("ord", "edge_id"))
        return e.withColumn("_a", a).withColumn("_b", b).withColumn("_n", first).where("_n = 1").drop("_a", "_b", "_n")

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    # ---- membership and adjacency -------------------------------------------------------------------------------

    def contains_vertices(self, ids: DataFrame) -> DataFrame:
        """ids (id) with ``found``."""
        known = self.vertices.select(F.col("id").alias("_i"), F.lit(True).alias("_f"))
        return ids.join(known, F.col("id") == F.col("_i"), "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_i", "_f")

    def _keyed(self, pairs: DataFrame) -> DataFrame:
        a, b = self._pair(pairs)
        return pairs.withColumn("_a", a).withColumn("_b", b)

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) with ``found``."""
        known = self._keyed(self.edges).select("_a", "_b").distinct().withColumn("_f", F.lit(True))
        return self._keyed(pairs).join(known, ["_a", "_b"], "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_a", "_b", "_f")

    def edges_between(self, pairs: DataFrame) -> DataFrame:
        """All edges of the pairs (src, dst), parallel ones included."""
        return self._keyed(self.edges).join(self._keyed(pairs).select("_a", "_b").distinct(), ["_a", "_b"], "left_semi").drop("_a", "_b")

    def first_edges(self) -> DataFrame:
        """The first edge of each pair (src, dst)."""
        return self._first_of_parallel(self.edges)

    def out_edges(self, v=None) -> DataFrame:
        e = self.edges if self.directed else self.symmetric().edges
        return e if v is None else e.where(F.col("src") == v)

    def in_edges(self, v=None) -> DataFrame:
        return self.edges if v is None else self.edges.where(F.col("dst") == v)

    def nth_out_edges(self, n: int) -> DataFrame:
        """Of each vertex its n-th out edge from 0."""
        nth = F.row_number().over(W.partitionBy("src").orderBy("ord", "edge_id")) - 1
        return self.edges.withColumn("_n", nth).where(F.col("_n") == n).drop("_n")

    def nth_in_edges(self, n: int) -> DataFrame:
        nth = F.row_number().over(W.partitionBy("dst").orderBy("ord", "edge_id")) - 1
        return self.edges.withColumn("_n", nth).where(F.col("_n") == n).drop("_n")

    def _counted(self, ends: DataFrame, name: str) -> DataFrame:
        n = ends.groupBy("_v").agg(F.count("*").alias(name))
        return self.vertices.select("id").join(n, F.col("id") == F.col("_v"), "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))

    def out_degrees(self) -> DataFrame:
        return self._counted(self.edges.select(F.col("src").alias("_v")), "out_degree")

    def in_degrees(self) -> DataFrame:
        return self._counted(self.edges.select(F.col("dst").alias("_v")), "in_degree")

    def degrees(self) -> DataFrame:
        """A loop counts twice, in directed and undirected graphs alike."""
        return self._counted(self.edges.select(F.explode(F.array("src", "dst")).alias("_v")), "degree")

    def incidences(self) -> DataFrame:
        """(v, other, edge columns): each edge under both ends, a loop once."""
        e = self.edges
        back = e.where("src <> dst").select(F.col("dst").alias("v"), F.col("src").alias("other"), *e.columns)
        return e.select(F.col("src").alias("v"), F.col("dst").alias("other"), *e.columns).unionByName(back)

    def adjacent_edges(self, v) -> DataFrame:
        return self.edges.where((F.col("src") == v) | (F.col("dst") == v))

    def adjacent_degrees(self) -> DataFrame:
        """A loop counts once."""
        return self._counted(self.incidences().select(F.col("v").alias("_v")), "adjacent_degree")

    def adjacent_vertices(self) -> DataFrame:
        """(id, neighbour), distinct and without the vertex itself."""
        return self.incidences().where("v <> other").select(F.col("v").alias("id"), F.col("other").alias("neighbour")).distinct()

    def _without(self, *ends: str) -> DataFrame:
        used = None
        for c in ends:
            one = self.edges.select(F.col(c).alias("_v"))
            used = one if used is None else used.union(one)
        return self.vertices.join(used.distinct(), F.col("id") == F.col("_v"), "left_anti")

    def roots(self) -> DataFrame:
        return self._without("dst")

    def sinks(self) -> DataFrame:
        return self._without("src")

    def isolated(self) -> DataFrame:
        return self._without("src", "dst")

    def odd_vertices(self) -> DataFrame:
        """Vertices whose out-degree minus in-degree is odd."""
        signed = self.edges.select(F.explode(F.array(F.struct(F.col("src").alias("v"), F.lit(1).alias("s")), F.struct(F.col("dst").alias("v"), F.lit(-1).alias("s")))).alias("x"))
        return signed.groupBy(F.col("x.v").alias("id")).agg(F.sum("x.s").alias("s")).where("pmod(s, 2) = 1").select("id")

    def self_edges(self) -> DataFrame:
        return self.edges.where("src = dst")

    # ---- changes ------------------------------------------------------------------------------------------------

    def add_vertices(self, more: DataFrame) -> Graph:
        """Those not there yet."""
        new = more.dropDuplicates(["id"]).join(self.vertices.select("id"), "id", "left_anti")
        return replace(self, vertices=self.vertices.unionByName(new, allowMissingColumns=True))

    def add_edges(self, more: DataFrame, *, with_vertices: bool = False) -> Graph:
        """Existing edges win over parallel new ones where those are not allowed; ends must exist or come with them."""
        g = self
        if with_vertices:
            ends = more.select(F.explode(F.array(F.struct(F.col("src").alias("id"), (2 * F.col("ord")).alias("o")), F.struct(F.col("dst").alias("id"), (2 * F.col("ord") + 1).alias("o")))).alias("x"))
            g = g.add_vertices(ends.groupBy(F.col("x.id").alias("id")).agg(F.min("x.o").alias("ord")))
        else:
            replace(self, edges=more).checked()
        e = self.edges.unionByName(more, allowMissingColumns=True)
        return replace(g, edges=e if self.allow_parallel else self._first_of_parallel(e))

    def remove_edges_if(self, predicate: Column) -> Graph:
        return replace(self, edges=self.edges.where(~F.coalesce(predicate, F.lit(False))))

    def remove_edges(self, gone: DataFrame) -> Graph:
        """One edge for each equal row of ``gone``, the first ones; equality is the graph's identity."""
        cols = list(IDENTITIES[self.identity])
        nth = F.row_number().over(W.partitionBy(*cols).orderBy("ord", "edge_id"))
        times = gone.groupBy(*cols).agg(F.count("*").alias("_t"))
        left = self.edges.withColumn("_n", nth).join(times, cols, "left").where("_t is null or _n > _t")
        return replace(self, edges=left.select(*self.edges.columns))

    def remove_vertices_if(self, predicate: Column) -> Graph:
        """With their edges."""
        kept = self.vertices.where(~F.coalesce(predicate, F.lit(False)))
        return replace(self, vertices=kept, edges=_inside(self.edges, kept))

    def clear_edges(self, v, side: str = "both") -> Graph:
        """Drops the out, in or all edges of a vertex."""
        at = {"out": F.col("src") == v, "in": F.col("dst") == v, "both": (F.col("src") == v) | (F.col("dst") == v)}
        return self.remove_edges_if(at[side])

    def merge_vertex(self, v) -> Graph:
        """Takes v out and joins every in-neighbour with every out-neighbour; loops of v go, and v is nobody's end."""
        into = self.edges.where((F.col("dst") == v) & (F.col("src") != v)).select("src", F.col("ord").alias("_o1"), F.col("edge_id").alias("_e1"))
        out = self.edges.where((F.col("src") == v) & (F.col("dst") != v)).select("dst", F.col("ord").alias("_o2"), F.col("edge_id").alias("_e2"))
        # the pairs are the result; in-edges are dealt to as many parts as there are tasks, so that a hub's are not one task's
        parts = int(self.edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = into.withColumn("_k", F.pmod(F.xxhash64("_e1"), F.lit(parts)))
        met = dealt.join(out.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))), "_k")
        new = met.select(F.xxhash64("_e1", "_e2").alias("edge_id"), F.col("_o1").alias("ord"), "src", "dst")
        return self.remove_vertices_if(F.col("id") == v).with_parallel_policy(new)

    def with_parallel_policy(self, more: DataFrame) -> Graph:
        e = self.edges.unionByName(more, allowMissingColumns=True)
        return replace(self, edges=e if self.allow_parallel else self._first_of_parallel(e))

    def merge_vertices_if(self, predicate: Column) -> Graph:
        """Merges the matching vertices one after another, in order: later ones see earlier merges."""
        g = self
        for r in self.vertices.where(predicate).orderBy("ord").select("id").collect():  # what is done one by one is listed
            g = g.merge_vertex(r["id"])
            g = replace(g, vertices=cut(g.vertices, "merged"), edges=cut(g.edges, "merged"))
        return g

    def cleared(self) -> Graph:
        return replace(self, vertices=self.vertices.limit(0), edges=self.edges.limit(0))

    def mapped(self, vertex: Column, source: Column, target: Column) -> Graph:
        """A copy with ids mapped by expressions."""
        return replace(self, vertices=self.vertices.withColumn("id", vertex), edges=self.edges.withColumns({"src": source, "dst": target}))

    # ---- views --------------------------------------------------------------------------------------------------

    def filtered(self, vertex: Column | None = None, edge: Column | None = None) -> Graph:
        """Edges whose ends and that themselves pass."""
        v = self.vertices if vertex is None else self.vertices.where(vertex)
        e = self.edges if edge is None else self.edges.where(edge)
        return replace(self, vertices=v, edges=e if vertex is None else _inside(e, v))

    def restricted(self, ids: DataFrame) -> Graph:
        """To the vertices whose ids are rows of ``ids``."""
        v = self.vertices.join(ids.select("id").distinct(), "id", "left_semi")
        return replace(self, vertices=v, edges=_inside(self.edges, v))

    def residual(self, residuals: DataFrame, reverse: DataFrame | None = None) -> DataFrame:
        """Edges with residual (edge_id, residual) above 0; of their reverse (edge_id, reverse_id) where it is given.

        Raises where an edge has no residual, or, with ``reverse``, no reverse edge.
        """
        known = residuals.select("edge_id") if reverse is None else reverse.join(residuals.select(F.col("edge_id").alias("reverse_id")), "reverse_id", "left_semi").select("edge_id")
        for r in self.edges.join(known, "edge_id", "left_anti").limit(1).collect():
            raise GraphError(f"edge {r['edge_id']!r} has no {'residual' if reverse is None else 'reverse edge with a residual'}")
        left = residuals.where("residual > 0").select(F.col("edge_id").alias("_r"))
        if reverse is None:
            return self.edges.join(left, F.col("edge_id") == F.col("_r"), "left_semi")
        ok = reverse.join(left, F.col("reverse_id") == F.col("_r"), "left_semi").select(F.col("edge_id").alias("_e"))
        return self.edges.join(ok, F.col("edge_id") == F.col("_e"), "left_semi")

    def reversed(self) -> Graph:
        return replace(self, edges=_swapped(self.edges))

    def undirected(self) -> Graph:
        return replace(self, directed=False)

    def symmetric(self) -> Graph:
        """Each edge both ways, a loop once; edge ids stay."""
        return replace(self, edges=self.edges.unionByName(_swapped(self.edges.where("src <> dst"))), directed=True)

    def simple_undirected(self) -> DataFrame:
        """(a, b) distinct neighbours with a < b: no loops, no parallels."""
        return self.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()

    def compressed(self) -> DataFrame:
        """(id, targets): sorted targets with repetitions, a row a vertex; tags do not come along."""
        rows = self.edges.groupBy(F.col("src").alias("_s")).agg(F.sort_array(F.collect_list("dst")).alias("targets"))
        met = self.vertices.select("id").join(rows, F.col("id") == F.col("_s"), "left")
        return met.select("id", F.coalesce("targets", F.array().cast(rows.schema["targets"].dataType)).alias("targets"))

    def edge_list(self) -> Graph:
        """Only edges, each once by endpoints; vertices are their ends."""
        once = replace(self, allow_parallel=False)._first_of_parallel(self.edges)
        return Graph.from_edges(once, directed=self.directed)

    # ---- comparison ---------------------------------------------------------------------------------------------

    def equals(self, other: Graph, *, identity: tuple[str, ...] = ("src", "dst")) -> bool:
        """Same direction and the same vertices and edges, as multisets."""
        if self.directed != other.directed:
            return False
        pairs = [(self.vertices.select("id"), other.vertices.select("id")), (self._by(identity), other._by(identity))]
        return all(a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() for a, b in pairs)

    def _by(self, identity: tuple[str, ...]) -> DataFrame:
        a, b = self._pair(self.edges)
        rest = [c for c in identity if c not in ("src", "dst")]
        return self.edges.select(a.alias("src"), b.alias("dst"), *rest)


def _swapped(e: DataFrame) -> DataFrame:
    return e.select(*(F.col("dst").alias("src") if c == "src" else F.col("src").alias("dst") if c == "dst" else F.col(c) for c in e.columns))


def _inside(e: DataFrame, v: DataFrame) -> DataFrame:
    a, b = v.select(F.col("id").alias("_i")), v.select(F.col("id").alias("_j"))
    return e.join(a, F.col("src") == F.col("_i"), "left_semi").join(b, F.col("dst") == F.col("_j"), "left_semi")
