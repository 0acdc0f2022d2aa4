"""Reversed edges, super vertices, balancing: plans that add rows and leave the graph they start from as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..errors import GraphError
from ..graph import Graph


def reversed_edges(g: Graph) -> DataFrame:
    """(edge_id, src, dst, reverse_id, added): each edge with its reverse, existing antiparallel edges paired one to one.

    The k-th edge of a pair of ends goes with the k-th one back; loops pair up two by two; what stays alone gets an added
    edge whose reverse_id is negative by the edge's hash.
    """
    a, b = F.least("src", "dst"), F.greatest("src", "dst")
    e = g.edges.select("edge_id", "ord", "src", "dst", a.alias("_a"), b.alias("_b"), (F.col("src") <= F.col("dst")).alias("_up"))
    k = F.row_number().over(W.partitionBy("_a", "_b", "_up").orderBy("ord", "edge_id")) - 1
    e = e.withColumn("_k", k)
    loop = F.col("_a") == F.col("_b")
    e = e.withColumn("_slot", F.when(loop, F.floor(F.col("_k") / 2)).otherwise(F.col("_k"))).withColumn("_side", F.when(loop, F.col("_k") % 2 == 0).otherwise(F.col("_up")))
    other = e.select(F.col("edge_id").alias("reverse_id"), "_a", "_b", "_slot", (~F.col("_side")).alias("_side"))
    met = e.join(other, ["_a", "_b", "_slot", "_side"], "left")
    return met.select("edge_id", "src", "dst", F.coalesce("reverse_id", -F.abs(F.xxhash64("edge_id"))).alias("reverse_id"), F.col("reverse_id").isNull().alias("added"))


def with_reversed_edges(g: Graph) -> Graph:
    """The graph with the edges that reversed_edges adds."""
    new = reversed_edges(g).where("added").select(F.col("reverse_id").alias("edge_id"), F.col("reverse_id").alias("ord"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return g.with_edges(g.edges.unionByName(new, allowMissingColumns=True))


def _super(g: Graph, source, sink) -> Graph:
    spark = g.vertices.sparkSession
    known = g.vertices.where(F.col("id").isin(source, sink)).limit(1).collect()
    if known or source == sink:
        raise GraphError("the super vertices must be new and differ")
    last = g.vertices.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("m"))
    two = spark.createDataFrame([(1, source), (2, sink)], "k long, i " + g.vertices.schema["id"].dataType.simpleString())
    new = two.crossJoin(F.broadcast(last)).select(F.col("i").alias("id"), (F.col("m") + F.col("k")).alias("ord"))  # two rows and one
    return g.add_vertices(new)


def _arc(src, dst, salt: int, kind: str) -> list:
    return [F.xxhash64(src, dst, F.lit(salt)).alias("edge_id"), F.lit(2**62 + salt).alias("ord"), src.cast(kind).alias("src"), dst.cast(kind).alias("dst")]


def _augmented(g: Graph, arcs: list[DataFrame]) -> tuple[Graph, DataFrame]:
    new = arcs[0]
    for a in arcs[1:]:
        new = new.unionByName(a)
    return g.with_parallel_policy(new), new


def augment_all(g: Graph, source, sink) -> tuple[Graph, DataFrame]:
    """source to every vertex and every vertex to sink, both super vertices included; and the added edges."""
    s = _super(g, source, sink)
    kind, v = s.vertices.schema["id"].dataType.simpleString(), F.col("id")
    return _augmented(s, [s.vertices.select(*_arc(F.lit(source), v, 0, kind)), s.vertices.select(*_arc(v, F.lit(sink), 1, kind))])


def augment_sources_sinks(g: Graph, source, sink) -> tuple[Graph, DataFrame]:
    """source to the roots and the sinks to sink, each judged on the graph as it then stands, super vertices included.

    So the source itself, a root when it is asked, gets an edge to itself; a vertex that has one out then is no sink.
    """
    s = _super(g, source, sink)
    kind, v = s.vertices.schema["id"].dataType.simpleString(), F.col("id")
    roots = s.roots().select(*_arc(F.lit(source), v, 0, kind))
    after = s.with_parallel_policy(roots)
    return _augmented(s, [roots, after.sinks().select(*_arc(v, F.lit(sink), 1, kind))])


def augment_bipartite(g: Graph, left: DataFrame, right: DataFrame, source, sink) -> tuple[Graph, DataFrame]:
    """source to the left ids and the right ids to sink."""
    s = _super(g, source, sink)
    kind, v = s.vertices.schema["id"].dataType.simpleString(), F.col("id")
    return _augmented(s, [left.select(*_arc(F.lit(source), v, 0, kind)), right.select(*_arc(v, F.lit(sink), 1, kind))])


def balance_index(g: Graph) -> DataFrame:
    """(id, index): out-degree minus in-degree."""
    return g.out_degrees().join(g.in_degrees(), "id").select("id", (F.col("out_degree") - F.col("in_degree")).alias("index"))


def balance(g: Graph, source, sink, balancing_source, balancing_sink) -> tuple[DataFrame, DataFrame]:
    """(src, dst, capacity, kind) that even out a flow network, and the edges with preflow 1.

    With source and sink tied by edges from the balancing vertices, a vertex with more in than out is fed by a surplus
    edge of capacity -index, one with more out than in gives a deficient edge of capacity index.
    """
    kind = g.vertices.schema["id"].dataType.simpleString()
    g.require(source, sink)
    lit = lambda x: F.lit(x).cast(kind)
    index = balance_index(g)
    surplus = index.where("index < 0").select(lit(balancing_source).alias("src"), F.col("id").alias("dst"), (-F.col("index")).alias("capacity"), F.lit("surplus").alias("kind"))
    deficient = index.where("index > 0").select(F.col("id").alias("src"), lit(balancing_sink).alias("dst"), F.col("index").alias("capacity"), F.lit("deficient").alias("kind"))
    ties = g.vertices.where(F.col("id") == F.lit(source)).select(lit(balancing_source).alias("src"), F.col("id").alias("dst"), F.lit(2**62).alias("capacity"), F.lit("source").alias("kind"))
    ties = ties.union(g.vertices.where(F.col("id") == F.lit(sink)).select(F.col("id").alias("src"), lit(balancing_sink).alias("dst"), F.lit(2**62), F.lit("sink")))
    return ties.union(surplus).union(deficient), g.edges.withColumn("preflow", F.lit(1))
