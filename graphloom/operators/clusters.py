"""Nested clusters of vertices and edges: members belong to a cluster and to all above it."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import Graph
from ..plans.durable import cut


@dataclass(frozen=True)
class Clusters:
    """tree (cluster, parent; null at the top) and member vertices (cluster, id); edges belong where both ends do."""

    graph: Graph
    tree: DataFrame
    members: DataFrame

    def lineage(self) -> DataFrame:
        """(cluster, above): each cluster with itself and all it lies in."""
        now = cut(self.tree.select("cluster", F.col("cluster").alias("above")).union(self.tree.where("parent is not null").select("cluster", F.col("parent").alias("above"))), "lineage")
        size = now.count()
        while True:
            up = now.select(F.col("cluster").alias("m"), F.col("above").alias("a"))
            now = cut(now.join(up, F.col("above") == F.col("m")).select("cluster", F.col("a").alias("above")).union(now).distinct(), "lineage")
            if (n := now.count()) == size:
                return now
            size = n

    def add(self, more: DataFrame) -> Clusters:
        """more (cluster, id): also to the clusters above, and to the graph."""
        all_ = more.join(self.lineage(), "cluster").select(F.col("above").alias("cluster"), "id")
        new = more.select("id").distinct().withColumn("ord", F.col("id"))
        return replace(self, graph=self.graph.add_vertices(new), members=self.members.union(all_).distinct())

    def remove(self, gone: DataFrame) -> Clusters:
        """gone (cluster, id): from the cluster, from those within it and from those above it."""
        line = self.lineage()
        down = gone.join(line.select(F.col("above").alias("cluster"), F.col("cluster").alias("c")), "cluster").select(F.col("c").alias("cluster"), "id")
        up = gone.join(line, "cluster").select(F.col("above").alias("cluster"), "id")
        return replace(self, members=self.members.join(down.union(up).distinct(), ["cluster", "id"], "left_anti"))

    def edges(self) -> DataFrame:
        """(cluster, edge_id): the edges with both ends in a cluster."""
        a, b = (self.members.select(F.col("cluster").alias(f"c{x}"), F.col("id").alias(f"i{x}")) for x in "ab")
        e = self.graph.edges
        return e.join(a, F.col("src") == F.col("ia")).join(b, (F.col("dst") == F.col("ib")) & (F.col("ca") == F.col("cb"))).select(F.col("ca").alias("cluster"), "edge_id")

    def counts(self) -> DataFrame:
        """(cluster, n_vertices, n_edges)."""
        v, e = self.members.groupBy("cluster").agg(F.count("*").alias("v")), self.edges().groupBy("cluster").agg(F.count("*").alias("e"))
        return self.tree.select("cluster").join(v, "cluster", "left").join(e, "cluster", "left").select("cluster", F.coalesce("v", F.lit(0)).alias("n_vertices"), F.coalesce("e", F.lit(0)).alias("n_edges"))
