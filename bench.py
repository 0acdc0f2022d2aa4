"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the cores."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import queries
from graphloom.graph import Graph
from graphloom.operators import components, paths

CHAIN = 50_000
NAMES = [
    "out_degree", "adjacent_vertices", "filtered_graph", "reversed_edge_augment", "isolated", "bfs_depth", "sssp_local", "all_pairs", "connected_components", "strong_components",
    "topo_layers", "transitive_closure", "minimum_spanning_forest", "pagerank", "max_flow", "assignment", "best_tour", "k_shortest", "dfs_order",
]


def chain(spark: SparkSession) -> Graph:
    """0 .. n-1, edges to the next vertex of weight 1 and to the one after of weight 3."""
    i = spark.range(CHAIN)
    e = i.select(F.explode(F.array(*(F.struct((2 * F.col("id") + k).alias("edge_id"), F.col("id").alias("src"), (F.col("id") + k + 1).alias("dst"), F.lit(1.0 + 2 * k).alias("weight")) for k in (0, 1)))).alias("x"))
    e = e.select("x.*").where(F.col("dst") < CHAIN)
    return Graph.of(i.withColumn("ord", F.col("id")), e.withColumn("ord", F.col("edge_id")))


def done(df: DataFrame) -> int:
    return df.count()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, f) -> None:
        began = time.perf_counter()
        f()
        took[name] = round(time.perf_counter() - began, 3)

    g = chain(spark)
    timed("chain_build", lambda: (g.vertices.count(), g.edges.count()))
    timed("chain_bfs", lambda: _same(done(paths.bfs(g, 0)), CHAIN))
    timed("chain_dijkstra", lambda: _same(paths.shortest_paths(g, 0, weight=F.col("weight")).where(F.col("id") == CHAIN - 1).first()["distance"], float(CHAIN - 1)))
    timed("chain_scc", lambda: _same(components.strong_labels(g).select("label").distinct().count(), CHAIN))
    timed("chain_csr", lambda: _same(g.compressed().agg(F.sum(F.size("targets"))).first()[0], 2 * CHAIN - 3))
    for name in NAMES:
        timed(name, lambda name=name: done(queries.QUERIES[name](spark, sf_dir)))
    llm = Path(__file__).parent / "graphloom" / "llm" / "queries.py"
    if llm.exists():
        from importlib import import_module

        more = import_module("graphloom.llm.queries").QUERIES
        for name in sorted(more):
            timed(name, lambda name=name: done(more[name](spark, sf_dir)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


def _same(a, b) -> None:
    if a != b:
        raise AssertionError(f"{a} is not {b}")


if __name__ == "__main__":
    main()
