"""Edge and path functions: Columns over edge rows, and plans over paths (path, pos, src, dst)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def is_self_edge() -> Column:
    return F.col("src") == F.col("dst")


def is_adjacent(v) -> Column:
    return (F.col("src") == v) | (F.col("dst") == v)


def same_edge(a: Column, b: Column, src: Column, dst: Column, *, directed: bool = True) -> Column:
    """Whether an edge has the ends a, b; undirected in either order."""
    ahead = (src == a) & (dst == b)
    return ahead if directed else ahead | ((src == b) & (dst == a))


def ordered_ends(edges: DataFrame, *, check: bool = False) -> DataFrame:
    """Undirected edges with the smaller end first; ``check`` raises on one that has not."""
    if check:
        bad = F.raise_error(F.lit("source must not exceed target"))
        return edges.withColumn("src", F.when(F.col("src") <= F.col("dst"), F.col("src")).otherwise(bad))
    return edges.select(*(F.least("src", "dst").alias(c) if c == "src" else F.greatest("src", "dst").alias(c) if c == "dst" else F.col(c) for c in edges.columns))


def path_checks(paths: DataFrame) -> DataFrame:
    """(path, is_path, has_cycles, is_path_without_cycles): edges follow on one another; a vertex is met again."""
    order = W.partitionBy("path").orderBy("pos")
    linked = paths.withColumn("_ok", F.coalesce(F.lag("dst").over(order) == F.col("src"), F.lit(True))).withColumn("_first", F.row_number().over(order) == 1)
    ends = linked.groupBy("path").agg(
        F.every("_ok").alias("is_path"), (F.count("*") + 1).alias("n"), F.size(F.array_union(F.collect_set("dst"), F.collect_set(F.when(F.col("_first"), F.col("src"))))).alias("d")
    )
    cyclic = F.col("n") > F.col("d")
    return ends.select("path", "is_path", cyclic.alias("has_cycles"), (F.col("is_path") & ~cyclic).alias("is_path_without_cycles"))
