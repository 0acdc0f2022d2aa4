"""Runs a kernel on whole graphs, one task a graph, many graphs side by side.

Kernels are for what is sequential or exponential by nature. A graph beyond the bound raises; nothing is cut off. What a
kernel raises comes back as a row, so that the driver raises the same error class as a plan of supersteps would.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors
from ..graph import Graph
from ..plans.durable import cut

MAX_VERTICES, MAX_EDGES = 1_000_000, 4_000_000


class Local:
    """A graph in a task: vertices and edges as dense numbers in order of insertion."""

    def __init__(self, v: pd.DataFrame, e: pd.DataFrame, directed: bool):
        v = v.sort_values(["ord", "id"], kind="stable")
        e = e.sort_values(["ord", "edge_id"], kind="stable")
        self.directed = directed
        self.ids = v["id"].tolist()
        self.index = {x: i for i, x in enumerate(self.ids)}
        self.n, self.m = len(self.ids), len(e)
        at = pd.Series(np.arange(self.n), index=self.ids)
        self.src, self.dst = (at.reindex(e[c]).to_numpy().astype(np.int64) if self.m else np.empty(0, np.int64) for c in ("src", "dst"))
        self.weight = e["weight"].to_numpy(dtype=float) if "weight" in e else np.ones(self.m)
        self.edge_id = e["edge_id"].tolist()
        #: What a vertex column ``value`` says of each vertex, where there is one.
        self.value = v["value"].tolist() if "value" in v else None

    @cached_property
    def ends(self) -> tuple[list[int], list[int], list[float]]:
        return self.src.tolist(), self.dst.tolist(), self.weight.tolist()

    @cached_property
    def out(self) -> list[list[int]]:
        lists: list[list[int]] = [[] for _ in range(self.n)]
        for k, s in enumerate(self.ends[0]):
            lists[s].append(k)
        return lists

    @cached_property
    def into(self) -> list[list[int]]:
        lists: list[list[int]] = [[] for _ in range(self.n)]
        for k, d in enumerate(self.ends[1]):
            lists[d].append(k)
        return lists

    @cached_property
    def around(self) -> list[list[int]]:
        """Edges at a vertex in order, a loop once."""
        lists: list[list[int]] = [[] for _ in range(self.n)]
        for k, (s, d) in enumerate(zip(*self.ends[:2])):
            lists[s].append(k)
            if s != d:
                lists[d].append(k)
        return lists

    @property
    def steps(self) -> list[list[int]]:
        """The edges a search may take from a vertex."""
        return self.out if self.directed else self.around

    def other(self, k: int, v: int) -> int:
        s, d, _ = self.ends
        return d[k] if s[k] == v else s[k]

    @cached_property
    def neighbours(self) -> list[set[int]]:
        """Of the simple undirected graph."""
        sets: list[set[int]] = [set() for _ in range(self.n)]
        for s, d in zip(*self.ends[:2]):
            if s != d:
                sets[s].add(d)
                sets[d].add(s)
        return sets


Kernel = Callable[[Local], Iterable[tuple]]


def _bounded(v: DataFrame, e: DataFrame, by: str | None, max_vertices: int, max_edges: int) -> None:
    """Counts both frames in one job, before anything is gathered."""
    if by is None:  # one graph: two counts, nothing to group
        found = v.agg(F.count("*").alias("n")).withColumn("of", F.lit(0)).union(e.agg(F.count("*")).withColumn("of", F.lit(1))).collect()
        for r in found:
            most, what = ((max_vertices, "vertices"), (max_edges, "edges"))[r["of"]]
            if r["n"] > most:
                raise errors.GraphTooLargeError(f"the graph has {r['n']} {what}; the bound is {most}")
        return
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    both = v.select(by, one.alias("v"), none.alias("e")).union(e.select(by, none, one))
    sizes = both.groupBy(by).agg(F.sum("v").alias("v"), F.sum("e").alias("e")).where((F.col("v") > max_vertices) | (F.col("e") > max_edges))
    for r in sizes.limit(1).collect():
        n, most, what = (r["v"], max_vertices, "vertices") if r["v"] > max_vertices else (r["e"], max_edges, "edges")
        raise errors.GraphTooLargeError(f"graph {r[0]!r} has {n} {what}; the bound is {most}")


def run(graph: Graph, kernel: Kernel, schema: str, *, by: str | None = None, max_vertices: int = MAX_VERTICES, max_edges: int = MAX_EDGES) -> DataFrame:
    """The kernel's rows, stored; with ``by`` both frames have that column and each of its values is a graph of its own.

    ``{id}`` in the schema stands for the type of vertex ids, ``{edge}`` for that of edge ids. An error of the engine that
    a kernel raises for any graph is raised here.
    """
    v, e = graph.vertices, graph.edges
    key = by or "graph"
    if by is None:
        v, e = v.withColumn(key, F.lit(0)), e.withColumn(key, F.lit(0))
    _bounded(v, e, by, max_vertices, max_edges)
    columns = [key, "edge_id", "ord", "src", "dst", *(["weight"] if "weight" in e.columns else [])]
    out = T._parse_datatype_string(schema.format(id=v.schema["id"].dataType.simpleString(), edge=e.schema["edge_id"].dataType.simpleString()))
    if by is not None:
        out = T.StructType([v.schema[key], *out.fields])
    names, directed = out.names, graph.directed
    failure = T.StructType([*(T.StructField(f.name, f.dataType) for f in out.fields), T.StructField("_error", T.StringType()), T.StructField("_said", T.StringType())])

    def apply(key_: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = [(*r, None, None) for r in kernel(Local(left, right, directed))]
        except errors.GraphError as err:
            rows = [(*([None] * (len(names) - (by is not None))), type(err).__name__, str(err))]
        if by is not None:
            rows = [(key_[0], *r) for r in rows]
        return pd.DataFrame({f.name: pd.Series([r[i] for r in rows], dtype=object) for i, f in enumerate(failure.fields)})

    extra = ["value"] if "value" in v.columns else []
    found = cut(v.select(key, "id", "ord", *extra).groupBy(key).cogroup(e.select(*columns).groupBy(key)).applyInPandas(apply, failure), "kernel")
    for r in found.where("_error is not null").limit(1).collect():
        raise getattr(errors, r["_error"])(r["_said"])
    return found.select(*names)
