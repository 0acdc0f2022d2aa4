"""One random walk over a graph of any size: edges sorted once, a lookup a step."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphError
from ..graph import Graph
from ..plans.durable import Stored


def single_walk(g: Graph, root, *, steps: int, chain: str = "uniform", seed: int = 0, factor: float = 0.2, stop_at=frozenset()) -> DataFrame:
    """(step, edge_id, src, dst), drawn as ``kernels.walks`` draws; sums of weights may differ from it by rounding.

    The edges lie sorted by source and order. Of a vertex that the walk comes to the driver learns one row a sorted part:
    the place of its first edge there, how many there are and what they weigh. A step then reads one edge by its place or,
    weighted, sums up the edges of one part.
    """
    if chain not in ("uniform", "round_robin", "weighted", "vanishing"):
        raise GraphError(f"no edge chain is called {chain!r}")
    weighed = chain in ("weighted", "vanishing")
    weight = F.col("weight").cast("double") if weighed and "weight" in g.edges.columns else F.lit(1.0)
    e = g.edges.select("edge_id", "ord", "src", "dst", weight.alias("w")).repartitionByRange("src", "ord", "edge_id").sortWithinPartitions("src", "ord", "edge_id")
    at = Stored(e.drop("ord").withColumn("at", F.monotonically_increasing_id()), "sorted-edges")
    parts = Stored(at.df.groupBy("src", F.shiftright("at", 33).alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"), F.sum("w").alias("w")), "sources")
    known: dict = {}
    rng, turn, picked = random.Random(seed), {}, {}  # picked: place -> (vertex, part, weight, times)

    def edge(place: int):
        return at.df.where(F.col("at") == place).select("at", "edge_id", "dst", "w").first()

    def heavy(v, rows: list):
        """The first edge at v up to which the weights come to a random share of all."""
        less = {}
        for place, (u, part, w, times) in picked.items():
            if u == v:
                less[part] = less.get(part, 0.0) + w * (1 - factor**times)
        sums = [r["w"] - less.get(r["part"], 0.0) for r in rows]
        left = rng.random() * sum(sums)
        for r, s in zip(rows, sums):
            if left <= s:
                now = F.col("w")
                for place, (u, part, w, times) in picked.items():
                    if u == v and part == r["part"]:
                        now = F.when(F.col("at") == place, w * factor**times).otherwise(now)
                here = at.df.where((F.col("at") >= r["first"]) & (F.col("at") < r["first"] + r["n"]))
                high = F.sum(now).over(W.partitionBy("src").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
                found = here.withColumn("high", high).where(F.col("high") >= left).agg(F.min("at").alias("at")).first()["at"]
                return edge(r["first"] + r["n"] - 1 if found is None else found)
            left -= s
        return edge(rows[-1]["first"] + rows[-1]["n"] - 1)

    v, out = root, []
    for i in range(steps):
        if v not in known:
            known[v] = parts.df.where(F.col("src") == F.lit(v)).orderBy("part").collect()
        rows = known[v]
        degree = sum(r["n"] for r in rows)
        if not degree:
            break
        if weighed:
            k = heavy(v, rows)
        else:
            nth = int(rng.random() * degree) if chain == "uniform" else turn.get(v, 0) % degree
            turn[v] = turn.get(v, 0) + 1
            for r in rows:
                if nth < r["n"]:
                    k = edge(r["first"] + nth)
                    break
                nth -= r["n"]
        if k["edge_id"] in stop_at:
            break
        if chain == "vanishing":
            times = picked[k["at"]][3] if k["at"] in picked else 0
            picked[k["at"]] = (v, k["at"] >> 33, k["w"], times + 1)
        out.append((i, k["edge_id"], v, k["dst"]))
        v = k["dst"]
    id_, edge_ = g.vertices.schema["id"].dataType, g.edges.schema["edge_id"].dataType
    schema = T.StructType([T.StructField("step", T.LongType()), T.StructField("edge_id", edge_), T.StructField("src", id_), T.StructField("dst", id_)])
    for table in (at, parts):
        table.drop()
    return g.vertices.sparkSession.createDataFrame(out, schema)
