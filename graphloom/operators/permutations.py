"""All orders of a graph's vertices, each made from its own number, so that tasks share the enumeration and none holds it."""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import GraphTooLargeError
from ..graph import Graph

#: 20! is the largest factorial that a long holds; a row deals at most so many orders out to others, a task takes about so many.
MOST, BLOCK, A_TASK = 20, 40_320, 2_000_000


def unranked(n: int, first: int, last: int) -> np.ndarray:
    """The orders of 0 .. n - 1 that have the numbers first .. last, a row each.

    A number's digits to the base of factorials say which of the items left comes next; from the last place to the first,
    what stands behind an item moves up where it is no less.
    """
    number = np.arange(first, last + 1, dtype=np.int64)
    order = np.zeros((len(number), n), np.int64)
    for i in range(n):
        order[:, i], number = np.divmod(number, factorial(n - 1 - i))
    for i in range(n - 2, -1, -1):
        order[:, i + 1 :] += order[:, i + 1 :] >= order[:, i : i + 1]
    return order


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            items, first, last = batch.column(1)[i].values, batch.column(2)[i].as_py(), batch.column(3)[i].as_py()
            order = unranked(len(items), first, last)
            ends = pa.array(np.arange(len(order) + 1, dtype=np.int32) * len(items))
            path = pa.ListArray.from_arrays(ends, items.take(pa.array(order.reshape(-1))))
            who = batch.column(0).take(pa.array(np.full(len(order), i)))
            yield pa.RecordBatch.from_arrays([who, pa.array(np.arange(first, last + 1)), path], names=["by", "no", "path"])


def permutations(g: Graph, *, by: str | None = None) -> DataFrame:
    """(by, no, path): every order of the vertices, numbered from 0 as orders by ``ord`` are sorted; path is an array of ids.

    A graph without vertices has one order, the empty one, unless ``by`` tells graphs apart. More than ``MOST`` vertices in one
    graph raise GraphTooLargeError before anything is enumerated.
    """
    v = g.vertices.select(*([F.col(by).alias("by")] if by else [F.lit(0).alias("by")]), "id", "ord")
    factorials = F.array(*(F.lit(factorial(k)).cast("long") for k in range(MOST + 1)))
    sizes = v.groupBy("by").agg(F.count("*").cast("int").alias("n"))
    size, total = sizes.agg(F.max("n"), F.sum(F.get(factorials, F.least("n", F.lit(MOST))).cast("double"))).first()
    if (size or 0) > MOST:
        raise GraphTooLargeError(f"a graph has {size} vertices; orders are enumerated for at most {MOST}")
    grouped = v.groupBy("by") if by else v.groupBy()
    listed = grouped.agg(F.sort_array(F.collect_list(F.struct("ord", "id"))).alias("v"))
    held = listed.select("by" if by else F.lit(0).alias("by"), F.col("v.id").alias("v"))
    many = F.get(factorials, F.size("v"))
    blocks = held.select("by", "v", many.alias("many"), F.explode(F.sequence(F.lit(0).cast("long"), many - 1, F.lit(BLOCK).cast("long"))).alias("first"))
    tasks = int(min(max((total or 0) // A_TASK, 1), 10_000))
    dealt = blocks.select("by", "v", "first", (F.least(F.col("first") + BLOCK, "many") - 1).alias("last")).repartition(tasks, "by", "first")
    fields = [T.StructField("by", v.schema["by"].dataType), T.StructField("no", T.LongType()), T.StructField("path", held.schema["v"].dataType)]
    found = dealt.mapInArrow(_paths, T.StructType(fields))
    return found.withColumnRenamed("by", by) if by else found.drop("by")


def hamiltonian_paths(g: Graph, *, by: str | None = None) -> DataFrame:
    """The permutations along which an edge leads from each vertex to the next; ``closed`` where one leads back to the first.

    Undirected edges lead both ways; a single vertex is closed as soon as it has a loop.
    """
    key = [by] if by else []
    arcs = g.edges.select(*key, F.col("src").alias("a"), F.col("dst").alias("b"))
    arcs = arcs if g.directed else arcs.union(arcs.select(*key, F.col("b"), F.col("a")))
    led = arcs.groupBy(*(F.col(k).alias("_by") for k in key)).agg(F.collect_set(F.struct("a", "b")).alias("_arcs"))
    whole = permutations(g, by=by)
    met = whole.join(led, F.col(by).eqNullSafe(F.col("_by")), "left") if by else whole.crossJoin(led)  # without by, led is one row
    has = lambda x, y: F.array_contains(F.coalesce("_arcs", F.array().cast(led.schema["_arcs"].dataType)), F.struct(x.alias("a"), y.alias("b")))
    steps = F.forall(F.sequence(F.lit(1), F.size("path") - 1), lambda i: has(F.get("path", i - 1), F.get("path", i)))
    met = met.where("size(path) > 0").where(F.when(F.size("path") == 1, F.lit(True)).otherwise(steps))
    return met.select(*key, "no", "path", has(F.element_at("path", -1), F.get("path", F.lit(0))).alias("closed"))
