"""Graphs that functions make: transition factories as table functions, and searches that expand only what they visit."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GraphError

#: From a vertex to the vertices that it leads to.
Factory = Callable[[object], Iterable[object]]
#: Rows of searches that a task hands on together, and parts that roots are dealt to for each core.
ROWS, TASKS_A_CORE = 20_000, 4


class Transitions:
    """Named factories, in the order in which they were added; a vertex leads to what any of them says, repeats included.

    ``id_type`` is the type of vertices. A change gives no new object; frames made before keep the factories of then.
    """

    def __init__(self, id_type: str = "long", **factories: Factory):
        self.id_type = id_type
        self._factories: dict[str, Factory] = {}
        for name, f in factories.items():
            self.add(name, f)

    def add(self, name: str, factory: Factory) -> None:
        if name in self._factories:
            raise GraphError(f"there is a factory {name!r} already")
        self._factories[name] = factory

    def remove(self, name: str) -> bool:
        return self._factories.pop(name, None) is not None

    def clear(self) -> None:
        self._factories.clear()

    def __contains__(self, name: str) -> bool:
        return name in self._factories

    def names(self) -> list[str]:
        return list(self._factories)

    def out_edges(self, vertices: DataFrame) -> DataFrame:
        """(src, dst, factory, nth) for each of vertices (id): a lateral join with a table function, so each row is expanded where it is."""
        factories = list(self._factories.items())

        class Expand:
            def eval(self, v):
                for name, f in factories:
                    for nth, to in enumerate(f(v)):
                        yield to, name, nth

        made = F.udtf(Expand, returnType=f"dst {self.id_type}, factory string, nth int")
        return vertices.select(F.col("id").alias("src")).lateralJoin(made(F.col("src").outer()))

    expand = out_edges

    def contains_edges(self, pairs: DataFrame) -> DataFrame:
        """pairs (src, dst) with ``found``."""
        known = self.out_edges(pairs.select(F.col("src").alias("id")).distinct()).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.lit(True).alias("_f")).distinct()
        return pairs.join(known, (F.col("src") == F.col("_s")) & (F.col("dst") == F.col("_d")), "left").withColumn("found", F.coalesce("_f", F.lit(False))).drop("_s", "_d", "_f")

    def search(self, roots: DataFrame, *, until: Callable[[object], bool] | None = None, max_depth: int | None = None, breadth_first: bool = False, most: int = 1_000_000) -> DataFrame:
        """(root, id, order_no, depth, parent) of a search from each of roots (id), all side by side.

        Depth first goes along the first transition first. A vertex is expanded only when the search comes to it, at most
        once a search, and the search ends with the first vertex for which ``until`` holds. Beyond ``most`` vertices it
        raises; nothing is cut off.
        """
        factories = list(self._factories.values())
        kind = roots.schema["id"].dataType.simpleString()

        def one(root) -> Iterator[tuple]:
            seen = {root} if breadth_first else set()
            todo, no = [(root, 0, None)], 0
            at = 0
            while at < len(todo):
                if breadth_first:
                    v, depth, parent = todo[at]
                    at += 1
                else:
                    v, depth, parent = todo.pop()
                    if v in seen:
                        continue
                    seen.add(v)
                if no >= most:
                    raise GraphError(f"the search from {root!r} meets more than {most} vertices")
                yield root, v, no, depth, parent
                no += 1
                if until is not None and until(v):
                    return
                if max_depth is None or depth < max_depth:
                    onward = [(u, depth + 1, v) for f in factories for u in f(v)]
                    for step in onward if breadth_first else reversed(onward):
                        if step[0] not in seen:
                            if breadth_first:
                                seen.add(step[0])
                            todo.append(step)

        schema = f"root {kind}, id {kind}, order_no long, depth int, parent {kind}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                types = [batch.schema.field(0).type, batch.schema.field(0).type, pa.int64(), pa.int32(), batch.schema.field(0).type]
                made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["root", "id", "order_no", "depth", "parent"])
                rows: list[tuple] = []
                for root in batch.column(0).to_pylist():
                    for row in one(root):
                        rows.append(row)
                        if len(rows) >= ROWS:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

        # a small file of roots is one task's work where it is not dealt
        dealt = roots.select("id").repartition(TASKS_A_CORE * roots.sparkSession.sparkContext.defaultParallelism)
        return dealt.mapInArrow(run, schema)
